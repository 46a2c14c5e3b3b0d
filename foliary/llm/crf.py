"""A linear-chain conditional random field over hashed binary features, in numpy."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

SIZE = 1 << 15


_NUMBERS: dict[str, int] = {}  # names met before and their numbers; emptied when there are too many


def feature_ids(names: list[str]) -> np.ndarray:
    out = []
    for n in names:
        i = _NUMBERS.get(n)
        if i is None:
            if len(_NUMBERS) > 300_000:
                _NUMBERS.clear()
            i = _NUMBERS[n] = zlib.crc32(n.encode("utf-8", "replace")) % SIZE
        out.append(i)
    return np.array(out, dtype=np.int64)


@dataclass
class ChainField:
    """Weights of (feature, tag) and of (tag before, tag), the last row of the latter for the start."""

    weights: np.ndarray
    moves: np.ndarray

    @classmethod
    def fresh(cls, tags: int) -> ChainField:
        return cls(np.zeros((SIZE, tags)), np.zeros((tags + 1, tags)))

    def scores(self, sequence: list[np.ndarray]) -> np.ndarray:
        return np.stack([self.weights[f].sum(axis=0) for f in sequence])

    def best(self, sequence: list[np.ndarray]) -> list[int]:
        s = self.scores(sequence)
        value, back = s[0] + self.moves[-1], []
        for row in s[1:]:
            step = value[:, None] + self.moves[:-1]
            back.append(step.argmax(axis=0))
            value = step.max(axis=0) + row
        out = [int(value.argmax())]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]

    def marginals(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tag probabilities, and summed probabilities of moves, of a sequence with emission scores s."""
        n, k = s.shape
        inner, f, b = self.moves[:-1], np.empty((n, k)), np.zeros((n, k))
        f[0] = s[0] + self.moves[-1]
        for i in range(1, n):
            f[i] = s[i] + np.logaddexp.reduce(f[i - 1][:, None] + inner, axis=0)
        for i in range(n - 2, -1, -1):
            b[i] = np.logaddexp.reduce(inner + s[i + 1] + b[i + 1], axis=1)
        z = np.logaddexp.reduce(f[-1])
        pair = np.zeros((k + 1, k))
        pair[-1] = np.exp(f[0] + b[0] - z)
        for i in range(1, n):
            pair[:-1] += np.exp(f[i - 1][:, None] + inner + s[i] + b[i] - z)
        return np.exp(f + b - z), pair

    def fit(self, data: list[tuple[list[np.ndarray], list[int]]], rounds: int = 4, rate: float = 0.3, shrink: float = 1e-6, seed: int = 1) -> ChainField:
        r = np.random.default_rng(seed)
        g_w, g_m = np.full_like(self.weights, 1e-3), np.full_like(self.moves, 1e-3)
        for _ in range(rounds):
            for at in r.permutation(len(data)):
                seq, tags = data[at]
                p, pair = self.marginals(self.scores(seq))
                for i, (f, t) in enumerate(zip(seq, tags)):
                    d = -p[i]
                    d[t] += 1
                    g_w[f] += d * d
                    self.weights[f] += rate * d / np.sqrt(g_w[f]) - shrink * self.weights[f]
                    pair[tags[i - 1] if i else -1, t] -= 1
                g_m += pair * pair
                self.moves -= rate * pair / np.sqrt(g_m)
        return self
