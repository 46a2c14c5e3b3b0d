"""Words, their multiset likeness, and MinHash signatures of word multisets.

A text is the multiset of its words (runs of letters and digits, lower-cased). Numbering the occurrences of a
repeated word makes the multiset a plain set, on which MinHash estimates exactly the likeness used here:
(words in common) / (words in either), repeated words counted as often as they occur.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.session import spread

WORD = re.compile(r"[^\W_]+")
SKETCH = 128  # bits, one from each of so many minima


DIGIT = 6  # bits of a minimum that a prefix keeps


@dataclass(frozen=True)
class ForestPlan:
    """trees sorted permutations of the signatures, each entry there under the key of its first `deepest` hashes (DIGIT bits of each).

    Matched prefixes are shortened one hash at a time from `deepest` until the links found are, by their own likeness, at least `recall`
    of those that there are (see recall_of). The number of trees is such that a pair at the threshold is met with probability edge_recall
    where prefixes are `depth` long, which is as short as they get at first; below that they are shortened only while the recall asks for it.
    """

    threshold: float = 0.75
    depth: int = 7
    deepest: int = 9
    recall: float = 0.999
    edge_recall: float = 0.98
    least_depth: int = 4
    least_words: int = 20

    @property
    def trees(self) -> int:
        return int(np.ceil(np.log1p(-self.edge_recall) / np.log1p(-(self.threshold**self.depth))))

    @property
    def least_bits(self) -> int:
        """Sketch bits that a pair at the threshold shares with all but 0.3 per cent probability."""
        p, total = (1 + self.threshold) / 2, 0.0
        for k in range(SKETCH + 1):
            total += comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k)
            if total > 0.003:
                return k
        return SKETCH

    def shift(self, depth: int) -> int:
        """Bits of a key behind a prefix of that many hashes."""
        return DIGIT * (self.deepest - depth)

    def prefix(self, key: Column, depth: int) -> Column:
        return F.shiftright(key, self.shift(depth))

    def depths(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of keys of one tree (counted from least_depth; shorter ones give less than that)."""
        apart = a ^ b
        out = np.full(apart.shape, self.least_depth - 1, np.int32)
        for d in range(self.least_depth, self.deepest + 1):
            out += (apart >> self.shift(d)) == 0
        return out


def recall_of(links: DataFrame, depth: int, plan: ForestPlan) -> float:
    """The share of all links that prefixes of `depth` have met, estimated from the links found: one of likeness s is met with probability
    1 - (1 - s**depth)**trees, so it stands for the inverse of that many. 1 where there are none."""
    met = 1 - F.pow(1 - F.pow(F.col("likeness"), F.lit(float(depth))), F.lit(float(plan.trees)))
    n, total = links.agg(F.count("*"), F.sum(1 / met)).first()
    return n / total if n else 1.0


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def likeness(a: str, b: str) -> float:
    """Multiset Jaccard of the words of two texts; two texts without words have 0."""
    x, y = Counter(words(a)), Counter(words(b))
    common = sum(min(n, y[w]) for w, n in x.items() if w in y)
    either = sum(x.values()) + sum(y.values()) - common
    return common / either if either else 0.0


@cache
def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 2**31, n, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)


class WordHasher:
    """Hashes of words, remembered; the memory is emptied when it holds too many."""

    def __init__(self, most: int = 400_000):
        self.known, self.most = {}, most

    def __call__(self, ws: list[str]) -> list[int]:
        known = self.known
        if len(known) > self.most:
            known.clear()
        out = []
        for w in ws:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        return out


def minhashes(sorted_hashes: list[list[int]], n: int) -> np.ndarray:
    """An n-column matrix of minima for each list of word hashes (equal words adjacent; no list empty)."""
    lengths = np.fromiter(map(len, sorted_hashes), dtype=np.int64, count=len(sorted_hashes))
    out = np.empty((len(lengths), n), dtype=np.uint32)
    if not len(lengths):
        return out
    flat = np.concatenate([np.array(x, dtype=np.uint64) for x in sorted_hashes])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    new = np.ones(len(flat), dtype=bool)
    new[1:] = flat[1:] != flat[:-1]
    new[starts] = True
    at = np.arange(len(flat))
    turn = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    with np.errstate(over="ignore"):
        x = flat + turn * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = ((x ^ (x >> np.uint64(29))) >> np.uint64(32)).astype(np.uint32)
        by, at, factors = np.argsort(lengths, kind="stable"), 0, _multipliers(n)
        while at < len(by):
            most = max(1, min(64, 16384 // max(1, int(lengths[by[min(at + 63, len(by) - 1)]]))))
            rows = by[at : at + most]
            at += len(rows)
            width = int(lengths[rows].max())
            part = x[starts[rows, None] + np.minimum(np.arange(width)[None], lengths[rows, None] - 1)]
            step = max(1, 131072 // part.size)
            for k in range(0, n, step):
                out[rows, k : k + step] = (part[:, None, :] * factors[None, k : k + step, None]).min(axis=2)
    return out


def tree_keys(mins: np.ndarray, plan: ForestPlan) -> np.ndarray:
    """One number per tree: the tree, then DIGIT bits of each of plan.deepest minima, so that keys sort as the leaves of the tries do.

    The first plan.depth minima of a tree are its own; the further ones, which only order the leaves under a prefix, are borrowed from the
    trees that follow.
    """
    n, t, d = len(mins), plan.trees, plan.depth
    m = (mins[:, : t * d].reshape(n, t, d) >> np.uint32(9)).astype(np.int64) & ((1 << DIGIT) - 1)
    key = np.broadcast_to(np.arange(t, dtype=np.int64), (n, t)).copy()
    for j in range(plan.deepest):
        key = (key << DIGIT) | (m[:, :, j] if j < d else np.roll(m[:, :, j % d], -(j // d), axis=1))
    return key


def sketches(mins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One bit of each of the first 128 minima, as two numbers: an estimate of likeness and a finer order of a tree's leaves."""
    bits = ((mins[:, :SKETCH] >> np.uint32(13)) & np.uint32(1)).astype(np.uint64)
    shifts = np.arange(64, dtype=np.uint64)
    return tuple((bits[:, i : i + 64] << shifts).sum(axis=1, dtype=np.uint64).view(np.int64) for i in (0, 64))


def shared_bits(a: np.ndarray, b: np.ndarray, a2: np.ndarray, b2: np.ndarray) -> np.ndarray:
    return SKETCH - np.bitwise_count((a ^ b).view(np.uint64)).astype(np.int64) - np.bitwise_count((a2 ^ b2).view(np.uint64))


def signature_table(df: DataFrame, id_col: str, text_col: str, plan: ForestPlan) -> DataFrame:
    """id, print (16 bytes, equal just for equal word multisets), s1, s2 (sketch), keys (one per tree) of texts with enough words.

    Null texts and texts of fewer than plan.least_words words are left out: they take no part in any comparison.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for b in batches:
            ids, prints, hashes = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ws = WORD.findall(t.lower())
                if len(ws) < plan.least_words:
                    continue
                ws.sort()
                ids.append(i)
                prints.append(hashlib.md5(" ".join(ws).encode("utf-8", "surrogatepass")).digest())
                hashes.append(hasher(ws))
            mins = minhashes(hashes, max(SKETCH, plan.trees * plan.depth))
            s1, s2 = sketches(mins)
            keys = tree_keys(mins, plan)
            offsets = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * plan.trees)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(prints, pa.binary()), pa.array(s1), pa.array(s2), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))],
                names=["id", "print", "s1", "s2", "keys"],
            )

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    return spread(src).mapInArrow(run, "id long, print binary, s1 long, s2 long, keys array<long>")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, right: DataFrame | None = None) -> DataFrame:
    """Of candidate pairs (a, b) those whose texts have at least the likeness threshold, with it.

    texts: id, text, of a and b, or of a only where `right` has those of b. Each text travels once per pair that needs it; texts without
    candidates stay where they are but for one exchange by id. Repeated ids count once (the least text is taken).
    """
    if right is None:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("id"), "a", "b")
        both = ends.join(texts.select("id", "text"), "id").groupBy("a", "b").agg(
            F.min(F.when(F.col("id") == F.col("a"), F.col("text"))).alias("x"), F.min(F.when(F.col("id") == F.col("b"), F.col("text"))).alias("y")
        )
    else:
        left = texts.select(F.col("id").alias("a"), F.col("text").alias("x"))
        there = pairs.select("a", "b").join(right.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
        both = there.join(left, "a").groupBy("a", "b").agg(F.min("x").alias("x"), F.min("y").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.array([likeness(x, y) if x is not None and y is not None else 0.0 for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())], dtype=float)
            keep = pa.array(s >= threshold)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), pa.array(s).filter(keep)], names=["a", "b", "likeness"])

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, likeness double")
