"""Languages of texts and paragraphs by a byte convolutional network (problem 7)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.session import spread

LANGUAGES = ("en", "fr", "de", "es", "it")
# Ways in which a label may name each language; anything else says nothing.
SPELLINGS = {
    "en": "en eng english anglais englisch inglés ingles inglese",
    "fr": "fr fra fre french français francais französisch franzoesisch francés frances francese",
    "de": "de deu ger german deutsch allemand alemán aleman tedesco",
    "es": "es spa esp spanish español espanol castellano espagnol spanisch spagnolo",
    "it": "it ita italian italiano italien italienisch",
}
NAMED = {s: lang for lang, all_ in SPELLINGS.items() for s in all_.split()}
GAP = re.compile(r"(?:\r\n|\r|\n)(?:[^\S\r\n]*(?:\r\n|\r|\n))+")
LETTERS = re.compile(r"[^\W\d_]")
WINDOW, WIDTHS = 128, (2, 3, 4)
#: Letters below which a paragraph is short, by class, and the share of its confident verdicts that must be right.
SHORT, SURE = (12, 25, 60), 0.995


def named_language(label: str | None) -> str | None:
    """The language a label names, whatever its spelling; None if it names none of the five."""
    if not label:
        return None
    low = label.strip().lower()
    return NAMED.get(low) or NAMED.get(re.split(r"[-_ ]", low)[0])


def paragraphs(text: str) -> list[str]:
    """Paragraphs between blank lines (which may hold white space), empty ones left out."""
    return [p for p in GAP.split(text) if p.strip()]


def windows(text: str, size: int = WINDOW) -> np.ndarray:
    """The bytes of a lower-cased text in rows of fixed length, the last one ending with the text; short texts are padded with 0."""
    raw = np.frombuffer(" ".join(text.lower().split()).encode("utf-8", "replace"), dtype=np.uint8)
    if len(raw) <= size:
        return np.pad(raw, (0, size - len(raw)))[None]
    starts = np.append(np.arange(0, len(raw) - size, size), len(raw) - size)
    return raw[starts[:, None] + np.arange(size)]


@dataclass
class ByteNet:
    """Byte vectors, filters of several widths, the largest response of each over the window, softmax."""

    embed: np.ndarray
    kernels: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, classes: int = len(LANGUAGES), dim: int = 8, filters: int = 32, seed: int = 3) -> ByteNet:
        r = np.random.default_rng(seed)
        g = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        return cls((0.5 * r.standard_normal((256, dim))).astype(np.float32), [g(w * dim, filters) for w in WIDTHS], [np.zeros(filters, np.float32) for _ in WIDTHS], g(len(WIDTHS) * filters, classes), np.zeros(classes, np.float32))

    def params(self) -> list[np.ndarray]:
        return [self.embed, *self.kernels, *self.biases, self.out, self.out_bias]

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        e = self.embed[x]
        best, where = [], []
        for w, k, b in zip(WIDTHS, self.kernels, self.biases):
            d = e.shape[2]
            n = x.shape[1] - w + 1
            z = sum(e[:, j : j + n] @ k[j * d : (j + 1) * d] for j in range(w))
            at = z.argmax(axis=1)
            best.append(np.take_along_axis(z, at[:, None], axis=1)[:, 0] + b)
            where.append(at)
        return np.concatenate(best, axis=1), where

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_pairs"}

    @cached_property
    def _pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """What every pair of bytes adds to the filters' responses: as the first two bytes (all widths), and as the next two (widths 3 and 4)."""
        d, f = self.embed.shape[1], self.kernels[0].shape[1]
        near, far = np.zeros((256, 256, 3 * f), np.float32), np.zeros((256, 256, 2 * f), np.float32)
        for i, k in enumerate(self.kernels):
            part = [self.embed @ k[j * d : (j + 1) * d] for j in range(WIDTHS[i])]
            near[:, :, i * f : (i + 1) * f] = part[0][:, None] + part[1][None] + self.biases[i]
            if i:
                far[:, :, (i - 1) * f : i * f] = part[2][:, None] + (part[3][None] if i == 2 else 0)
        return near.reshape(65_536, -1), far.reshape(65_536, -1)

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        """Log probabilities of windows: what pooled() gives, with the products of bytes and filters looked up."""
        near, far = self._pairs
        out = np.empty((len(x), len(self.out_bias)), dtype=np.float32)
        f, n = self.kernels[0].shape[1], x.shape[1]
        for b in range(0, len(x), 8):  # few windows at a time stay in the processor's cache
            w = x[b : b + 8].astype(np.int32)
            code = (w[:, :-1] << 8) | w[:, 1:]
            z = near[code]
            z[:, : n - 3, f:] += far[code[:, 2:]]
            z[:, n - 3, f : 2 * f] += far[w[:, n - 1] << 8][:, :f]  # the last place of width 3
            z[:, n - 2, f : 2 * f] = z[:, n - 3 :, 2 * f :] = -np.inf  # no places: the window ends before
            h = z.max(axis=1)
            s = np.maximum(h, 0) @ self.out + self.out_bias
            out[b : b + 8] = s - np.logaddexp.reduce(s, axis=1, keepdims=True)
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        h, where = self.pooled(x)
        r = np.maximum(h, 0)
        z = r @ self.out + self.out_bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p *= (weight / len(y))[:, None]
        d_h = (p @ self.out.T) * (h > 0)
        d_embed, d_k, d_b, f = np.zeros_like(self.embed), [], [], self.kernels[0].shape[1]
        for i, w in enumerate(WIDTHS):
            d, dim = d_h[:, i * f : (i + 1) * f], self.embed.shape[1]
            seen = x[np.arange(len(x))[:, None, None], where[i][:, :, None] + np.arange(w)]  # rows, filters, width
            e = self.embed[seen].reshape(len(x), f, w * dim)
            d_k.append(np.einsum("bfk,bf->kf", e, d))
            d_b.append(d.sum(axis=0))
            back = (d[:, :, None] * self.kernels[i].T[None]).reshape(len(x), f, w, dim)
            np.add.at(d_embed, seen.ravel(), back.reshape(-1, dim))
        return [d_embed, *d_k, *d_b, r.T @ p, p.sum(axis=0)]

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int, rate: float = 5e-3, seed: int = 5) -> ByteNet:
        r, step = np.random.default_rng(seed), 0
        weight = (len(y) / (len(LANGUAGES) * np.maximum(np.bincount(y, minlength=len(LANGUAGES)), 1)))[y].astype(np.float32)
        weight = np.minimum(weight, 5)
        moments, mean, n = [(np.zeros_like(p), np.zeros_like(p)) for p in self.params()], [np.zeros_like(p) for p in self.params()], 0
        for turn in range(rounds):
            order = r.permutation(len(y))
            for b in range(0, len(y), 64):
                step += 1
                at = order[b : b + 64]
                for p, g, (m, v) in zip(self.params(), self.gradients(x[at], y[at], weight[at]), moments):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                if 2 * turn >= rounds and rounds * len(y) >= 64 * 200:  # a mean of the later steps, the latest counting most, is steadier than the last of them
                    n += 1
                    for a, p in zip(mean, self.params()):
                        a += (p - a) * 4 / (n + 3)
        for a, p in zip(mean, self.params()):
            if n:
                p[...] = a
        return self


def shortened(x: np.ndarray, seed: int = 6) -> np.ndarray:
    """Windows cut off behind a random place, as short texts are."""
    keep = np.random.default_rng(seed).integers(20, 110, len(x))
    return np.where(np.arange(x.shape[1])[None] < keep[:, None], x, 0).astype(x.dtype)


def train(x: np.ndarray, y: np.ndarray, steps: int = 1000) -> ByteNet:
    """Fit on labelled windows of which some labels are wrong: a first fit finds the windows whose label it finds impossible,
    and the final fit, on windows of full and of shorter length, leaves them out. The steps are the same for any size of sample."""
    turns = lambda n, share: max(1, round(steps * share * 64 / max(n, 1)))
    first = ByteNet.fresh().fit(x, y, rounds=turns(len(y), 0.3))
    sure = first.log_probs(x)[np.arange(len(y)), y] > np.log(0.2)
    keep = sure if sure.mean() > 0.5 else np.ones(len(y), bool)
    x, y = np.concatenate([x[keep], shortened(x[keep])]), np.concatenate([y[keep], y[keep]])
    return ByteNet.fresh(seed=4).fit(x, y, rounds=turns(len(y), 1))


def label_language(c: Column) -> Column:
    """named_language as a column expression."""
    names = F.create_map([F.lit(x) for kv in sorted(NAMED.items()) for x in kv])
    low = F.lower(F.trim(c))
    return F.coalesce(names[low], names[F.split(low, "[-_ ]")[0]])


@dataclass
class LabelledWindows:
    """A training sample: windows x with languages y, and short paragraphs (windows short_x, languages short_y, letters) kept from training."""

    x: np.ndarray
    y: np.ndarray
    short_x: np.ndarray
    short_y: np.ndarray
    letters: np.ndarray


def labelled_windows(df: DataFrame, text_col: str, label_col: str, most: int = 16_000, per_text: int = 4) -> LabelledWindows:
    """At most `most` windows whose label names a language: the bounded training sample. A text gives per_text windows spread over it (more,
    up to eight times that, where there are few texts), one short piece, and as many short paragraphs, of which half are set aside to fit cautions(). Texts are drawn by their hash, copies
    once, and put in the order of their hash, so the sample follows from the rows alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, lang, h in zip(*(b.column(c).to_pylist() for c in range(3))):
                w, third, k = windows(t), len(t) // 3, LANGUAGES.index(lang)
                at = sorted({int(round(q)) for q in np.linspace(0, len(w) - 1, per_text)})
                out += [(x.tobytes(), k, h, 0) for x in (*w[at], windows(t[third : third + 45])[0])]
                short = [(p, n) for p in paragraphs(t) if 4 <= (n := len(LETTERS.findall(p))) < SHORT[-1]]
                out += [(windows(p)[0].tobytes(), k, h, n if (h + i) % 2 else 0) for i, (p, n) in enumerate(short[:: max(1, len(short) // per_text)][:per_text])]
            kinds = [pa.binary(), pa.int32(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], kind) for c, kind in enumerate(kinds)], names=["w", "y", "h", "letters"])

    src = df.select(F.col(text_col).cast("string").alias("t"), label_language(F.col(label_col).cast("string")).alias("l")).where("l is not null and length(t) >= 50").withColumn("h", F.xxhash64("t"))
    n = src.count()
    share, per_text = min(1.0, 1.1 * most / max((per_text + 1) * n, 1)), int(np.clip(most // max(n, 1), per_text, 8 * per_text))
    texts = src.where(F.pmod("h", F.lit(1_000_000)) < int(share * 1_000_000)).distinct()
    drawn = texts.mapInArrow(run, "w binary, y int, h long, letters int").toArrow()
    rows = sorted(zip(*(drawn[c].to_pylist() for c in ("h", "w", "y", "letters"))))
    sets = [[r for r in rows if not r[3]][:most], [r for r in rows if r[3]][:most]]
    x = [np.frombuffer(b"".join(r[1] for r in part), np.uint8).reshape(-1, WINDOW) for part in sets]
    y = [np.array([r[2] for r in part], dtype=np.int64) for part in sets]
    return LabelledWindows(x[0], y[0], x[1], y[1], np.array([r[3] for r in sets[1]], dtype=np.int64))


def cautions(net: ByteNet, sample: LabelledWindows, least: int = 30) -> list[float]:
    """The confidence from which a paragraph of each SHORT class may contradict its text: fitted on labelled short paragraphs the network
    was not trained on, so that SURE of the verdicts from there on are right. Above 1 where no confidence is enough."""
    out = []
    for low, high in zip((0, *SHORT[:-1]), SHORT):
        here = (sample.letters >= low) & (sample.letters < high)
        if here.sum() < least:
            out.append(1.1)
            continue
        logs = net.log_probs(sample.short_x[here])
        top, right = np.exp(logs.max(axis=1)), logs.argmax(axis=1) == sample.short_y[here]
        right |= logs[np.arange(len(right)), sample.short_y[here]] < np.log(1e-3)  # a label the network finds impossible is itself wrong
        order = np.argsort(-top, kind="stable")
        enough = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= SURE)
        out.append(float(max(0.6, top[order][enough[-1]])) if len(enough) and enough[-1] >= least - 1 else 1.1)
    return out


def _judge(net: ByteNet, text: str, least_letters: int, wary: list[float]) -> list[tuple[int, str | None, float]]:
    """(paragraph number, language, confidence), the whole text as number 0."""
    parts = paragraphs(text)
    wins = [windows(p) for p in parts]
    letters = np.array([len(LETTERS.findall(p)) for p in parts])
    logs = net.log_probs(np.concatenate(wins))
    count = np.array([len(w) for w in wins])
    each = np.add.reduceat(logs, np.cumsum(count) - count, axis=0)
    mean = each / count[:, None] ** 0.5  # successive windows are alike, so they count as fewer
    prob = np.exp(mean - np.logaddexp.reduce(mean, axis=1, keepdims=True))
    lang = prob.argmax(axis=1)
    share = np.array([letters[(lang == k) & (letters >= least_letters)].sum() for k in range(len(LANGUAGES))], dtype=float)
    if share.sum():
        top = int(share.argmax())
        total = [(0, LANGUAGES[top], float((share[top] / share.sum()) * prob[(lang == top) & (letters >= least_letters), top].mean()))]
    else:
        whole = each.sum(axis=0)
        p = np.exp(whole - np.logaddexp.reduce(whole))
        top = int(p.argmax())
        total = [(0, LANGUAGES[top], float(p[top]))]
    out = total
    for i in range(len(parts)):
        k = int(lang[i])
        # not sure enough against the language of the text: the paragraph goes with the text
        least = next((w for n, w in zip(SHORT, wary) if letters[i] < n), 0.6)
        if k != top and (letters[i] < 4 or prob[i, k] < least):
            k = top
        out.append((i + 1, LANGUAGES[k], float(prob[i, k])))
    return out


def detect_languages(df: DataFrame, id_col: str, text_col: str, label_col: str, net: ByteNet | None = None, least_letters: int = 25, wary: list[float] | None = None) -> DataFrame:
    """id, label, n_chars, main, paragraph_no, language, confidence: a row for each text (paragraph_no 0) and each of its paragraphs (from 1).

    main is the language of the text: that of most of its letters, paragraphs of fewer than least_letters not counted where there are
    others. A short paragraph departs from it only at a confidence that cut pieces of labelled texts have shown to be safe (wary, see
    cautions). The network is trained on a bounded sample of the labelled rows unless one is given. Null, empty and blank texts give no
    row; one with no letters gets the network's guess at a low confidence; repeated rows give repeated results; an empty table gives an
    empty table. One text is one task's work, read once; nothing is exchanged.
    """
    if net is None:
        sample = labelled_windows(df, text_col, label_col)
        net = train(sample.x, sample.y) if len(sample.y) else ByteNet.fresh()
        wary = wary or cautions(net, sample)
    wary = wary or [0.99, 0.95, 0.9]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t, lab in zip(*(b.column(c).to_pylist() for c in range(3))):
                if t.strip():
                    found = _judge(net, t, least_letters, wary)
                    rows += [(i, lab, len(t), found[0][1], *r) for r in found]
            cols = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["id", "label", "n_chars", "main", "paragraph_no", "language", "confidence"])

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label")).where("text is not null")
    return spread(src).mapInArrow(run, "id long, label string, n_chars int, main string, paragraph_no int, language string, confidence double")


def wrong_languages(found: DataFrame, least_chars: int = 50) -> DataFrame:
    """id, paragraph_no, language of detect_languages rows that correct a label (0) or depart from the text's language (1, 2, …).

    Texts under least_chars are left out; repeated rows count once. One reading of the rows.
    """
    rows = found.where(F.col("n_chars") >= least_chars)
    label = F.coalesce(label_language(F.col("label")), F.lit(""))
    wrong = F.when(F.col("paragraph_no") == 0, label != F.col("language")).otherwise(F.col("language") != F.col("main"))
    return rows.where(wrong).select("id", "paragraph_no", "language").distinct()
