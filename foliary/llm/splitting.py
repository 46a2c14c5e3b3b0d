"""Cutting oversized texts at natural boundaries by lexical cohesion (problem 5)."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.session import spread

BLANK = " \t\r\n\f"
#: Line ends and form feeds, and a space or tab directly after a sentence or clause mark, with the white space around them.
BOUNDARY = re.compile(r"[ \t\r\n\f]*(?:[\r\n\f]|(?<=[.!?;:])[ \t])[ \t\r\n\f]*")
TOKEN = re.compile(r"[^\W\d_]{3,}")


@dataclass(frozen=True)
class SplitPlan:
    limit: int = 2000
    overlap: int = 150
    least: int = 700  # a piece is not cut below this size where a later boundary fits
    block: int = 3  # stretches on each side of a gap whose words are compared


def _cosine(a: Counter, b: Counter) -> float:
    dot = sum(n * b[w] for w, n in a.items() if w in b)
    return dot / ((sum(n * n for n in a.values()) * sum(n * n for n in b.values())) ** 0.5) if dot else 0.0


def valleys(parts: list[str], block: int) -> list[float]:
    """Depth of the similarity valley at each gap between successive parts: how far similarity rises on either side of it."""
    bags = [Counter(w.lower() for w in TOKEN.findall(p)) for p in parts]
    sims = []
    for g in range(1, len(bags)):
        left, right = Counter(), Counter()
        for b in bags[max(0, g - block) : g]:
            left.update(b)
        for b in bags[g : g + block]:
            right.update(b)
        sims.append(_cosine(left, right))
    depth = []
    for g, s in enumerate(sims):
        i = g
        while i > 0 and sims[i - 1] >= sims[i]:
            i -= 1
        j = g
        while j + 1 < len(sims) and sims[j + 1] >= sims[j]:
            j += 1
        depth.append(sims[i] + sims[j] - 2 * s)
    return depth


def split_text(text: str, plan: SplitPlan = SplitPlan()) -> list[tuple[int, int, bool]]:
    """(start, end, forced) of the pieces of one text: at most plan.limit characters each, together the whole text.

    A piece ends at the deepest valley among the boundaries that leave it between plan.least and plan.limit characters, or at the
    last boundary that fits. The next piece starts about plan.overlap characters earlier, at a word; the overlap gives way where the
    next boundary would otherwise not fit. Only a stretch longer than the limit is cut inside: at a space if there is one in the last
    tenth, else at the limit; pieces that begin or end by such a cut are forced.
    """
    n, limit = len(text), plan.limit
    if n <= limit:
        return [(0, n, False)] if n else []
    gaps = [(m.start(), m.end()) for m in BOUNDARY.finditer(text)]
    opens, closes = [g[0] for g in gaps], [g[1] for g in gaps]
    bounds = [0, *closes, n]
    depth = valleys([text[a:b] for a, b in zip(bounds[:-1], bounds[1:])], plan.block)
    out, start, done, forced = [], 0, 0, False
    while n - start > limit:
        top = start + limit
        hi = bisect_right(opens, top)  # gaps that begin within reach
        lo = bisect_right(closes, max(done, start + plan.least - 1))
        if lo >= hi:
            lo = bisect_right(opens, done)
        usable = [g for g in range(lo, hi) if opens[g] > done]
        by_force = False
        if usable:
            fits = [g for g in usable if opens[g] - start >= plan.least] or usable
            best = max(fits, key=lambda g: (depth[g], g))
            end = min(closes[best], top)
            # white space at the end of the text belongs to the last piece
        elif not text[top:].strip(BLANK):
            end = top
        elif start < done:  # the overlap gives way
            start = done if done + limit <= n or n - done <= limit else done
            if text[done : done + 1].strip(BLANK) == "":
                while start < n and text[start] in BLANK:
                    start += 1
                out[-1] = (out[-1][0], min(start, out[-1][0] + limit), out[-1][2])
                start = min(start, out[-1][1])
            done = start
            continue
        elif text[start] in BLANK:  # white space before a long stretch gets a piece of its own
            end = start
            while end < top and text[end] in BLANK:
                end += 1
        else:
            end, by_force = top, True
            space = max(text.rfind(c, top - limit // 10, top) for c in BLANK)
            if space >= 0:
                end = space + 1
        out.append((start, end, forced or by_force))
        forced, done = by_force, end
        start = max(end - plan.overlap, out[-1][0] + 1)
        at = min((i for i in (text.find(c, start, end) for c in BLANK) if i >= 0), default=-1)
        start = at + 1 if at >= 0 else start
        if start >= end and not by_force:
            start = max(end - plan.overlap, out[-1][0] + 1)
    out.append((start, n, forced))
    return out


def split_texts(df: DataFrame, id_col: str, text_col: str, plan: SplitPlan = SplitPlan(), whole: bool = True) -> DataFrame:
    """id, piece_no (from 0), start, end, text, n_chars (of the whole text), forced: the ordered pieces of every text.

    Texts within the limit come out whole (whole=False leaves them out before any Python runs). Null and empty texts give no piece;
    null ids are kept; repeated rows give repeated pieces; an empty table gives an empty table. One text is one task's work and no
    exchange is needed. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows += [(i, k, s, e, t[s:e], len(t), f) for k, (s, e, f) in enumerate(split_text(t, plan))]
            cols = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["id", "piece_no", "start", "end", "text", "n_chars", "forced"])

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.length("text") > (0 if whole else plan.limit))
    return spread(src).mapInArrow(run, "id long, piece_no int, start int, end int, text string, n_chars int, forced boolean")
