"""Filling containers of fixed capacity by multiway differencing (problem 9)."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm.tokens import encode, encoding, rank_file
from foliary.session import materialize, spread


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: partition item numbers into `windows` sets of nearly equal total size.

    Every item starts as a partial partition; the two with the greatest imbalance are merged, the fullest window of one with the
    emptiest of the other, until one is left. Windows that are empty on both sides are not touched.
    """
    heap = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]  # windows in falling order, empty ones left out
    heapq.heapify(heap)
    turn = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        room = windows - len(a)
        out = a + b[:room] if room >= len(b) else a + b[:room]
        for j, (s, items) in enumerate(b[room:]):  # the rest joins the emptiest of a
            t, mine = out[len(a) - 1 - j]
            out[len(a) - 1 - j] = (t + s, mine + items)
        out.sort(key=lambda x: -x[0])
        if len(out) == windows:
            low = out[-1][0]
        else:
            low = 0
        heapq.heappush(heap, (low - out[0][0], turn, out))
        turn += 1
    done = [items for _, items in heap[0][2]] if heap else []
    return done + [[] for _ in range(windows - len(done))]


def fill(sizes: list[int], capacity: int) -> list[int]:
    """A window number for each item so that no window holds more than capacity; no item may be larger than that.

    The count starts at the least that can do and rises whenever a window would overflow.
    """
    if not sizes:
        return []
    windows = max(1, -(-sum(sizes) // capacity), sum(s * 2 > capacity for s in sizes))
    while True:
        parts = differencing(sizes, windows)
        if max(sum(sizes[i] for i in p) for p in parts) <= capacity:
            break
        windows += 1
    out = [0] * len(sizes)
    for w, p in enumerate(parts):
        for i in p:
            out[i] = w
    return out


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(first, count) ranges of n tokens: whole if it fits, else cut into full containers and a rest."""
    return [(a, min(capacity, n - a)) for a in range(0, n, capacity)] or [(0, 0)]


def pack_texts(df: DataFrame, id_col: str, text_col: str, capacity: int = 2048, windows_per_group: int = 64, ranks: bytes | None = None) -> DataFrame:
    """id_col, piece_no, first_token, n_tokens, container of every text or piece.

    A text is cut only if it alone exceeds the capacity: into full containers and a rest. The other pieces are dealt at random (by
    a hash) to groups of about windows_per_group containers, whose number follows the total size, and each group is filled by
    multiway differencing; so no group grows with the data. Null and empty texts have no tokens and lie in a container all the
    same. Repeated rows (same id and text) count once; rows of one id with different texts are packed each for itself; null ids are kept;
    an empty table gives an empty table. The groups follow from ids and texts, so the containers do not depend on how the rows are parted.
    """
    ranks, kind = ranks or rank_file(), dict(df.dtypes)[id_col]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks)
        for b in batches:
            counts = [len(encode(t, enc)) for t in b.column(1).to_pylist()]
            rows = [(i, p, a, n) for i, c in enumerate(counts) for p, (a, n) in enumerate(pieces_of(c, capacity))]
            at, no, first, n = (np.array(x, dtype=np.int64) for x in zip(*rows)) if rows else [np.empty(0, np.int64)] * 4
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(2).take(take), pa.array(no.astype(np.int32)), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))], names=["id", "print", "piece_no", "first_token", "n_tokens"])

    shape = f"id {kind}, print long, piece_no int, first_token int, n_tokens int"
    pieces = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))).withColumn("print", F.xxhash64("text")).mapInArrow(measure, shape)
    pieces = materialize(pieces.dropDuplicates(["id", "print", "piece_no"]), "pieces")
    total = pieces.where(F.col("n_tokens") < capacity).agg(F.sum("n_tokens")).first()[0] or 0
    groups = max(1, -(-total // (capacity * windows_per_group)))

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("n_tokens", "descending"), ("id", "ascending"), ("print", "ascending"), ("piece_no", "ascending")])
        places = fill(t["n_tokens"].to_pylist(), capacity)
        return t.drop_columns(["group"]).append_column("container", pa.array([f"g{key[0].as_py()}-{w}" for w in places], pa.string()))

    loose = pieces.where(F.col("n_tokens") < capacity).withColumn("group", F.pmod(F.xxhash64("id", "print", "piece_no"), F.lit(groups)))
    packed = loose.groupBy("group").applyInArrow(pack, shape + ", container string")
    full = pieces.where(F.col("n_tokens") >= capacity).withColumn("container", F.concat_ws("-", F.lit("f"), F.hex(F.xxhash64("id", "print")), F.col("piece_no")))
    return packed.union(full.select(packed.columns)).drop("print").withColumnRenamed("id", id_col)
