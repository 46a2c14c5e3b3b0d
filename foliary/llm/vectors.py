"""The k most similar vectors of every vector, through balanced posting lists (problem 3)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliary.session import materialize, spread


@dataclass(frozen=True)
class ListPlan:
    """Settings of the index.

    rows_per_list sets the number of lists (at most most_lists); the lists are fitted on a sample of per_list rows for each,
    at most most_sampled in all (the bound on what reaches the driver), and every row is indexed. A vector is stored in up to
    `copies` lists whose centroids are within copy_ratio of its nearest one's distance, and searched in up to `probes` lists within
    probe_ratio. The defaults are for the nearest at any cosine; CLOSE is enough where only neighbours at cosine 0.90 or more are wanted.
    """

    rows_per_list: int = 128
    most_lists: int = 16_384
    per_list: int = 16
    most_sampled: int = 131_072
    copies: int = 2
    copy_ratio: float = 1.1
    probes: int = 64
    probe_ratio: float = 2.0
    degree: int = 12
    beam: int = 12
    entries: int = 16
    rows_per_unit: int = 4_096


CLOSE = ListPlan(probes=6, probe_ratio=1.15)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    """Cluster numbers of unit vectors by spherical k-means."""
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        order = np.argsort(near, kind="stable")
        at = np.flatnonzero(np.diff(near[order], prepend=-1))
        total = np.add.reduceat(x[order], at, axis=0)
        c[near[order][at]] = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
    return (x @ c.T).argmax(axis=1)


def _balanced(x: np.ndarray, most: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Split unit vectors until no part has more than `most`; parts in depth-first order, so neighbours are alike."""
    if len(x) <= most:
        return [x]
    part = _kmeans(x, min(16, -(-len(x) // most)), rng)
    if part.min() == part.max():  # all alike: any cut is as good
        part = np.arange(len(x)) * -(-len(x) // most) // len(x)
    return [y for p in np.unique(part) for y in _balanced(x[part == p], most, rng)]


@dataclass
class ListIndex:
    """Centroids, a graph of their nearest neighbours, entries into it, and the unit (group of lists) of each list."""

    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray
    units: np.ndarray
    plan: ListPlan = field(default_factory=ListPlan)

    @classmethod
    def fit(cls, sample: np.ndarray, rows: int, plan: ListPlan) -> ListIndex:
        rng = np.random.default_rng(7)
        lists = int(np.clip(rows // plan.rows_per_list, 1, plan.most_lists))
        parts = _balanced(sample, max(1, -(-len(sample) * 3 // (2 * lists))), rng)
        c = np.stack([p.mean(axis=0) for p in parts])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        c = c.astype(np.float32)
        degree = min(plan.degree, len(c) - 1)
        graph = np.zeros((len(c), degree), dtype=np.int32)
        for b in range(0, len(c), 1024):
            s = c[b : b + 1024] @ c.T
            s[np.arange(len(s)), np.arange(b, b + len(s))] = -2
            if degree:
                graph[b : b + 1024] = np.argpartition(-s, degree - 1, axis=1)[:, :degree]
        mass = np.cumsum([len(p) for p in parts]) - 1
        units = (mass * max(1, round(rows / plan.rows_per_unit)) // len(sample)).astype(np.int32)
        entries = np.unique(np.linspace(0, len(c) - 1, min(len(c), max(1, int(plan.entries * len(c) ** 0.5)))).round().astype(np.int32))
        return cls(c, graph, entries, units, plan)

    def search(self, v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the (nearly) nearest centroids, best first: a beam walks the graph from the best of the entries (plan.entries times the root of the number of lists)."""
        c, n = self.centroids, len(self.centroids)
        beam = min(n, max(self.plan.beam, wanted))
        ids = np.empty((len(v), min(wanted, n)), dtype=np.int32)
        sims = np.empty(ids.shape, dtype=np.float32)
        for b in range(0, len(v), 512):
            q = v[b : b + 512]
            s = q @ c[self.entries].T
            take = np.argpartition(-s, min(beam, s.shape[1]) - 1, axis=1)[:, :beam]
            node, best = self.entries[take], np.take_along_axis(s, take, axis=1)
            done = np.zeros(node.shape, dtype=bool)
            seen = np.zeros((len(q), n), dtype=bool)
            seen[:, self.entries] = True
            while not done.all() and self.graph.shape[1]:
                r, at = np.nonzero(~done)
                done[:] = True
                key = (r[:, None] * n + self.graph[node[r, at]]).ravel()
                key = np.unique(key[~seen.ravel()[key]])
                if not len(key):
                    break
                seen.ravel()[key] = True
                r, fresh = key // n, (key % n).astype(np.int32)
                value = np.einsum("ij,ij->i", q[r], c[fresh])
                start = np.searchsorted(r, np.arange(len(q)))
                place = np.arange(len(r)) - start[r]
                wide = np.full((len(q), int(place.max()) + 1), -2, dtype=np.float32)
                wide_node = np.zeros(wide.shape, dtype=np.int32)
                wide[r, place], wide_node[r, place] = value, fresh
                best, node = np.concatenate([best, wide], axis=1), np.concatenate([node, wide_node], axis=1)
                done = np.concatenate([done, wide <= -2], axis=1)
                if best.shape[1] > beam:
                    keep = np.argpartition(-best, beam - 1, axis=1)[:, :beam]
                    best, node, done = (np.take_along_axis(x, keep, axis=1) for x in (best, node, done))
            order = np.argsort(-best, axis=1, kind="stable")[:, : ids.shape[1]]
            got = order.shape[1]
            ids[b : b + 512, :got], sims[b : b + 512, :got] = np.take_along_axis(node, order, axis=1), np.take_along_axis(best, order, axis=1)
            ids[b : b + 512, got:], sims[b : b + 512, got:] = 0, -2
        return ids, sims


def valid_vectors(df: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """id, vec (dim float32 of unit length, as bytes). Null, wrong-length, zero, NaN or infinite vectors and null ids are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lists = b.column(0), b.column(1)
            ok = np.asarray(lists.value_lengths().fill_null(0)) == dim
            flat = lists.filter(pa.array(ok)).flatten()
            x = np.asarray(flat.fill_null(np.nan), dtype=np.float64).reshape(-1, dim)
            size = np.linalg.norm(x, axis=1)
            good = np.isfinite(size) & (size > 0)
            unit = (x[good] / size[good, None]).astype(np.float32) + np.float32(0)
            data = pa.Array.from_buffers(pa.binary(dim * 4), len(unit), [None, pa.py_buffer(np.ascontiguousarray(unit))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(ok)).filter(pa.array(good)), data], names=["id", "vec"])

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).where("id is not null and v is not null")
    return spread(src).mapInArrow(run, "id long, vec binary").dropDuplicates(["id", "vec"])


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(-1, dim)


def _spread(index: ListIndex, dim: int):
    """A row for every unit in which a vector is stored or searched, with the lists there (stored first, then all searched)."""
    p = index.plan

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, sims = index.search(_matrix(b.column(1), dim), p.probes)
            dist = np.sqrt(np.maximum(0, 2 - 2 * sims))
            probed = (dist <= dist[:, :1] * p.probe_ratio + 1e-6) & (sims > -2)
            stored = probed & (dist <= dist[:, :1] * p.copy_ratio + 1e-6)
            stored[:, p.copies :] = False
            row, col = np.nonzero(probed)
            lst = ids[row, col]
            unit = index.units[lst]
            order = np.lexsort((col, unit, row))
            row, unit, code = row[order], unit[order], (lst * 2 + stored[row, col])[order].astype(np.int32)
            at = np.flatnonzero(np.diff(row.astype(np.int64) * (int(index.units.max()) + 1) + unit, prepend=-1))
            offsets = pa.array(np.append(at, len(row)).astype(np.int32))
            take = pa.array(row[at])
            yield pa.RecordBatch.from_arrays([pa.array(unit[at]), b.column(0).take(take), b.column(1).take(take), pa.ListArray.from_arrays(offsets, pa.array(code))], names=["unit", "id", "vec", "lists"])

    return run


def _search_unit(k: int, least: float, dim: int):
    """Within a unit, the k best of each vector over the lists in which it is searched."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids, v = t["id"].to_numpy(), _matrix(t["vec"], dim)
        lists = t["lists"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        code = np.asarray(lists.flatten())
        who = np.repeat(np.arange(len(ids)), np.asarray(lists.value_lengths()))
        order = np.argsort(code >> 1, kind="stable")
        code, who = code[order], who[order]
        cuts = np.append(np.flatnonzero(np.diff(code >> 1, prepend=-1)), len(code))
        found = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            asks, items = who[a:b], who[a:b][(code[a:b] & 1) == 1]
            if not len(items):
                continue
            x = v[items].T
            for u in range(0, len(asks), 1024):
                q = asks[u : u + 1024]
                s = v[q] @ x
                s[q[:, None] == items[None]] = -2
                if k < s.shape[1]:
                    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                    edge = np.take_along_axis(s, top, axis=1).min(axis=1)
                    r, c = np.nonzero(s >= np.maximum(edge, max(least, -1.5))[:, None])  # ties at the edge stay
                else:
                    r, c = np.nonzero(s >= max(least, -1.5))
                found.append((ids[q[r]], ids[items[c]], s[r, c]))
        a, b, s = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))
        order = np.lexsort((b, -s, a))
        a, b, s = a[order], b[order], s[order]
        if len(a):
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            a, b, s = a[new], b[new], s[new]
            at = np.flatnonzero(np.diff(a, prepend=a[0] - 1))
            rank = np.arange(len(a)) - np.repeat(at, np.diff(np.append(at, len(a))))
            a, b, s = a[rank < k], b[rank < k], s[rank < k]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "cosine": pa.array(s.astype(np.float64))})

    return run


def nearest_vectors(df: DataFrame, id_col: str, vector_col: str, k: int = 5, dim: int = 64, least_cosine: float = -1.0, plan: ListPlan = ListPlan()) -> DataFrame:
    """a, b, cosine, rank: for every valid vector a its k most similar others b (approximate), those under least_cosine left out.

    Equal vectors are one entry of the index; each stands for its k + 1 least ids. Ties go to the smaller id. The lists are fitted on
    a bounded sample and cover all rows; a list's share of the sample is bounded, so dense regions get more lists and no unit
    grows with one region. Rows repeated with the same id and vector count once; an empty table gives an empty table; null,
    wrong-length, zero, NaN and infinite vectors take no part. Other columns are not read.
    """
    spark = df.sparkSession
    vectors = materialize(valid_vectors(df, id_col, vector_col, dim), "vectors")
    classes = vectors.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    rows = vectors.count()
    wanted = min(plan.most_sampled, plan.per_list * max(1, min(plan.most_lists, rows // plan.rows_per_list)))
    share = min(1.0, 1.1 * wanted / max(rows, 1))
    drawn = vectors.where(F.pmod(F.xxhash64("vec"), F.lit(1_000_000)) < F.lit(max(1, int(share * 1_000_000)))).select("vec").distinct().toArrow()
    if not drawn.num_rows:
        if not rows:
            return spark.createDataFrame([], "a long, b long, cosine double, rank int")
        drawn = vectors.groupBy().agg(F.min("vec").alias("vec")).toArrow()
    sample = pa.table({"vec": pa.array(sorted(drawn["vec"].to_pylist())[: plan.most_sampled])})  # in their own order: the index follows from the rows alone
    index = ListIndex.fit(_matrix(sample["vec"], dim), rows, plan)
    spread = classes.select("id", "vec").mapInArrow(_spread(index, dim), "unit int, id long, vec binary, lists array<int>")
    found = spread.groupBy("unit").applyInArrow(_search_unit(k, least_cosine, dim), "a long, b long, cosine double")
    best = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    top = found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")
    several = classes.where("copies > 1").select(F.col("id").alias("class"), "vec")
    member = vectors.join(several, "vec").select("class", "id")
    first = Window.partitionBy("class").orderBy("id")
    firsts = member.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).select("class", "id")
    firsts = materialize(firsts, "firsts")
    own = firsts.select(F.col("class").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("cosine"))
    wide = top.join(firsts.select(F.col("class").alias("b"), F.col("id").alias("other")), "b", "left").select("a", F.coalesce("other", "b").alias("b"), "cosine")
    kept = wide.union(own).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    to_all = kept.join(member.select(F.col("class").alias("a"), F.col("id").alias("copy")), "a", "left").select(F.coalesce("copy", "a").alias("a"), "b", "cosine")
    out = to_all.where("a <> b").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return out.where(F.col("cosine") >= least_cosine).select("a", "b", "cosine", "rank")
