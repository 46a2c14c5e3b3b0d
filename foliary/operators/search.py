"""Dense, lexical and fused retrieval. Questions are tables, so one plan serves one question or many."""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliary.functions import text as T
from foliary.session import files, materialize, scratch_path, spread

RRF_K = 60


def ranked(df: DataFrame, by: list[str], order: list[Column], k: int | None = None, name: str = "rank") -> DataFrame:
    """0-based rank within `by`; with k, only the first k (pruned before the exchange)."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    return out if k is None else out.where(F.col(name) < k)


def _group_codes(columns: list[pa.Array]) -> tuple[np.ndarray, list[tuple]]:
    """A number for each row's group, and the groups: each column is encoded once, no row is looked at by itself."""
    code, names = np.zeros(len(columns[0]), np.int64), [()]
    for c in columns:
        d = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).dictionary_encode(null_encoding="encode")
        values = d.dictionary.to_pylist()
        both, inverse = np.unique(code * len(values) + d.indices.to_numpy(zero_copy_only=False), return_inverse=True)
        names = [names[x // len(values)] + (values[x % len(values)],) for x in both.tolist()]
        code = inverse
    return code, names


def _block_search(ids: list, queries: np.ndarray, k: int, by: int, own: list | None = None, block: int = 4096):
    """Per Arrow batch and group, the rows that can be among the k nearest of each question; with own, of the questions of that group only."""
    lengths = (queries * queries).sum(axis=1)
    of_group: dict = {}
    for i, g in enumerate(own or ()):
        of_group.setdefault(g, []).append(i)
    of_group = {g: np.array(v) for g, v in of_group.items()}
    names, everyone = pa.array(ids), np.arange(len(queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            ok = np.flatnonzero(np.asarray(lists.value_lengths().fill_null(0)) == queries.shape[1])
            x = np.asarray(lists.take(pa.array(ok)).flatten().fill_null(np.nan), dtype=np.float64).reshape(-1, queries.shape[1])
            sound = np.isfinite(x).all(axis=1)
            x, ok = x[sound], ok[sound]
            if not len(ok):
                continue
            code, groups = _group_codes([b.column(2 + c).take(pa.array(ok)) for c in range(by)]) if by else (np.zeros(len(ok), np.int64), [()])
            order = np.argsort(code, kind="stable")
            cuts = np.searchsorted(code[order], np.arange(len(groups) + 1))
            for g, lo, hi in zip(groups, cuts[:-1], cuts[1:]):
                rows = order[lo:hi]
                asks = everyone if own is None else of_group.get(g[0], everyone[:0])
                for u in range(0, len(asks), block):
                    some = asks[u : u + block]
                    d = np.maximum(0.0, (x[rows] ** 2).sum(axis=1)[None] + lengths[some, None] - 2 * queries[some] @ x[rows].T)
                    edge = np.partition(d, k - 1, axis=1)[:, k - 1] if k < d.shape[1] else np.full(len(d), np.inf)
                    q, r = np.nonzero(d <= edge[:, None] + 1e-9)
                    take = pa.array(ok[rows[r]])
                    yield pa.RecordBatch.from_arrays(
                        [names.take(pa.array(some[q])), b.column(0).take(take), *(b.column(2 + c).take(take) for c in range(by)), pa.array(d[q, r])],
                        names=["query_id", "chunk_id", *(f"g{c}" for c in range(by)), "distance"],
                    )

    return run


def dense_top_k(questions: DataFrame, corpus: DataFrame, k: int = 10, by: list[str] | None = None, per_pass: int = 131_072, within: bool = False) -> DataFrame:
    """query_id, chunk_id, distance (squared L2), rank: the k nearest of every question (for each value of the corpus columns `by`).

    questions: query_id, embedding; corpus: chunk_id, embedding and the `by` columns. With within, questions have the (one) `by` column
    too and meet the rows of their own value only. Ties (to nine places) go to the smaller chunk_id. Null vectors, vectors with holes or
    of another length than the questions' take no part. One pass over the corpus serves up to per_pass questions (of 64 numbers: 64 MB,
    what is sent to the executors at once), taken in blocks within a task; a task sends few rows a question on.
    """
    by = by or []
    kinds = dict(corpus.dtypes)
    own = by[:1] if within else []
    asked = questions.where("embedding is not null and query_id is not null").select("query_id", "embedding", *own)
    kind = dict(questions.dtypes)["query_id"]
    shape = f"query_id {kind}, chunk_id {kinds['chunk_id']}, " + "".join(f"g{i} {kinds[c]}, " for i, c in enumerate(by)) + "distance double"
    n_asked = asked.count()
    passes, out = -(-n_asked * 5 // (4 * per_pass)) if n_asked > per_pass else 1, None
    for n in range(passes):
        rows = (asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == n) if passes > 1 else asked).collect()
        if not rows:
            continue
        dim = len(rows[0].embedding)
        rows = [r for r in rows if len(r.embedding) == dim and None not in r.embedding]
        run = _block_search([r.query_id for r in rows], np.array([r.embedding for r in rows], dtype=np.float64), k, len(by), [r[2] for r in rows] if own else None)
        part = corpus.where("embedding is not null and chunk_id is not null").select("chunk_id", F.col("embedding").cast("array<float>"), *by).mapInArrow(run, shape)
        out = part if out is None else out.union(part)
    if out is None:
        return questions.sparkSession.createDataFrame([], shape + ", rank int").withColumnsRenamed({f"g{i}": c for i, c in enumerate(by)})
    out = out.withColumnsRenamed({f"g{i}": c for i, c in enumerate(by)}).withColumn("distance", F.round("distance", 9))
    return ranked(out, ["query_id", *by], [F.col("distance"), F.col("chunk_id")], k)


class LexicalIndex:
    """A persisted BM25 index: a row for each text with its terms and their counts, the document frequencies, and a manifest.

    The index is parted by texts, not by terms: a task holds whole texts, so it sums their scores by itself and sends on only what can be
    among the best, and a frequent term is spread over all tasks. stale() compares the number of texts and the latest version (a column of
    the corpus, if given) with what was indexed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        held = files.read(spark, f"{self.path}/manifest.json")
        self.manifest = json.loads(held) if held is not None else None

    @staticmethod
    def _state(corpus: DataFrame, version: str | None) -> dict:
        r = corpus.agg(F.count("*"), F.max(version).cast("string") if version else F.lit(None)).first()
        return {"rows": r[0], "version": r[1]}

    def build(self, corpus: DataFrame, id_col: str = "chunk_id", text_col: str = "text", version: str | None = None) -> LexicalIndex:
        """Index a corpus, in place of what was there. Texts without tokens count in the averages; null ids are left out."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                each = [Counter(t or ()) for t in b.column(1).to_pylist()]
                kinds = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32())]
                cols = [[sum(c.values()) for c in each], [list(c) for c in each], [list(c.values()) for c in each]]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["chunk_id", "len", "terms", "tfs"])

        rows = corpus.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("chunk_id"), T.index_tokens(text_col).alias("tokens"))
        run = f"{self.path}/{uuid.uuid4().hex}"
        made = spread(rows).mapInArrow(count, f"chunk_id {dict(corpus.dtypes)[id_col]}, len long, terms array<string>, tfs array<int>")
        made.write.option("compression", "zstd").parquet(f"{run}/texts")
        texts = self.spark.read.parquet(f"{run}/texts")
        texts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).write.parquet(f"{run}/terms")
        n, mean = texts.agg(F.count("*"), F.avg("len")).first()
        self.manifest = {"run": run, "n_docs": n, "avg_len": mean} | self._state(corpus, version)
        files.replace(self.spark, f"{self.path}/manifest.json", json.dumps(self.manifest))
        return self

    def stale(self, corpus: DataFrame, version: str | None = None) -> bool:
        """Whether the corpus has another number of rows, or a later version, than what was indexed; also where nothing was."""
        return self.manifest is None or any(self.manifest[k] != v for k, v in self._state(corpus, version).items())

    def fresh(self, corpus: DataFrame, id_col: str = "chunk_id", text_col: str = "text", version: str | None = None) -> LexicalIndex:
        """The index, built anew if it is stale."""
        return self.build(corpus, id_col, text_col, version) if self.stale(corpus, version) else self

    def texts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.manifest['run']}/texts")

    def terms(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.manifest['run']}/terms")

    def search(self, questions: DataFrame, k: int = 30, k1: float = 1.5, b: float = 0.75, per_pass: int = 16_384, block: int = 256) -> DataFrame:
        """query_id, chunk_id, score, rank of texts with a positive score; question tokens count as often as they occur.

        questions: query_id, question. Ties go to the smaller chunk_id. One pass over the index serves up to per_pass questions, whose terms
        (not the index's) are sent to the executors; a task scores a batch of texts against a block of questions as one product of matrices.
        """
        n, mean = float(self.manifest["n_docs"]), float(self.manifest["avg_len"] or 1.0) or 1.0
        asked = questions.select("query_id", F.explode(T.index_tokens("question")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
        idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        weights = materialize(asked.join(self.terms(), "term").select("query_id", "term", (F.col("qtf") * idf).alias("w")), "weights")
        kinds = dict(questions.dtypes)["query_id"], dict(self.texts().dtypes)["chunk_id"]
        passes, out = max(1, -(-weights.select("query_id").distinct().count() // per_pass)), None
        for p in range(passes):
            held = (weights.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p) if passes > 1 else weights).toArrow()
            if not held.num_rows:
                continue
            part = self.texts().mapInArrow(_score_block(held, k, k1, b, mean, block), f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double")
            out = part if out is None else out.union(part)
        if out is None:
            return self.spark.createDataFrame([], f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double, rank int")
        return ranked(out.withColumn("score", F.round("score", 9)), ["query_id"], [F.desc("score"), F.col("chunk_id")], k)


def _score_block(weights: pa.Table, k: int, k1: float, b: float, mean: float, block: int):
    """Scores of batches of texts for the questions of `weights` (query_id, term, w), the k best of each batch."""
    qid = weights["query_id"].combine_chunks().dictionary_encode()
    term = weights["term"].combine_chunks().dictionary_encode()
    who, what, w = qid.indices.to_numpy(), term.indices.to_numpy(), weights["w"].to_numpy()
    order = np.argsort(who, kind="stable")
    who, what, w = who[order], what[order], w[order]
    names, known = qid.dictionary, term.dictionary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            at = pc.index_in(lists.flatten(), value_set=known)
            kept = np.flatnonzero(np.asarray(at.is_valid()))
            if not len(kept):
                continue
            t = at.take(pa.array(kept)).to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()))[kept]
            tf = batch.column(3).flatten().to_numpy()[kept].astype(np.float64)
            size = batch.column(1).to_numpy()[row]
            value = tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / mean))
            for u in range(0, len(names), block):
                lo, hi = np.searchsorted(who, [u, u + block])
                used, local = np.unique(what[lo:hi], return_inverse=True)
                place = np.full(len(known), -1)
                place[used] = np.arange(len(used))
                mine = np.flatnonzero(place[t] >= 0)
                rows, r = np.unique(row[mine], return_inverse=True)
                if not len(rows):
                    continue
                q_side = np.zeros((min(block, len(names) - u), len(used)))
                q_side[who[lo:hi] - u, local] = w[lo:hi]
                for v in range(0, len(rows), 4096):  # texts of a batch in bounded parts
                    here = mine[(r >= v) & (r < v + 4096)]
                    d_side = np.zeros((len(used), min(4096, len(rows) - v)))
                    d_side[place[t[here]], r[(r >= v) & (r < v + 4096)] - v] = value[here]
                    s = q_side @ d_side
                    edge = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if k < s.shape[1] else np.full(len(s), 0.0)
                    q, c = np.nonzero((s >= edge[:, None] - 1e-9) & (s > 0))
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(u + q)), batch.column(0).take(pa.array(rows[v + c])), pa.array(s[q, c])], names=["query_id", "chunk_id", "score"])

    return run


def postings(corpus: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """term, chunk_id, tf, len: the inverted index. Texts without tokens have a row with a null term, so that they count in the averages."""
    # tokens and their number in one expression, so that they are made once
    both = F.transform(F.array(T.index_tokens(text_col)), lambda t: F.when(F.size(t) == 0, F.array(F.struct(F.lit(0).alias("len"), F.lit(None).cast("string").alias("term")))).otherwise(F.transform(t, lambda w: F.struct(F.size(t).alias("len"), w.alias("term")))))
    rows = corpus.select(F.col(id_col).alias("chunk_id"), F.explode(F.element_at(both, 1)).alias("x")).select("chunk_id", "x.term", F.col("x.len").cast("long").alias("len"))
    return rows.groupBy("chunk_id", "term").agg(F.count("term").alias("tf"), F.max("len").alias("len"))


def lexical_statistics(index: DataFrame) -> DataFrame:
    """n_docs, avg_len: one row."""
    each = index.groupBy("chunk_id").agg(F.max("len").alias("len"))
    return each.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))


def document_frequencies(index: DataFrame) -> DataFrame:
    return index.where("term is not null").groupBy("term").agg(F.count("*").alias("df"))


def bm25(questions: DataFrame, index: DataFrame, k: int | None = 30, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query_id, chunk_id, score, rank of texts with a positive score; question tokens count as often as they occur.

    questions: query_id, question. Ties go to the smaller chunk_id. The index is joined on terms only, so only postings of asked
    terms are read on; scores are summed before the exchange.
    """
    asked = questions.select("query_id", F.explode(T.index_tokens("question")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    stats = lexical_statistics(index).first()  # two numbers
    n, mean = float(stats.n_docs), float(stats.avg_len or 1.0) or 1.0
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    terms = asked.join(document_frequencies(index), "term").select("query_id", "term", (F.col("qtf") * idf).alias("w"))
    part = F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(mean)))
    met = spread(index.where("term is not null")).join(terms, "term").groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score")).where("score > 0")
    met = met.withColumn("score", F.round("score", 9))
    return ranked(met, ["query_id"], [F.desc("score"), F.col("chunk_id")], k)


def fuse(dense: DataFrame, sparse: DataFrame, k: int = 10, dense_weight: float = 0.8, sparse_weight: float = 0.2, both: float = 1.1, weights: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, rrf, distance, rank: reciprocal rank fusion of 0-based ranks, favouring what both lists hold.

    Both lists come as (query_id, chunk_id, rank); one grouping joins them. weights: query_id, dense_weight, sparse_weight of each question
    in place of the two numbers. distance is 1 - rrf / largest rrf of the question.
    """
    rows = dense.select("query_id", "chunk_id", F.col("rank").alias("d"), F.lit(None).cast("int").alias("s")).union(sparse.select("query_id", "chunk_id", F.lit(None).cast("int"), F.col("rank")))
    met = rows.groupBy("query_id", "chunk_id").agg(F.min("d").alias("d"), F.min("s").alias("s"))
    if weights is not None:
        met, dense_weight, sparse_weight = met.join(weights, "query_id"), F.col("dense_weight"), F.col("sparse_weight")
    base = F.coalesce(dense_weight / (RRF_K + F.col("d")), F.lit(0.0)) + F.coalesce(sparse_weight / (RRF_K + F.col("s")), F.lit(0.0))
    rrf = F.round(base * F.when(F.col("d").isNotNull() & F.col("s").isNotNull(), both).otherwise(1.0), 12)
    out = met.withColumn("rrf", rrf)
    top = F.max("rrf").over(Window.partitionBy("query_id"))
    out = out.withColumn("distance", 1 - F.col("rrf") / F.greatest(top, F.lit(1e-6)))
    order = [F.desc("rrf"), F.coalesce("d", F.lit(1 << 30)), F.coalesce("s", F.lit(1 << 30)), F.col("chunk_id")]
    return ranked(out, ["query_id"], order, k).select("query_id", "chunk_id", "rrf", "distance", "rank")


def hybrid(questions: DataFrame, corpus: DataFrame, k: int = 10, dense_weight: float = 0.8, sparse_weight: float = 0.2) -> DataFrame:
    """Dense and lexical lists of 2k each, fused. questions: query_id, question, embedding; corpus: chunk_id, text, embedding."""
    index = LexicalIndex(corpus.sparkSession, scratch_path(corpus.sparkSession, "lexical")).build(corpus)
    return fuse(dense_top_k(questions, corpus, 2 * k), index.search(questions, 2 * k), k, dense_weight, sparse_weight)


def merge_results(results: DataFrame, most: int, key: Column | None = None) -> DataFrame:
    """Merge result lists of one question's variants: best score, raised by a tenth for each further hit.

    results: query_id, chunk_id, path, text, score. The key is chunk_id, else path, else a digest of the text's beginning.
    """
    key = key if key is not None else F.coalesce(F.col("chunk_id").cast("string"), F.col("path"), F.substring(F.md5(F.substring("text", 1, 100)), 1, 16))
    met = results.withColumn("key", key).groupBy("query_id", "key").agg(F.max("score").alias("best"), F.count("*").alias("hits"))
    met = met.withColumn("score", F.round(F.col("best") * (1 + 0.1 * (F.col("hits") - 1)), 9))
    out = ranked(met, ["query_id"], [F.desc("score"), F.col("key")], most)
    return out.select("query_id", "key", "hits", "score", (1 - F.col("score")).alias("distance"), "rank")


def federated_fuse(results: DataFrame, k: int = 10) -> DataFrame:
    """Merge ranked lists of several collections: key is collection and chunk, score the sum of 1 / (60 + rank).

    results: query_id, collection, chunk_id, rank, distance. Ties go to the collection's name, then the rank.
    """
    met = results.withColumn("key", F.concat_ws("::", "collection", F.col("chunk_id").cast("string"))).groupBy("query_id", "collection", "key").agg(
        F.sum(1 / (RRF_K + F.col("rank"))).alias("rrf"), F.coalesce(F.avg("distance"), F.lit(1.0)).alias("distance"), F.min("rank").alias("first")
    )
    met = met.withColumn("rrf", F.round("rrf", 12))
    return ranked(met, ["query_id"], [F.desc("rrf"), F.col("collection"), F.col("first"), F.col("key")], 2 * k).select("query_id", "collection", "key", "rrf", "distance", "rank")


def min_max(df: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """score scaled to 0..1 within `by`; 1 where all are equal."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn("scaled", F.when(hi == lo, 1.0).otherwise((F.col(score) - lo) / (hi - lo)))


def use_hybrid(corpus: DataFrame, least: int = 500) -> bool:
    """Whether a corpus is large enough for the lexical list to pay (counts at most `least` rows)."""
    return corpus.limit(least).count() >= least
