"""The semantic answer cache as a table: lookup, expiry, eviction, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliary.functions import vectors as V
from foliary.operators.search import dense_top_k, ranked


def alive(entries: DataFrame, now: float) -> DataFrame:
    """Entries whose time to live (an hour where none is given) has not passed."""
    return entries.where(F.lit(now) - F.col("created_epoch") <= F.coalesce("ttl", F.lit(3600.0)))


def lookup(questions: DataFrame, entries: DataFrame, now: float | None = None, least: float = 0.95, most: int = 1) -> DataFrame:
    """query_id, entry_id, similarity: the `most` nearest entries of the question's collection, if their cosine is at least `least`.

    questions: query_id, collection_name, embedding; entries: entry_id, collection_name, question_embedding and, with now, created_epoch and
    ttl. Vectors are brought to unit length; unusable ones (null, wrong length, zero, not finite) take no part. One search serves all collections; a question meets the entries of its own only.
    """
    e = entries if now is None else alive(entries, now)
    dim = 64
    e = e.where(V.usable("question_embedding", dim)).select(F.col("entry_id").alias("chunk_id"), "collection_name", V.normalised("question_embedding").alias("embedding"))
    q = questions.where(V.usable("embedding", dim)).select("query_id", "collection_name", V.normalised("embedding").alias("embedding"))
    near = dense_top_k(q, e, most, by=["collection_name"], within=True)
    return near.select("query_id", F.col("chunk_id").alias("entry_id"), F.round(1 - F.col("distance") / 2, 6).alias("similarity")).where(F.col("similarity") >= least)


def evict(entries: DataFrame, now: float, share: float = 0.1) -> DataFrame:
    """entry_id, worth of the share of entries with the fewest hits for their age, which leave first."""
    age = F.greatest(F.lit(0.0), F.lit(now) - F.col("created_epoch"))
    worth = F.round(F.col("hit_count") / (age + 1), 12)
    rows = entries.select("entry_id", worth.alias("worth"))
    near = 1e-3  # a bracket around the cut: what is below it leaves unsorted, only what is within is put in order
    lo, hi, n = rows.agg(F.percentile_approx("worth", max(0.0, share - near), 10_000), F.percentile_approx("worth", min(1.0, share + near), 10_000), F.count("*")).first()
    if not int(n * share):
        return rows.limit(0)
    below = rows.where((F.col("worth") < lo) | F.col("worth").isNull())
    rest = rows.where((F.col("worth") >= lo) & (F.col("worth") <= hi)).orderBy("worth", "entry_id").limit(max(0, int(n * share) - below.count()))
    return below.union(rest)


def invalidate(entries: DataFrame, collection: str | None = None) -> DataFrame:
    """The entries that stay when those of a collection, or (None) all, are dropped."""
    return entries.limit(0) if collection is None else entries.where(~F.col("collection_name").eqNullSafe(collection))


def event_statistics(events: DataFrame) -> DataFrame:
    """hits, misses, evictions, hit_rate (three places) of a log of cache events (event: hit, miss or evict)."""
    n = {k: F.count(F.when(F.col("event") == e, 1)) for k, e in (("hits", "hit"), ("misses", "miss"), ("evictions", "evict"))}
    rate = F.when(n["hits"] + n["misses"] > 0, F.round(n["hits"] / (n["hits"] + n["misses"]), 3)).otherwise(0.0)
    return events.agg(*[c.alias(k) for k, c in n.items()], rate.alias("hit_rate"))


def statistics(entries: DataFrame, now: float) -> DataFrame:
    """collection_name, entries, hits, expired."""
    gone = (F.lit(now) - F.col("created_epoch") > F.coalesce("ttl", F.lit(3600.0))).cast("int")
    return entries.groupBy("collection_name").agg(F.count("*").alias("entries"), F.sum("hit_count").alias("hits"), F.sum(gone).alias("expired"))


def put(entries: DataFrame, new: DataFrame, least: float = 0.95) -> DataFrame:
    """entries with the new ones: a new entry takes the place of the nearest old one of its collection that is at least that near
    (keeping its hits); of several new ones for one place the latest stays."""
    q = new.select(F.col("entry_id").alias("query_id"), "collection_name", F.col("question_embedding").alias("embedding"))
    hit = lookup(q, entries, least=least).select(F.col("query_id").alias("new_id"), F.col("entry_id").alias("old_id"))
    placed = new.join(hit, new["entry_id"] == hit["new_id"], "left").drop("new_id")
    w = Window.partitionBy(F.coalesce("old_id", F.col("entry_id"))).orderBy(F.desc("created_epoch"), F.desc("entry_id"))
    placed = placed.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")
    hits = entries.select(F.col("entry_id").alias("old_id"), F.col("hit_count").alias("old_hits"))
    placed = placed.join(hits, "old_id", "left").withColumn("hit_count", F.coalesce("old_hits", F.col("hit_count"))).drop("old_hits")
    kept = entries.join(placed.where("old_id is not null").select(F.col("old_id").alias("entry_id")), "entry_id", "left_anti")
    return kept.unionByName(placed.select(*entries.columns))


def top_hits(entries: DataFrame, k: int = 10) -> DataFrame:
    return ranked(entries.select("collection_name", "entry_id", "hit_count"), ["collection_name"], [F.desc("hit_count"), F.col("entry_id")], k)
