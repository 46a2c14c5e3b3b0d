"""What happens to a ranked list: keyword tests, boosts, reranking, reordering, feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliary.functions import text as T
from foliary.operators.search import ranked


def keyword_filter(sources: DataFrame, keywords: Column, least: int = 1, by: str = "query_id") -> DataFrame:
    """Rows whose text holds at least `least` keywords; all rows of a question if none does, or if it has no keywords.

    Adds keyword_matches and keyword_count."""
    out = sources.withColumn("keyword_matches", T.keyword_matches("text", keywords)).withColumn("keyword_count", F.size(keywords))
    some = F.max(F.col("keyword_matches") >= least).over(Window.partitionBy(by))
    return out.withColumn("_some", some).where((F.col("keyword_matches") >= least) | ~F.col("_some") | (F.col("keyword_count") == 0)).drop("_some")


def keyword_boost(sources: DataFrame, keywords: Column, boost: float = 0.1, by: str = "query_id") -> DataFrame:
    """score raised by boost for each keyword held, at most 1, and ranks anew (stable by the prior rank)."""
    raised = F.least(F.lit(1.0), F.coalesce(F.col("score"), F.lit(0.5)) + boost * T.keyword_matches("text", keywords))
    return ranked(sources.withColumn("score", F.round(raised, 9)).withColumnRenamed("rank", "prior"), [by], [F.desc("score"), F.col("prior")])


def section_boost(sources: DataFrame, entities: Column, factor: float = 0.4, by: str = "query_id") -> DataFrame:
    """Order by distance, that of rows whose section is asked for multiplied by factor; the distance itself stays."""
    hit = T.refs_match(T.section_refs("section_id"), F.transform(entities, lambda e: F.regexp_replace(F.lower(e), r"[\s\-]+", "")))
    out = sources.withColumn("section_hit", hit).withColumnRenamed("rank", "prior")
    order = F.when(F.col("section_hit"), F.col("distance") * factor).otherwise(F.col("distance"))
    return ranked(out.withColumn("_order", order), [by], [F.col("_order"), F.col("prior")]).drop("_order")


def rerank(sources: DataFrame, score: Column | None = None, k: int | None = None, by: str = "query_id") -> DataFrame:
    """Order by a relevance score, best first; without a scorer the order stays and scores fall by a hundredth a place."""
    out = sources.withColumnRenamed("rank", "prior")
    out = out.withColumn("rerank_score", score if score is not None else F.round(1.0 - 0.01 * F.col("prior"), 6))
    return ranked(out, [by], [F.desc("rerank_score"), F.col("prior")], k)


def lost_in_middle(sources: DataFrame, how: str = "alternating", by: str = "query_id") -> DataFrame:
    """position: a new place for each 0-based rank, the best at the ends. Lists of up to three (six for bookends and reverse_middle)
    stay as they are."""
    n, r = F.count("*").over(Window.partitionBy(by)), F.col("rank")
    out = sources.withColumn("_n", n)
    n = F.col("_n")
    if how == "alternating":
        place, least = F.when(r % 2 == 0, r / 2).otherwise(n - (r + 1) / 2), 3
    elif how == "bookends":
        place, least = F.when(r < 3, r).when(r >= n - 3, r - n + 6).otherwise(r + 3), 6
    elif how == "reverse_middle":
        third = F.floor(n / 3)
        place, least = F.when((r >= third) & (r < 2 * third), 3 * third - 1 - r).otherwise(r), 6
    else:
        place, least = r, 0
    return out.withColumn("position", F.when(n <= least, r).otherwise(place).cast("int")).drop("_n")


def feedback_rerank(sources: DataFrame, boosts: DataFrame, alpha: float = 0.3, by: str = "query_id") -> DataFrame:
    """score * (1 + alpha * boost) within 0..1; boosts: query_id, boost (absent means none)."""
    out = sources.join(boosts.select(by, "boost"), by, "left")
    new = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") * (1 + alpha * F.coalesce("boost", F.lit(0.0)))))
    return ranked(out.withColumn("score", F.round(new, 4)).withColumnRenamed("rank", "prior"), [by], [F.desc("score"), F.col("prior")])


def federated_rerank(merged: DataFrame, score: Column | None = None, k: int = 10, by: str = "query_id") -> DataFrame:
    """The k best of a list merged over collections by a relevance score (a column, say a scorer's); without one the merged order stays."""
    return rerank(merged, score, k, by)
