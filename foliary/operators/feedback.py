"""Statistics of user feedback and of what it says about sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rows(feedback: DataFrame, id_col: str = "feedback_id") -> DataFrame:
    """One row for each id: exact repeats count once."""
    return feedback.dropDuplicates([id_col])


def positive() -> Column:
    """Polarity; legacy rows without one are judged by the mean of their three grades, good where none was given."""
    total = F.coalesce("answer_quality", F.lit(0)) + F.coalesce("answer_completeness", F.lit(0)) + F.coalesce("answer_accuracy", F.lit(0))
    return F.coalesce("is_positive", F.when(total > 0, total / 3 >= 3).otherwise(True))


def statistics(feedback: DataFrame) -> DataFrame:
    """level (collection, user, day or all), name, total, positive, negative, satisfaction (per cent, one place): all four groupings in one pass."""
    rows = feedback.select(F.col("collection_name").alias("c"), F.coalesce("user_name", F.lit("")).alias("u"), F.to_date("created_at").alias("d"), positive().cast("int").alias("p"))
    spark, view = feedback.sparkSession, "_feedback_rows"
    rows.createOrReplaceTempView(view)
    out = spark.sql(f"""
        select case when grouping(c) = 0 then 'collection' when grouping(u) = 0 then 'user' when grouping(d) = 0 then 'day' else 'all' end as level,
               case when grouping(c) = 0 then c when grouping(u) = 0 then u when grouping(d) = 0 then cast(d as string) else '' end as name,
               count(*) as total, sum(p) as positive, count(*) - sum(p) as negative, round(100.0D * sum(p) / count(*), 1) as satisfaction
        from {view} group by grouping sets ((c), (u), (d), ())""")
    return out


def trends(feedback: DataFrame, now: Column | None = None, days: int = 30) -> DataFrame:
    """day, total, positive, rate (per cent) of the last days before now (the latest row, unless given)."""
    last = feedback.agg(F.max("created_at")).first()[0] if now is None else None
    start = (F.lit(last) if now is None else now) - F.expr(f"interval {days} days")
    rows = feedback.where(F.col("created_at") >= start)
    return rows.groupBy(F.to_date("created_at").cast("string").alias("day")).agg(
        F.count("*").alias("total"), F.sum(positive().cast("int")).alias("positive"), F.round(100.0 * F.sum(positive().cast("int")) / F.count("*"), 1).alias("rate")
    )


def relevance(feedback: DataFrame, key: str = "source_file") -> DataFrame:
    """key, votes, mean (of grades above 0, two places), boost ((mean - 3) / 10, three places)."""
    rows = feedback.select(F.explode("sources_feedback").alias("s")).select(F.col(f"s.{key}").alias(key), F.col("s.relevance_score").alias("g")).where(f"g > 0 and {key} is not null")
    return rows.groupBy(key).agg(F.count("*").alias("votes"), F.round(F.avg("g"), 2).alias("mean"), F.round((F.avg("g") - 3) / 10, 3).alias("boost"))


def question_tokens(question: str = "question") -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(F.col(question), F.lit(""))), F.lit(r"[a-zàâäéèêëïîôùûüç0-9]+"), 0)
    return F.array_distinct(F.filter(found, lambda w: F.length(w) >= 3))


def similar_questions(asked: DataFrame, known: DataFrame, least: float = 0.6, most: int | None = 5) -> DataFrame:
    """query_id, other_id, similarity, rank: Jaccard of token sets at least `least`, best first, ties by id.

    asked: query_id, question; known: other_id, question. Equal token sets are one candidate each on either side, and only sets that
    share one of their rarest tokens meet (a set of n tokens must share one of its n - ceil(least * n) + 1 rarest with any set that near),
    so common words pair nothing.
    """
    a = asked.select("query_id", question_tokens().alias("t")).where(F.size("t") > 0)
    b = known.select("other_id", question_tokens().alias("t")).where(F.size("t") > 0)
    ka, kb = (x.select(F.array_sort("t").alias("t")).distinct().withColumn("h", F.xxhash64("t")) for x in (a, b))
    df = kb.select(F.explode("t").alias("w")).groupBy("w").agg(F.count("*").alias("n"))

    def rare(x):
        rows = x.select("h", F.size("t").alias("size"), F.explode("t").alias("w")).join(df, "w", "left")
        place = F.row_number().over(Window.partitionBy("h").orderBy(F.coalesce("n", F.lit(0)), "w"))
        return rows.withColumn("place", place).where(F.col("place") <= F.col("size") - F.ceil(F.lit(least) * F.col("size")) + 1).select("h", "w")

    met = rare(ka).withColumnRenamed("h", "ha").join(rare(kb).withColumnRenamed("h", "hb"), "w").select("ha", "hb").distinct()
    met = met.join(ka.select(F.col("h").alias("ha"), F.col("t").alias("ta")), "ha").join(kb.select(F.col("h").alias("hb"), F.col("t").alias("tb")), "hb")
    met = met.withColumn("similarity", F.size(F.array_intersect("ta", "tb")) / F.size(F.array_union("ta", "tb"))).where(F.col("similarity") >= least)
    out = a.withColumn("ha", F.xxhash64(F.array_sort("t"))).join(met.select("ha", "hb", "similarity"), "ha")
    out = out.join(b.withColumn("hb", F.xxhash64(F.array_sort("t"))).select("other_id", "hb"), "hb").where("query_id <> other_id")
    out = out.select("query_id", "other_id", F.round("similarity", 3).alias("similarity"))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "other_id")
    out = out.withColumn("rank", F.row_number().over(w) - 1)
    return out if most is None else out.where(F.col("rank") < most)


def rerank_boosts(similar: DataFrame, feedback: DataFrame, step: float = 0.1, most: int = 3) -> DataFrame:
    """query_id, boost: the similar questions' polarity, each times its similarity and `step`, over the nearest three."""
    f = feedback.select(F.col("feedback_id").alias("other_id"), positive().alias("good"))
    rows = similar.where(F.col("rank") < most).join(f, "other_id")
    return rows.groupBy("query_id").agg(F.round(F.sum(F.when(F.col("good"), step).otherwise(-step) * F.col("similarity")), 6).alias("boost"))


def export_rows(feedback: DataFrame) -> DataFrame:
    """Rows for a semicolon-separated export: polarity resolved and shown as a thumb; line ends in texts made spaces."""
    flat = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n;]+", " ")
    return feedback.select(
        "feedback_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"), F.coalesce("user_name", F.lit("")).alias("user_name"), "collection_name",
        flat("question").alias("question"), F.when(positive(), "👍").otherwise("👎").alias("rating"), flat("suggested_answer").alias("suggested"),
    )


def export_csv(feedback: DataFrame, path: str) -> None:
    export_rows(feedback).write.mode("overwrite").option("sep", ";").option("header", "true").csv(path)


def append(feedback: DataFrame, path: str) -> None:
    feedback.write.mode("append").parquet(path)


def without(feedback: DataFrame, ids: DataFrame) -> DataFrame:
    """feedback less the rows whose feedback_id is listed."""
    return feedback.join(ids.select("feedback_id").distinct(), "feedback_id", "left_anti")
