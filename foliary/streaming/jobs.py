"""Structured Streaming: incremental ingestion, daily trends, and a cache with a time to live."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StructField, StructType


def ingest_stream(spark: SparkSession, folder: str, schema: StructType, store: str, ledger: str, checkpoint: str, key: str = "path"):
    """Append what arrives as parquet in a folder to a store, once for each (collection_name, key): what the ledger has is left out.

    A batch that runs again after a failure writes the folders of its own batch number anew, so nothing is stored twice.
    """

    def load(batch: DataFrame, number: int) -> None:
        norm = batch.withColumn("_k", F.regexp_replace(key, "/+", "/")).dropDuplicates(["collection_name", "_k"])
        try:
            done = spark.read.parquet(ledger).where(F.col("batch") < number).select("collection_name", "_k").distinct()
            norm = norm.join(done, ["collection_name", "_k"], "left_anti")
        except Exception as e:  # no ledger yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        norm = norm.persist()
        norm.drop("_k").write.mode("overwrite").parquet(f"{store}/batch={number}")
        norm.select("collection_name", "_k").write.mode("overwrite").parquet(f"{ledger}/batch={number}")
        norm.unpersist()

    return spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)


def trend_stream(feedback: DataFrame, late: str = "2 days") -> DataFrame:
    """window, total, positive by day of created_at; rows later than `late` are left out."""
    good = F.coalesce(F.col("is_positive"), F.lit(True)).cast("int")
    rows = feedback.withColumn("ts", F.col("created_at").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("total"), F.sum(good).alias("positive")).select(F.col("w.start").cast("date").alias("day"), "total", "positive")


class CacheState(StatefulProcessor):
    """Per collection and question: hits since the entry was put, forgotten after its time to live."""

    def __init__(self, ttl_ms: int = 3_600_000):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hits = handle.getValueState("hits", StructType([StructField("n", LongType()), StructField("since", DoubleType())]), self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self.hits.get() if self.hits.exists() else None
        seen = pd.concat(list(rows))
        n, since = (old[0], old[1]) if old else (-1, float(seen["created_epoch"].min()))
        n += len(seen)
        self.hits.update((n, since))
        yield pd.DataFrame({"collection_name": [key[0]], "question": [key[1]], "hits": [n]})

    def close(self) -> None:
        pass


def cache_stream(requests: DataFrame, ttl_ms: int = 3_600_000) -> DataFrame:
    """collection_name, question, hits: requests for the same question within the time to live count as hits of one entry."""
    return requests.groupBy("collection_name", "question").transformWithStateInPandas(
        statefulProcessor=CacheState(ttl_ms), outputStructType="collection_name string, question string, hits long", outputMode="Update", timeMode="ProcessingTime"
    )
