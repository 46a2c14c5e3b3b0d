"""Rows by id, and stores as partitioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def get_rows(table: DataFrame, ids: DataFrame, key: str, order: str) -> DataFrame:
    """The rows of a list of ids (pos, key) in the list's order; missing ids drop out; of several rows of an id the first by `order`."""
    first = table.join(ids.select(key).distinct(), key, "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
    return ids.join(first, key)


def append_chunks(chunks: DataFrame, path: str, dim: int | None = None) -> None:
    """Append chunks with their vectors, one folder a base and collection; with dim, a vector of another length fails the write."""
    if dim is not None:
        fits = F.assert_true(F.col("embedding").isNull() | (F.size("embedding") == dim), F.lit(f"a vector is not of length {dim}"))
        chunks = chunks.withColumn("_ok", fits).where("_ok is null").drop("_ok")
    chunks.write.mode("append").partitionBy("base_name", "collection_name").parquet(path)


def rebuild_collections(chunks: DataFrame, path: str) -> None:
    """Replace just the collections that occur in chunks."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("base_name", "collection_name").parquet(path)


def delete_collection(spark: SparkSession, path: str, base: str, collection: str) -> int:
    """Drop a collection's folder; the number of rows that were in it."""
    folder = f"{path}/base_name={base}/collection_name={collection}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(folder)
    fs = target.getFileSystem(conf)
    if not fs.exists(target):
        return 0
    n = spark.read.parquet(folder).count()
    fs.delete(target, True)
    return n
