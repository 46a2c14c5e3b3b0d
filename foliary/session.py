"""Sessions and the shared folder in which long jobs keep intermediate tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, name: str = "foliary", memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a session, in case it is not on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_foliary_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="foliary-code-")) / "foliary_package.zip"  # the driver serves it to the executors
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(target))
    sc._foliary_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only where the setting is absent (tests on one machine) is a folder of our own taken.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="foliary-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared one, removed when the driver ends."""
    path = f"{shared_dir(spark)}/foliary-{name}-{uuid.uuid4().hex}"
    atexit.register(remove_path, spark, path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder, if the session still lives."""
    try:
        sc = spark.sparkContext
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended; a local folder can still be removed
        if path.startswith("file://"):
            import shutil

            shutil.rmtree(path[len("file://") :], ignore_errors=True)


class files:
    """Small files on whatever filesystem the session's folders are on."""

    @staticmethod
    def _at(spark: SparkSession, path: str):
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @staticmethod
    def read(spark: SparkSession, path: str) -> str | None:
        """The text of a file, or None where there is none."""
        target, fs = files._at(spark, path)
        if not fs.exists(target):
            return None
        stream = fs.open(target)
        try:
            return bytes(b & 255 for b in spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode()
        finally:
            stream.close()

    @staticmethod
    def replace(spark: SparkSession, path: str, text: str) -> None:
        """Write a file beside and put it in the place of the old one by a rename."""
        target, fs = files._at(spark, path)
        fresh, _ = files._at(spark, f"{path}.{uuid.uuid4().hex}")
        stream = fs.create(fresh, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
        option = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        array = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        array[0] = option
        context.rename(fresh, target, array)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: the lineage ends there.

    The files outlive any executor, so later stages never recompute what led to them.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._foliary_path = path
    return out


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer parts than there are cores (one small file, say) dealt out to all of them; larger inputs stay as they are.

    Meant for plain scans before costly work on each row: only the columns selected so far travel.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def parts(spark: SparkSession) -> int:
    """Parts for costly work after an exchange of little data, which would otherwise be drawn together into few."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def release(df: DataFrame) -> None:
    """Remove the files of a materialized table that nothing will read again."""
    if path := getattr(df, "_foliary_path", None):
        remove_path(df.sparkSession, path)


def tokenizer_dir() -> str:
    """Folder of the public tokenizer files; FOLIARY_TOKENIZERS overrides it."""
    return os.environ.get("FOLIARY_TOKENIZERS", "/opt/tokenizers")
