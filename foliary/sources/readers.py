"""Tables of files, texts and manifests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.sources import parsers


def list_files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """path, filename, extension, size, modified of the files of a folder; contents are not read."""
    r = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    name = F.element_at(F.split("path", "/"), -1)
    return r.load(folder).select("path", name.alias("filename"), F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).alias("extension"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")).dropDuplicates(["path"])


def extract_texts(spark: SparkSession, folder: str, pattern: str = "*", other: Callable[[str, bytes], str | None] | None = None, excluded: tuple[str, ...] = ()) -> DataFrame:
    """path, filename, extension, size, text, method, error: the text of each file by its kind.

    `other` is asked for kinds without a parser here (PDF, legacy formats, scans). A file that cannot be read has an error and no text.
    """
    leave = frozenset(x.lower() for x in excluded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, methods, errors = [], [], []
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = method = error = None
                try:
                    text, method = parsers.text_of(path, data, leave), "parser"
                    if text is None:
                        text, method = (other(path, data), "provider") if other else (None, None)
                        error = None if text is not None else "no extractor for this kind"
                except Exception as e:  # a broken file is a row with an error, not the end of the job
                    error = f"{type(e).__name__}: {e}"[:500]
                texts.append(text)
                methods.append(method)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in b.column(1).to_pylist()], pa.int64()), pa.array(texts, pa.string()), pa.array(methods, pa.string()), pa.array(errors, pa.string())], names=["path", "size", "text", "method", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    out = files.select("path", "content").mapInArrow(run, "path string, size long, text string, method string, error string")
    name = F.element_at(F.split("path", "/"), -1)
    return out.select("path", name.alias("filename"), F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).alias("extension"), "size", "text", "method", "error")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """grp, path of a `group;path` list: either separator, an optional header, a byte order mark, empty groups as ALL, rows without a path dropped."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("v")).where("trim(v) <> ''")
    parts = F.split("v", "[;,]", 2)
    rows = lines.select(F.trim(F.element_at(parts, 1)).alias("g"), F.trim(F.get(parts, F.lit(1))).alias("p"))
    rows = rows.select(F.when(F.col("p").isNull(), "").otherwise(F.col("g")).alias("g"), F.coalesce("p", "g").alias("path"))
    head = F.lower("g").isin("group", "groupe") | F.lower("path").isin("path", "chemin")
    return rows.where(~head & (F.col("path") != "")).select(F.coalesce(F.nullif("g", F.lit("")), F.lit("ALL")).alias("grp"), "path")


def write_manifest(files: DataFrame, path: str) -> None:
    files.select("grp", "path").write.mode("overwrite").option("sep", ";").option("header", "true").csv(path)


def accompanying(files: DataFrame, extensions: tuple[str, ...] = (".pdf", ".docx", ".xlsx")) -> DataFrame:
    """path, other: files beside a presentation that begin with its name, or lie in a folder of its name."""
    stem = F.regexp_replace("filename", r"\.[^.]+$", "")
    folder = F.regexp_replace("path", "/[^/]*$", "")
    decks = files.where(F.col("extension") == ".pptx").select("path", folder.alias("folder"), stem.alias("stem"))
    rest = files.where(F.col("extension").isin(*extensions)).select(F.col("path").alias("other"), F.col("filename").alias("name"), folder.alias("at"))
    beside = decks.join(rest, decks["folder"] == rest["at"]).where(F.startswith("name", "stem"))
    within = decks.join(rest, F.concat("folder", F.lit("/"), "stem") == rest["at"])
    return beside.select("path", "other").union(within.select("path", "other")).distinct()


def choose_extraction(candidates: DataFrame) -> DataFrame:
    """Adds text and extractor of the best of text_1..text_3: the first, unless it is suspect and the second is longer; the third if what is
    chosen is still suspect and the third is more than a tenth longer."""
    from foliary.functions.text import is_suspect

    n = lambda c: F.length(F.coalesce(c, F.lit("")))
    second = is_suspect("text_1") & (n("text_2") > n("text_1"))
    out = candidates.withColumn("text", F.when(second, F.col("text_2")).otherwise(F.col("text_1"))).withColumn("extractor", F.when(second, 2).otherwise(1))
    third = is_suspect("text") & (n("text_3") > 1.1 * n("text"))
    return out.withColumns({"extractor": F.when(third, 3).otherwise(F.col("extractor")), "text": F.when(third, F.col("text_3")).otherwise(F.col("text"))})


def paths_of_csv(spark: SparkSession, path: str, column: str = "path", delimiter: str = ";") -> DataFrame:
    """path of a delimited file with a header: distinct, trimmed, empty ones left out. A file without the column is an error."""
    rows = spark.read.option("header", "true").option("sep", delimiter).option("quote", '"').option("escape", '"').csv(path)
    if column not in rows.columns:
        raise ValueError(f"{path} has no column {column}: {rows.columns}")
    return rows.select(F.trim(F.col(column)).alias("path")).where("path <> ''").distinct()


def missing_files(wanted: DataFrame, listed: DataFrame) -> DataFrame:
    """Rows of wanted (path) that a listing of files (path) does not have; schemes and doubled slashes do not count."""
    key = lambda df: df.withColumn("_k", F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:(?=/)", ""), "/+", "/"))
    return key(wanted).join(key(listed).select("_k").distinct(), "_k", "left_anti").drop("_k")


def xml_files(manifest: DataFrame) -> DataFrame:
    """Distinct XML files that manifests name."""
    return manifest.where(F.lower(F.col("path")).endswith(".xml")).select("path").distinct()


def unique_names(files: DataFrame, by: list[str], name: str, order: list[str]) -> DataFrame:
    """unique_name: names made different within `by`: the second of a name gets _1 before its extension, the third _2, and so on."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(*by, F.lower(F.col(name))).orderBy(*order)) - 1
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    return files.withColumn("_n", n).withColumn("unique_name", F.when(F.col("_n") == 0, F.col(name)).otherwise(F.concat(stem, F.lit("_"), F.col("_n").cast("string"), ext))).drop("_n")


def page_texts(pages: DataFrame) -> DataFrame:
    """id, path, text of wiki pages (id, title, ancestors array, html): the path is `A > B > title`, the text is headed by the title."""
    from foliary.functions import text as T

    path = F.concat_ws(" > ", F.coalesce("ancestors", F.array().cast("array<string>")), F.col("title"))
    return pages.select("id", path.alias("path"), F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce(T.html_text("html"), F.lit(""))).alias("text"))


def pages_by_section(pages: DataFrame, path: str = "path", sep: str = " > ") -> DataFrame:
    """section, pages, first: pages grouped by their second-level ancestor, those at depth three or more only."""
    parts = F.split(path, F.lit(sep)) if sep == "/" else F.split(path, sep)
    rows = pages.where(F.size(parts) >= 3).select(F.element_at(parts, 2).alias("section"), "id")
    return rows.groupBy("section").agg(F.count("*").alias("pages"), F.min("id").alias("first"))


def corpus_ids(chunks: DataFrame, position: str) -> DataFrame:
    """doc_id of each row for the lexical index: its chunk_id, or its position where it has none."""
    return chunks.withColumn("doc_id", F.coalesce(F.nullif("chunk_id", F.lit("")), F.col(position).cast("string")))


def feedback_of(feedback: DataFrame, base: str | None = None) -> DataFrame:
    """Feedback of one base, or (None) of all; the filter reaches the scan."""
    return feedback if base is None else feedback.where(F.col("base_name") == base)
