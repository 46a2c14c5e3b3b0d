"""Queries over the given tables, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from foliary.llm.near_duplicates import near_duplicate_pairs

    pairs = near_duplicate_pairs(_table(spark, d, "chunks"), "chunk_key", "text")
    return pairs.select(F.col("id_a").alias("chunk_key_a"), F.col("id_b").alias("chunk_key_b"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from foliary.llm.scanned import scan_defects

    return scan_defects(_table(spark, d, "ocr_pages"))


def p2_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    from foliary.llm.scanned import repaired_documents

    return repaired_documents(_table(spark, d, "ocr_pages"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from foliary.llm.vectors import CLOSE, nearest_vectors

    near = nearest_vectors(_table(spark, d, "cache_entries"), "entry_id", "question_embedding", k=5, least_cosine=0.9, plan=CLOSE)
    return near.select(F.least("a", "b").alias("entry_id_a"), F.greatest("a", "b").alias("entry_id_b")).distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from foliary.llm.history import known_incoming

    return known_incoming(_table(spark, d, "chunks"), _table(spark, d, "incoming_chunks"), "chunk_key", "incoming_id", "batch_no")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from foliary.llm.splitting import split_texts

    cuts = [
        split_texts(_table(spark, d, t), i, "text", whole=False).groupBy(F.lit(kind).alias("item_kind"), F.col("id").alias("item_id")).agg(F.max("forced").alias("forced"))
        for t, i, kind in (("extractions", "file_id", "extraction"), ("chunks", "chunk_key", "chunk"))
    ]
    return cuts[0].union(cuts[1]).select("item_kind", "item_id", F.when(F.col("forced"), "forced").otherwise("natural").alias("cut"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from foliary.llm.language import labelled_windows, train
    from foliary.llm.pairs import Tagger, defective_pairs, sample_pairs

    feedback = _table(spark, d, "feedback")
    sample = labelled_windows(_table(spark, d, "extractions"), "text", "language")
    answers = ["answer_text", "suggested_answer"]
    tagger = Tagger(train(sample.x, sample.y)).teach(sample_pairs(feedback, "question", answers, most=3000))
    return defective_pairs(feedback, "feedback_id", "question", answers, tagger, required=("answer_text",))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from foliary.llm.language import detect_languages, wrong_languages

    found = wrong_languages(detect_languages(_table(spark, d, "extractions"), "file_id", "text", "language"))
    return found.select(F.col("id").alias("file_id"), "paragraph_no", "language")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    from foliary.llm.tokens import encode_texts

    return encode_texts(_table(spark, d, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    from foliary.llm.packing import pack_texts

    return pack_texts(_table(spark, d, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    from foliary.llm.residue import residue_ids

    return residue_ids(_table(spark, d, "documents"), "doc_id", "text")


def p10_clean(spark: SparkSession, d: str) -> DataFrame:
    from foliary.llm.residue import without_residue

    return without_residue(_table(spark, d, "documents"), "doc_id", "text").select("doc_id", "text", "lang", "source")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n[:1] == "p" and n[1:2].isdigit()}


_STRETCHES = r"string_split(regexp_replace(regexp_replace(text, '[\r\n\f]', chr(1), 'g'), '([.!?;:])[ \t]', '\1' || chr(1), 'g'), chr(1))"
_CUT = f"case when list_max(list_transform({_STRETCHES}, lambda s: length(trim(s, ' ' || chr(9))))) > 2000 then 'forced' else 'natural' end cut"


def oracle_sql() -> dict[str, str]:
    """SQL twins; the other queries are tested against brute force, exact round trips or held-out cases instead."""
    return {
        "p5_found": f"select distinct 'extraction' item_kind, file_id item_id, {_CUT} from extractions where length(text) > 2000 union all select 'chunk', chunk_key, {_CUT} from chunks where length(text) > 2000",
    }
