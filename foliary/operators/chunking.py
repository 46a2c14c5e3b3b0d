"""Chunking as table functions: a text in, its chunks out, one Arrow batch at a time and without an exchange."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.functions import segments as S

SHAPE = "id long, chunk_no int, text string, kind string, header string, start int, chunk_id string, parent_id string"


def _pieces(x) -> list[S.Piece]:
    return [p if isinstance(p, S.Piece) else S.Piece(p) for p in x]


def chunk(df: DataFrame, id_col: str, text_col: str, cut: Callable[..., list], *more: str) -> DataFrame:
    """id, chunk_no, text, kind, header, start, chunk_id, parent_id: the chunks of every text by cut(text, *values of the columns more).

    Null and blank texts give no chunk; repeated rows give repeated chunks; an empty table gives an empty table; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t, *rest in zip(*(b.column(c).to_pylist() for c in range(b.num_columns))):
                for n, p in enumerate(_pieces(cut(t, *(r or "" for r in rest)))):
                    rows.append((i, n, p.text, p.kind, p.header, p.start, p.extra.get("id"), p.extra.get("parent_id")))
            cols = list(zip(*rows)) if rows else [[]] * 8
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["id", "chunk_no", "text", "kind", "header", "start", "chunk_id", "parent_id"])

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *[F.col(m).cast("string").alias(f"m{i}") for i, m in enumerate(more)])
    return src.where("trim(text) <> ''").mapInArrow(run, SHAPE)


def simple_chunks(df, id_col, text_col, size=1000, overlap=150):
    return chunk(df, id_col, text_col, lambda t: S.simple(t, size, overlap))


def block_chunks(df, id_col, text_col, size=1000):
    return chunk(df, id_col, text_col, lambda t: S.blocks(t, size))


def semantic_chunks(df, id_col, text_col, target=1500, least=200, most=3000, overlap=150):
    return chunk(df, id_col, text_col, lambda t: S.semantic(t, target, least, most, overlap))


def adaptive_chunks(df, id_col, text_col, target=1500):
    return chunk(df, id_col, text_col, lambda t: S.adaptive(t, target))


def generic_chunks(df, id_col, text_col, source_col, size=1500, least=200, overlap=100):
    return chunk(df, id_col, text_col, lambda t, s: S.generic(t, s, size, least, overlap), source_col)


def section_chunks(df, id_col, text_col, section_col, title_col, size=1500, least=200, overlap=100):
    return chunk(df, id_col, text_col, lambda t, s, h: S.section(s, h, t, size, least, overlap), section_col, title_col)


def parent_child_chunks(df, id_col, text_col, source_col):
    return chunk(df, id_col, text_col, lambda t, s: S.parent_child(t, s), source_col)


def merged_section_chunks(sections: DataFrame, id_col: str, size: int = 1500, least: int = 200) -> DataFrame:
    """id, chunk_no, section_id, text, merged: chunks of the sections of each document in order, small neighbours sharing one.

    sections: id_col, section_no, section_id, kind, title, body. The sections of one document meet in one task, as its text did before.
    """

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("section_no")
        found = S.section_list(list(zip(*(t[c].to_pylist() for c in ("section_id", "kind", "title", "body")))), size, least)
        cols = [[key[0].as_py()] * len(found), range(len(found)), [p.extra["section_id"] for p in found], [p.text for p in found], [p.extra["merged"] for p in found]]
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string())]
        return pa.table({n: pa.array(list(c), k) for n, c, k in zip(("id", "chunk_no", "section_id", "text", "merged"), cols, kinds)})

    rows = sections.select(F.col(id_col).cast("long").alias("id"), "section_no", "section_id", "kind", "title", "body")
    return rows.groupBy("id").applyInArrow(run, "id long, chunk_no int, section_id string, text string, merged array<string>")


def adaptive_smart_chunks(df: DataFrame, id_col: str, text_col: str, source_col: str, vocabulary: list[str], base: int = 1500, least: int = 100, hierarchy: bool = False) -> DataFrame:
    """id, chunk_no, text, density_type, chunk_size, keywords, enriched_text, key_phrases: chunks whose size follows the density of their text.

    Texts under `least` characters give none. With hierarchy, parents of twice that size and their children come instead. The size is an
    expression on the row; the cutting itself is one pass over Arrow batches.
    """
    from foliary.functions import text as T

    score = T.density_score(text_col, vocabulary)
    rows = df.where(F.length(F.trim(text_col)) >= least).withColumn("_kind", T.density_type(text_col, score))
    rows = rows.withColumn("_size", T.adaptive_size(F.col("_kind"), base).cast("string"))

    def cut(text: str, source: str, size: str) -> list:
        n = int(size)
        return S.parent_child(text, source, 2 * n, 200, n, 100) if hierarchy else S.generic(text, source, n)

    made = chunk(rows, id_col, text_col, cut, source_col, "_size")
    kinds = rows.select(F.col(id_col).cast("long").alias("id"), F.col("_kind").alias("density_type"), F.col("_size").cast("int").alias("chunk_size")).distinct()
    return augmented(made.join(kinds, "id"), "text")


def augmented(chunks: DataFrame, text_col: str = "text", most: int = 10) -> DataFrame:
    """chunks with keywords, enriched_text (for reading; the text is what is embedded) and key_phrases."""
    from foliary.functions import text as T

    keys = F.slice(T.question_keywords(text_col, 4), 1, most)
    return chunks.withColumn("keywords", keys).withColumn("enriched_text", T.enriched(text_col, F.col("keywords"))).withColumn("key_phrases", T.key_phrases(text_col))
