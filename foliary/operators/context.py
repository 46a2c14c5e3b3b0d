"""Context around retrieved chunks: neighbours, references, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliary.functions import text as T


def neighbours(chunks: DataFrame, by: list[str], order: list[str], text: str = "text", most: int = 200) -> DataFrame:
    """previous_text and next_text of every chunk within its source, cut at `most` characters with three points."""
    w = Window.partitionBy(*by).orderBy(*order)

    def cut(c):
        return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)

    return chunks.withColumn("previous_text", cut(F.lag(text).over(w))).withColumn("next_text", cut(F.lead(text).over(w)))


def overlapped(chunks: DataFrame, by: list[str], order: list[str], text: str = "text", overlap: int = 150) -> DataFrame:
    """Each chunk with the last characters of the one before in front."""
    before = F.expr(f"right({text}, {overlap})")
    w = Window.partitionBy(*by).orderBy(*order)
    return chunks.withColumn("_tail", before).withColumn("_before", F.lag("_tail").over(w)).withColumn("text_overlap", F.when(F.col("_before").isNull(), F.col(text)).otherwise(F.concat("_before", F.lit("\n"), text))).drop("_tail", "_before")


def reference_edges(chunks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """src, ref, pos: the distinct references a chunk's text makes, numbered by first appearance."""
    return chunks.select(F.col(id_col).alias("src"), F.posexplode(T.refers_to(text_col)).alias("pos", "ref"))


def referenced_chunks(chunks: DataFrame, id_col: str, text_col: str, section_col: str, most_refs: int = 5, per_ref: int = 2) -> DataFrame:
    """src, ref, dst: chunks whose section is one of the first references of src, up to per_ref each (least ids), never src itself."""
    edges = reference_edges(chunks, id_col, text_col).where(F.col("pos") < most_refs)
    own = chunks.select(F.col(id_col).alias("dst"), F.explode(F.transform(T.section_refs(section_col), F.upper)).alias("ref"))
    first = own.withColumn("n", F.row_number().over(Window.partitionBy("ref").orderBy("dst"))).where(F.col("n") <= per_ref + 1)
    met = edges.join(first.select("dst", "ref"), "ref").where("src <> dst")
    w = Window.partitionBy("src", "ref").orderBy("dst")
    return met.withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_ref).select("src", "ref", "dst")


def external_references(chunks: DataFrame, id_col: str, text_col: str, section_col: str) -> DataFrame:
    """src, ref: references of a chunk other than its own section."""
    own = chunks.select(F.col(id_col).alias("src"), F.transform(T.section_refs(section_col), F.upper).alias("own"))
    return reference_edges(chunks, id_col, text_col).join(own, "src").where(~F.array_contains("own", F.col("ref"))).select("src", "ref")


def parents(chunks: DataFrame) -> DataFrame:
    """child, parent, parent_text of chunks with a parent_id."""
    p = chunks.select(F.col("chunk_id").alias("parent_id"), F.col("text").alias("parent_text"))
    return chunks.where("parent_id is not null").join(p, "parent_id", "left").select(F.col("chunk_id").alias("child"), F.col("parent_id").alias("parent"), "parent_text")


def provenance(sources: DataFrame, by: str = "query_id") -> DataFrame:
    """context: the sources of a question as blocks headed by where they come from, in order of rank."""
    head = F.concat_ws(" ", F.concat(F.lit("[Collection: "), F.col("collection"), F.lit("]")), F.concat(F.lit("[File: "), F.col("source_file"), F.lit("]")), F.concat(F.lit("[Section: "), F.col("section_id"), F.lit("]")))
    block = F.concat(head, F.lit("\n"), F.coalesce("text", F.lit("")))
    rows = sources.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("b"))
    return rows.select(by, F.array_join(F.transform("b", lambda x: x["block"]), "\n\n---\n\n").alias("context"))


def related_chunks(chunks: DataFrame, id_col: str, text_col: str, section_col: str, most: int = 5) -> DataFrame:
    """src, dst, rank: up to `most` other chunks (least ids first) that are a section src refers to, or refer to one that src refers to.

    Of the chunks behind one reference only the first most + 1 can matter, so a reference that everybody makes pairs nothing with everything.
    """
    edges = reference_edges(chunks, id_col, text_col).select("src", "ref")
    own = chunks.select(F.col(id_col).alias("dst"), F.explode(F.transform(T.section_refs(section_col), F.upper)).alias("ref"))
    behind = own.union(edges.select(F.col("src").alias("dst"), "ref")).distinct()
    first = behind.withColumn("n", F.row_number().over(Window.partitionBy("ref").orderBy("dst"))).where(F.col("n") <= most + 1)
    met = edges.join(first.select("dst", "ref"), "ref").where("src <> dst").select("src", "dst").distinct()
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1).where(F.col("rank") < most)


def block_header(distance: str = "distance") -> Column:
    """[source=…, section=… (title), chunk=…, dist=0.000]: titles are cut at 40 characters."""
    title = F.when(F.length("section_title") > 40, F.concat(F.lit(" ("), F.substring("section_title", 1, 40), F.lit("...)"))).when(F.length("section_title") > 0, F.concat(F.lit(" ("), F.col("section_title"), F.lit(")"))).otherwise("")
    section = F.when(F.coalesce(F.length("section_id"), F.lit(0)) > 0, F.concat(F.lit(", section="), F.col("section_id"), title)).otherwise("")
    far = F.format_string("%.3f", F.col(distance).cast("double"))
    return F.concat(F.lit("[source="), F.coalesce("source_file", F.lit("")), section, F.lit(", chunk="), F.coalesce(F.col("chunk_id").cast("string"), F.lit("")), F.lit(", dist="), far, F.lit("]"))


def context_blocks(sources: DataFrame, by: str = "query_id") -> DataFrame:
    """context: the sources of a question in order of rank, each under its header; null texts are empty blocks.

    sources: by, rank, source_file, section_id, section_title, chunk_id, distance, text: as many a question as were retrieved.
    """
    block = F.concat(block_header(), F.lit("\n"), F.coalesce("text", F.lit("")))
    rows = sources.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", block.alias("block")))).alias("b"))
    return rows.select(by, F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("context"))


def collections_context(sources: DataFrame, by: str = "query_id") -> DataFrame:
    """context: one block for each collection (by name), headed by it, its sources by rank within."""
    one = sources.groupBy(by, "collection").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", F.concat(block_header(), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("block")))).alias("b"))
    part = F.concat(F.lit("=== CONTEXTE "), F.col("collection"), F.lit(" ===\n"), F.array_join(F.transform("b", lambda x: x["block"]), "\n\n"))
    rows = one.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("collection", part.alias("part")))).alias("p"))
    return rows.select(by, F.array_join(F.transform("p", lambda x: x["part"]), "\n\n").alias("context"))


def retrieved_references(sources: DataFrame, first: int = 15, most: int = 5, by: str = "query_id") -> DataFrame:
    """by, chunk_id, place: among a question's sources beyond the first, those (at most `most`, by rank) whose section the first refer to."""
    asked = sources.where(F.col("rank") < first).select(by, F.explode(T.refers_to("text")).alias("ref")).distinct()
    later = sources.where(F.col("rank") >= first).select(by, "chunk_id", "rank", F.regexp_replace(F.upper("section_id"), r"[\s\-]", "").alias("ref"))
    met = later.join(asked, [by, "ref"], "left_semi")
    return met.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("rank", "chunk_id")) - 1).where(F.col("place") < most).select(by, "chunk_id", "place")


def neighbour_window(chunks: DataFrame, by: list[str], order: list[str], n: int = 1, text: str = "text", most: int = 200) -> DataFrame:
    """expanded_text of every chunk: up to n neighbours on each side within its source, cut at `most` characters, and the chunk itself, under three labels."""
    w = Window.partitionBy(*by).orderBy(*order)
    cut = lambda c: F.concat(F.substring(c, 1, most), F.lit("..."))
    before = F.array_compact(F.array(*[cut(F.lag(F.coalesce(text, F.lit("")), i).over(w)) for i in range(n, 0, -1)]))
    after = F.array_compact(F.array(*[cut(F.lead(F.coalesce(text, F.lit("")), i).over(w)) for i in range(1, n + 1)]))
    out = chunks.withColumn("_b", before).withColumn("_a", after)
    parts = F.array(
        F.when(F.size("_b") > 0, F.concat(F.lit("[CONTEXTE PRÉCÉDENT]\n"), F.array_join("_b", " "), F.lit("\n"))),
        F.concat(F.lit("[CONTENU PRINCIPAL]\n"), F.coalesce(text, F.lit("")), F.lit("\n")),
        F.when(F.size("_a") > 0, F.concat(F.lit("[CONTEXTE SUIVANT]\n"), F.array_join("_a", " "))),
    )
    return out.withColumn("expanded_text", F.array_join(F.array_compact(parts), "\n")).drop("_b", "_a")


def with_previous(chunks: DataFrame, by: list[str], order: list[str], text: str = "text", most: int = 100) -> DataFrame:
    """text_in_context: each chunk after the last characters of the one before it in its source."""
    w = Window.partitionBy(*by).orderBy(*order)
    tail = F.lag(F.expr(f"right({text}, {most})")).over(w)
    return chunks.withColumn("text_in_context", F.when(F.coalesce(F.length(tail), F.lit(0)) > 0, F.concat(F.lit("[..."), tail, F.lit("]\n\n"), F.coalesce(text, F.lit("")))).otherwise(F.coalesce(text, F.lit(""))))
