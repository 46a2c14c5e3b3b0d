"""Question to answer as one plan over tables: understand, look up, retrieve, rerank, assemble, answer, measure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.functions import text as T
from foliary.operators import context, evaluate, rerank, search, understand
from foliary.plans.providers import Embedder, embed, extractive_generator, generate, hash_embedder
from foliary.session import materialize, scratch_path


def ingest(texts: DataFrame, id_col: str, text_col: str, source_col: str, embedder: Embedder | None = None, target: int = 1500) -> DataFrame:
    """chunk_id, source_file, chunk_index, text, keywords, embedding of cleaned and semantically cut texts."""
    from foliary.operators import chunking

    clean = texts.where(F.col(text_col).isNotNull()).withColumn("_clean", T.clean_lines(text_col))
    cut = chunking.chunk(clean, id_col, "_clean", _semantic(target))
    names = clean.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source_file")).distinct()
    rows = cut.join(names, "id").select(F.concat_ws("_", "source_file", F.lit("semantic"), F.col("id").cast("string"), F.col("chunk_no").cast("string")).alias("chunk_id"), "source_file", F.col("chunk_no").alias("chunk_index"), "text", T.question_keywords("text").alias("keywords"))
    return embed(rows, "text", embedder or hash_embedder())


def _semantic(target: int):
    from foliary.functions import segments

    return lambda t: segments.semantic(t, target)


def ask(questions: DataFrame, corpus: DataFrame, k: int = 10, embedder: Embedder | None = None, how: str = "alternating", generator=extractive_generator) -> DataFrame:
    """query_id, question, intent, context, answer and its scores.

    questions: query_id, question (and embedding, else the embedder makes it); corpus: chunk_id, text, embedding, collection, source_file,
    section_id. Weights of the two lists follow the question's intent.
    """
    q = understand.analyse(questions)
    if "embedding" not in q.columns:
        q = embed(q, "question", embedder or hash_embedder(), "query")
    q = materialize(q, "questions")
    index = search.LexicalIndex(q.sparkSession, scratch_path(q.sparkSession, "lexical")).build(corpus)
    named = F.create_map([y for name, (d, s) in understand.WEIGHTS.items() for y in (F.lit(name), F.array(F.lit(float(d)), F.lit(float(s))))])
    weights = q.select("query_id", named[F.col("intent")].alias("w")).select("query_id", F.col("w")[0].alias("dense_weight"), F.col("w")[1].alias("sparse_weight"))
    fused = search.fuse(search.dense_top_k(q, corpus, 2 * k), index.search(q, 2 * k), k, weights=weights)
    found = fused.join(corpus.drop("embedding"), "chunk_id").join(q.select("query_id", "question", "entities"), "query_id")
    ordered = rerank.section_boost(found, F.col("entities"))
    placed = rerank.lost_in_middle(ordered, how).withColumn("rank", F.col("position"))
    texts = placed.groupBy("query_id").agg(F.collect_list("text").alias("texts"), F.collect_list("source_file").alias("files"))  # at most k each
    out = q.select("query_id", "question", "intent").join(context.provenance(placed), "query_id", "left").join(texts, "query_id", "left")
    return evaluate.metrics(generate(out, "question", "context", generator))


def ask_collections(questions: DataFrame, corpus: DataFrame, k: int = 10) -> DataFrame:
    """query_id, context: the k best of every collection, merged by reciprocal ranks, best first."""
    found = search.dense_top_k(questions, corpus, k, by=["collection"])
    merged = search.federated_fuse(found, k)
    full = corpus.withColumn("key", F.concat_ws("::", "collection", F.col("chunk_id").cast("string"))).drop("embedding", "collection")
    return context.provenance(merged.where(F.col("rank") < k).join(full, "key"))


def hyde(questions: DataFrame, corpus: DataFrame, hypothetical: DataFrame, k: int = 10, embedder: Embedder | None = None) -> DataFrame:
    """Results for a question and for a hypothetical answer to it (over 50 characters), merged: what both find rises.

    questions: query_id, question; hypothetical: query_id, text; corpus: chunk_id, text, embedding and path.
    """
    from foliary.functions import vectors as V

    e = embedder or hash_embedder()
    asked = questions.select("query_id", F.col("question").alias("text"))
    good = hypothetical.where(F.length("text") > 50).select("query_id", "text")
    found = None
    for part in (asked, good):
        near = search.dense_top_k(embed(part, "text", e, "query"), corpus, k).select("query_id", "chunk_id", F.round(V.score("distance"), 9).alias("score"))
        found = near if found is None else found.union(near)
    return search.merge_results(found.withColumn("path", F.lit(None).cast("string")).withColumn("text", F.lit("")), k)


def parsed_variations(replies: DataFrame, most: int = 3) -> DataFrame:
    """query_id, variant_no, variant: lines over ten characters that do not begin with a digit of a generator's reply, after the question itself."""
    lines = F.slice(F.filter(F.transform(F.split("reply", "\n"), lambda s: F.trim(s)), lambda s: (F.length(s) > 10) & ~s.rlike("^[0-9]")), 1, most)
    return replies.select("query_id", F.posexplode(F.concat(F.array("question"), lines)).alias("variant_no", "variant"))
