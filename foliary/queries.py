"""Queries of the core operators over the given tables, by name, and SQL twins for DuckDB."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.functions import text as T
from foliary.functions import vectors as V
from foliary.operators import cache, context, evaluate, feedback, rerank, search, understand
from foliary.plans import oracle as O
from foliary.session import materialize, scratch_path, shared_dir, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from foliary import queries_more  # noqa: F401  # registers the others

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from foliary import queries_more  # noqa: F401

    return dict(SQL)


# Inputs -----------------------------------------------------------------------------------------------------------------------------


def vector_corpus(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def vector_questions(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def chunk_corpus(spark, d):
    return spread(table(spark, d, "chunks").select(F.col("chunk_key").alias("chunk_id"), "text"))


def text_questions(spark, d):
    return table(spark, d, "cache_entries").where("entry_id % 20 = 0").select(F.col("entry_id").alias("query_id"), "question")


def answered(spark, d):
    return spread(table(spark, d, "cache_entries").select(F.col("entry_id").alias("chunk_id"), F.col("question").alias("text"), F.col("question_embedding").alias("embedding"), F.col("collection_name").alias("collection")))


def answered_questions(spark, d):
    rows = table(spark, d, "cache_entries").where("entry_id % 20 = 0").where(V.usable("question_embedding", 64))
    return rows.select(F.col("entry_id").alias("query_id"), "question", F.col("question_embedding").alias("embedding"))


def chunk_index(spark, d) -> search.LexicalIndex:
    """The index over the chunks, kept in the session's folder and built anew only when the table has changed."""
    chunks = table(spark, d, "chunks").select(F.col("chunk_key").alias("chunk_id"), "text", "ingested_at")
    path = f"{shared_dir(spark)}/foliary-lexical-{hashlib.md5(d.encode()).hexdigest()[:12]}"
    return search.LexicalIndex(spark, path).fresh(chunks, version="ingested_at")


def lexical(spark, d, k=30):
    return chunk_index(spark, d).search(text_questions(spark, d), k)


def feedback_rows(spark, d):
    return feedback.first_rows(table(spark, d, "feedback"))


L2 = O.squared_l2("c.embedding", "q.embedding")
DENSE_SQL = f"""with r as (select q.vec_id query_id, c.vec_id chunk_id, round({L2}, 9) distance from embeddings c, embeddings q where q.vec_id % 20 = 0),
 d as (select *, row_number() over (partition by query_id order by distance, chunk_id) - 1 rnk from r)"""
INDEX_SQL = f"""tok as materialized (select chunk_key chunk_id, {O.index_tokens("text")} tokens from chunks),
 post as materialized (select chunk_id, term, count(*) tf from (select chunk_id, unnest(tokens) term from tok) group by 1, 2),
 st as (select count(*) n, avg(len(tokens)) avg_len from tok), df as (select term, count(*) df from post group by 1),
 ask as (select entry_id query_id, unnest({O.index_tokens("question")}) term from cache_entries where entry_id % 20 = 0),
 q as (select query_id, term, count(*) qtf from ask group by 1, 2),
 sc as materialized (select query_id, p.chunk_id, round(sum(qtf * ln((n - df + 0.5::double) / (df + 0.5::double) + 1) * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * len(tokens) / avg_len))), 9) score
   from q join df using (term) join post p using (term) join tok t on t.chunk_id = p.chunk_id, st group by 1, 2),
 bm as materialized (select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id) - 1 rnk from sc where score > 0) where rnk < 30)"""


# Retrieval --------------------------------------------------------------------------------------------------------------------------


@query(DENSE_SQL + " select query_id, chunk_id, round(distance, 6) distance, rnk::int rank from d where rnk < 10")
def dense_topk(spark, d):
    out = search.dense_top_k(vector_questions(spark, d), vector_corpus(spark, d), 10)
    return out.select("query_id", "chunk_id", F.round("distance", 6).alias("distance"), "rank")


@query(DENSE_SQL + " select query_id, chunk_id, round(greatest(0, 1 - distance / 2), 6) score, round(case when distance = 0 then 0.5 else 1 - distance / 2 end, 6) federated_score from d where rnk < 10")
def dense_score(spark, d):
    out = search.dense_top_k(vector_questions(spark, d), vector_corpus(spark, d), 10)
    return out.select("query_id", "chunk_id", F.round(V.score("distance"), 6).alias("score"), F.round(V.federated_score("distance"), 6).alias("federated_score"))


@query(f"select doc_id, len(t)::bigint n_tokens, md5(array_to_string(t, ' ')) digest from (select doc_id, {O.index_tokens('text')} t from documents)")
def bm25_tokens(spark, d):
    t = T.index_tokens("text")
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("digest"))


@query(f"with {INDEX_SQL} select n n_docs, round(avg_len, 6) avg_len from st")
def bm25_stats(spark, d):
    out = search.lexical_statistics(search.postings(chunk_corpus(spark, d)))
    return out.select("n_docs", F.round("avg_len", 6).alias("avg_len"))


@query(f"with {INDEX_SQL} select term, df, round(ln((n - df + 0.5::double) / (df + 0.5::double) + 1), 6) idf from df, st")
def bm25_idf(spark, d):
    index = materialize(search.postings(chunk_corpus(spark, d)), "postings")
    n = search.lexical_statistics(index).first().n_docs
    return search.document_frequencies(index).select("term", "df", F.round(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1), 6).alias("idf"))


@query(f"with {INDEX_SQL} select query_id, chunk_id, round(score, 6) score from bm")
def bm25_search(spark, d):
    return lexical(spark, d).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query(f"with {INDEX_SQL} select query_id, chunk_id, round(case when max(score) over w = min(score) over w then 1.0 else (score - min(score) over w) / (max(score) over w - min(score) over w) end, 4) scaled from bm window w as (partition by query_id)")
def minmax_scores(spark, d):
    out = search.min_max(lexical(spark, d), ["query_id"])
    return out.select("query_id", "chunk_id", F.round("scaled", 4).alias("scaled"))


OK64 = "question_embedding is not null and len(question_embedding) = 64 and len(list_filter(question_embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0"
HYBRID_SQL = f"""with tok as materialized (select entry_id chunk_id, {O.index_tokens("question")} tokens from cache_entries),
 post as materialized (select chunk_id, term, count(*) tf from (select chunk_id, unnest(tokens) term from tok) group by 1, 2),
 st as (select count(*) n, avg(len(tokens)) avg_len from tok), df as (select term, count(*) df from post group by 1),
 vec as materialized (select entry_id, collection_name, question_embedding embedding, list_sum(list_transform(question_embedding, lambda x: x::double * x::double)) len2 from cache_entries where {OK64}),
 qv as (select entry_id query_id, collection_name, embedding from vec where entry_id % 20 = 0 and len2 > 0),
 q as (select query_id, term, count(*) qtf from (select query_id, unnest(tokens) term from qv join tok on chunk_id = query_id) group by 1, 2),
 sc as (select query_id, p.chunk_id, round(sum(qtf * ln((n - df + 0.5::double) / (df + 0.5::double) + 1) * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * len(tokens) / avg_len))), 9) score
   from q join df using (term) join post p using (term) join tok t on t.chunk_id = p.chunk_id, st group by 1, 2),
 s as (select query_id, chunk_id, rnk from (select *, row_number() over (partition by query_id order by score desc, chunk_id) - 1 rnk from sc where score > 0) where rnk < 20),
 dd as materialized (select q.query_id, c.entry_id chunk_id, c.collection_name collection, round({O.squared_l2("c.embedding", "q.embedding")}, 9) distance from vec c, qv q),
 d as (select query_id, chunk_id, distance, rnk from (select *, row_number() over (partition by query_id order by distance, chunk_id) - 1 rnk from dd) where rnk < 20),
 f as (select coalesce(d.query_id, s.query_id) query_id, coalesce(d.chunk_id, s.chunk_id) chunk_id, d.rnk dr, s.rnk sr,
   round((coalesce(0.8::double / (60 + d.rnk), 0) + coalesce(0.2::double / (60 + s.rnk), 0)) * case when d.rnk is not null and s.rnk is not null then 1.1::double else 1 end, 12) rrf
   from d full join s on d.query_id = s.query_id and d.chunk_id = s.chunk_id),
 h as (select *, 1 - rrf / greatest(max(rrf) over (partition by query_id), 1e-6) distance, row_number() over (partition by query_id order by rrf desc, coalesce(dr, 1073741824), coalesce(sr, 1073741824), chunk_id) - 1 rnk from f)"""


@query(HYBRID_SQL + " select query_id, chunk_id, round(rrf, 9) rrf, round(distance, 6) distance, rnk::int rank from h where rnk < 10")
def hybrid_rrf(spark, d):
    out = search.hybrid(answered_questions(spark, d), answered(spark, d), 10)
    return out.select("query_id", "chunk_id", F.round("rrf", 9).alias("rrf"), F.round("distance", 6).alias("distance"), "rank")


@query(
    HYBRID_SQL
    + """, u as (select query_id, chunk_id, round(greatest(0, 1 - distance / 2), 9) score from d union all select query_id, chunk_id, round(1 - rnk / 20.0::double, 9) from s),
 m as (select query_id, chunk_id::varchar "key", count(*) hits, round(max(score) * (1 + 0.1::double * (count(*) - 1)), 9) score from u group by 1, 2)
 select query_id, "key", hits, round(score, 6) score from (select *, row_number() over (partition by query_id order by score desc, "key") rn from m) where rn <= 20"""
)
def multi_query_merge(spark, d):
    q, c = answered_questions(spark, d), answered(spark, d)
    dense = search.dense_top_k(q, c, 20).select("query_id", "chunk_id", F.round(V.score("distance"), 9).alias("score"))
    sparse = search.LexicalIndex(spark, scratch_path(spark, "lexical")).build(c).search(q, 20).select("query_id", "chunk_id", F.round(1 - F.col("rank") / 20, 9).alias("score"))
    out = search.merge_results(dense.union(sparse).withColumn("path", F.lit(None).cast("string")).withColumn("text", F.lit("")), 20)
    return out.select("query_id", "key", "hits", F.round("score", 6).alias("score"))


@query(HYBRID_SQL + " select query_id, collection, chunk_id, round(distance, 6) distance, rnk::int rank from (select *, row_number() over (partition by query_id, collection order by distance, chunk_id) - 1 rnk from dd) where rnk < 3")
def federated_search(spark, d):
    out = search.dense_top_k(answered_questions(spark, d), answered(spark, d), 3, by=["collection"])
    return out.select("query_id", "collection", "chunk_id", F.round("distance", 6).alias("distance"), "rank")


@query(
    HYBRID_SQL
    + """, fr as (select query_id, collection, chunk_id, distance, row_number() over (partition by query_id, collection order by distance, chunk_id) - 1 rnk from dd),
 fm as (select query_id, collection, concat_ws('::', collection, chunk_id::varchar) "key", round(sum(1 / (60 + rnk)::double), 12) rrf, min(rnk) first from fr where rnk < 3 group by all)
 select query_id, "key", round(rrf, 9) rrf, rnk::int rank from (select *, row_number() over (partition by query_id order by rrf desc, collection, first, "key") - 1 rnk from fm) where rnk < 20"""
)
def federated_rrf(spark, d):
    found = search.dense_top_k(answered_questions(spark, d), answered(spark, d), 3, by=["collection"])
    return search.federated_fuse(found, 10).select("query_id", "key", F.round("rrf", 9).alias("rrf"), "rank")


# After retrieval --------------------------------------------------------------------------------------------------------------------

PLACES = {
    "alternating": "case when n <= 3 then rnk when rnk % 2 = 0 then rnk // 2 else n - (rnk + 1) // 2 end",
    "bookends": "case when n <= 6 then rnk when rnk < 3 then rnk when rnk >= n - 3 then rnk - n + 6 else rnk + 3 end",
    "reverse_middle": "case when n <= 6 then rnk when rnk >= n // 3 and rnk < 2 * (n // 3) then 3 * (n // 3) - 1 - rnk else rnk end",
}
for _how, _place in PLACES.items():

    def _lost(spark, d, how=_how):
        return rerank.lost_in_middle(lexical(spark, d), how).select("query_id", "chunk_id", "position")

    _lost.__name__ = f"lost_in_middle_{_how}"
    query(f"with {INDEX_SQL} select query_id, chunk_id, ({_place})::int position from (select *, count(*) over (partition by query_id) n from bm)")(_lost)


@query(f"select distinct feedback_id, array_to_string({O.question_keywords('question')}, ' ') keywords from feedback where question is not null")
def keyword_extract(spark, d):
    return feedback_rows(spark, d).where("question is not null").select("feedback_id", F.array_join(T.question_keywords("question"), " ").alias("keywords"))


def sources(spark, d):
    c = table(spark, d, "chunks").select(F.col("chunk_key").alias("chunk_id"), "text", F.col("collection_name").alias("collection"), "source_file", "section_id")
    return lexical(spark, d).join(c, "chunk_id").join(text_questions(spark, d), "query_id")


SOURCES_SQL = f"""with {INDEX_SQL}, src as (select bm.query_id, bm.chunk_id, bm.score, bm.rnk, c.text, c.collection_name collection, c.source_file, c.section_id, e.question
 from bm join chunks c on c.chunk_key = bm.chunk_id join cache_entries e on e.entry_id = bm.query_id),
 kw as (select *, {O.question_keywords("question")} kws from src), km as (select *, len(list_filter(kws, lambda k: contains(lower(text), lower(k)))) hits from kw)"""


@query(SOURCES_SQL + " select query_id, chunk_id, hits::int keyword_matches from (select *, bool_or(hits >= 2) over (partition by query_id) anyhit from km) where hits >= 2 or not anyhit or len(kws) = 0")
def keyword_filter(spark, d):
    s = sources(spark, d)
    return rerank.keyword_filter(s, T.question_keywords("question"), 2).select("query_id", "chunk_id", "keyword_matches")


@query(SOURCES_SQL + ", b as (select *, round(least(1.0, 1 - rnk / 100.0::double - 0.5::double + 0.1::double * hits), 9) s from km) select query_id, chunk_id, round(s, 6) score, (row_number() over (partition by query_id order by s desc, rnk) - 1)::int rank from b")
def keyword_boost(spark, d):
    s = sources(spark, d).withColumn("score", 1 - F.col("rank") / 100 - 0.5)
    return rerank.keyword_boost(s, T.question_keywords("question")).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


ENTITY_SQL = "list_transform(regexp_extract_all(coalesce(question, ''), '(?:CS(?:-[A-Z]+)?|AMC[0-9]{0,2}|GM[0-9]{0,2})[- ]?[0-9]+(?:[.][0-9]+)?'), lambda e: regexp_replace(lower(e), '[\\s\\-]+', '', 'g'))"
MATCH_SQL = f"len(list_filter({O.section_refs('section_id')}, lambda r: len(list_filter(ents, lambda e: (starts_with(r, e) and substr(r, len(e) + 1, 1) in ('', '.', '(')) or (starts_with(e, r) and substr(e, len(r) + 1, 1) in ('', '.', '(')))) > 0)) > 0"


@query(
    SOURCES_SQL
    + f", en as (select *, {ENTITY_SQL} ents, round(1 - 0.01::double * (30 - rnk), 6) distance from src), hi as (select *, {MATCH_SQL} hit from en)"
    + " select query_id, chunk_id, hit section_hit, (row_number() over (partition by query_id order by case when hit then distance * 0.4::double else distance end, rnk) - 1)::int rank from hi"
)
def section_boost(spark, d):
    s = sources(spark, d).withColumn("distance", F.round(1 - 0.01 * (30 - F.col("rank")), 6))
    ents = F.regexp_extract_all(F.coalesce("question", F.lit("")), F.lit(r"(?:CS(?:-[A-Z]+)?|AMC[0-9]{0,2}|GM[0-9]{0,2})[- ]?[0-9]+(?:[.][0-9]+)?"), 0)
    return rerank.section_boost(s, ents).select("query_id", "chunk_id", "section_hit", "rank")


@query(f"with {INDEX_SQL} select query_id, chunk_id, round(1 - 0.01::double * rnk, 6) rerank_score from bm where rnk < 10")
def rerank_fallback(spark, d):
    return rerank.rerank(lexical(spark, d), None, 10).select("query_id", "chunk_id", "rerank_score")


@query(
    SOURCES_SQL
    + """ select query_id, md5(string_agg(concat_ws(' ', '[Collection: ' || collection || ']', '[File: ' || source_file || ']', '[Section: ' || section_id || ']') || chr(10) || coalesce(text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rnk)) digest from src group by 1"""
)
def provenance_context(spark, d):
    return context.provenance(sources(spark, d)).select("query_id", F.md5("context").alias("digest"))


@query(SOURCES_SQL + " select query_id, collection, count(*) n from src group by 1, 2")
def provenance_counts(spark, d):
    return sources(spark, d).groupBy("query_id", "collection").agg(F.count("*").alias("n"))


# References and neighbours ----------------------------------------------------------------------------------------------------------

EDGE_SQL = f"with e as (select chunk_key src, r, unnest(r) ref, generate_subscripts(r, 1) - 1 pos, section_id from (select chunk_key, section_id, {O.refers_to('text')} r from chunks))"


@query(EDGE_SQL + " select src, ref, pos::int pos from e")
def cross_references(spark, d):
    return context.reference_edges(table(spark, d, "chunks"), "chunk_key", "text").select("src", "ref", "pos")


@query(EDGE_SQL + f" select src, ref from e where not list_contains(list_transform({O.section_refs('section_id')}, lambda s: upper(s)), ref)")
def external_refs(spark, d):
    return context.external_references(table(spark, d, "chunks"), "chunk_key", "text", "section_id")


@query(
    EDGE_SQL
    + f""", own as (select chunk_key dst, upper(unnest({O.section_refs("section_id")})) ref from chunks), m as (select src, ref, dst, row_number() over (partition by src, ref order by dst) n from e join own using (ref) where pos < 5 and src <> dst)
 select src, ref, dst from m where n <= 2"""
)
def reference_index(spark, d):
    return context.referenced_chunks(table(spark, d, "chunks"), "chunk_key", "text", "section_id")


@query(
    """with n as (select chunk_key, lag(text) over w p, lead(text) over w x from chunks window w as (partition by path order by chunk_index, chunk_key))
 select chunk_key, md5(case when length(p) > 200 then substr(p, 1, 200) || '...' else p end) before, md5(case when length(x) > 200 then substr(x, 1, 200) || '...' else x end) after from n"""
)
def neighbour_context(spark, d):
    out = context.neighbours(table(spark, d, "chunks"), ["path"], ["chunk_index", "chunk_key"])
    return out.select("chunk_key", F.md5("previous_text").alias("before"), F.md5("next_text").alias("after"))


@query(
    """select chunk_key, md5(case when lag(text) over w is null then text else right(lag(text) over w, 150) || chr(10) || text end) digest from chunks window w as (partition by path order by chunk_index, chunk_key)"""
)
def overlap_prev(spark, d):
    out = context.overlapped(table(spark, d, "chunks"), ["path"], ["chunk_index", "chunk_key"])
    return out.select("chunk_key", F.md5("text_overlap").alias("digest"))


@query(
    """select f.file_id, f.parent_file, p.file_id parent_id, regexp_replace(f.parent_file, '\\.[^./]*$', '') || '-' || f.filename logical_path
 from (select distinct file_id, parent_file, filename from extractions where parent_file is not null) f left join (select original_path, min(file_id) file_id from extractions group by 1) p on p.original_path = f.parent_file"""
)
def attachments(spark, d):
    e = table(spark, d, "extractions")
    p = e.groupBy(F.col("original_path").alias("parent_file")).agg(F.min("file_id").alias("parent_id"))
    f = e.where("parent_file is not null").select("file_id", "parent_file", "filename").distinct()
    return f.join(p, "parent_file", "left").select("file_id", "parent_file", "parent_id", T.attachment_path("parent_file", "filename").alias("logical_path"))


# Questions --------------------------------------------------------------------------------------------------------------------------


def _pattern_sum(x, patterns):
    return " + ".join(f"regexp_matches({x}, {O.lit(understand.edged(p))})::int" for p in patterns)


def _first_best(names, prefix, none):
    top = "greatest(" + ", ".join(prefix + n for n in names) + ")"
    return "case " + " ".join(f"when {prefix}{n} = {top} and {top} > 0 then '{n}'" for n in names) + f" else '{none}' end"


def _by_intent(values, none):
    return "case intent " + " ".join(f"when '{k}' then {v}::double" for k, v in values.items()) + f" else {none}::double end"


_NORM = "trim(regexp_replace(trim(regexp_replace(question, '\\s+', ' ', 'g')), '[?!.]+$', ''))"
ANALYSE_SQL = (
    f"with a as (select distinct feedback_id, coalesce({_NORM}, '') qn, lower(coalesce({_NORM}, '')) q from feedback), b as (select *, "
    + ", ".join(f"round(least(1.0, ({_pattern_sum('q', p)}) / {max(1.0, 0.3 * len(p))}::double), 6) i_{k}" for k, p in understand.INTENTS.items())
    + ", "
    + ", ".join(f"({_pattern_sum('q', p)}) d_{k}" for k, p in understand.DOMAINS.items())
    + f", ({_pattern_sum('q', understand.COMPLEXITY['complex'])}) > 0 hard, ({_pattern_sum('q', understand.COMPLEXITY['moderate'])}) > 0 or len(list_filter(string_split(q, ' '), lambda w: w <> '')) > 20 fair from a)"
    + f", c as (select *, {_first_best(understand.INTENTS, 'i_', 'general')} intent, {_first_best(understand.DOMAINS, 'd_', 'general')} \"domain\", case when hard then 'complex' when fair then 'moderate' else 'simple' end complexity from b)"
)


@query(
    ANALYSE_SQL
    + f""" select feedback_id, intent, round(case when intent = 'general' then 0.5 else greatest({", ".join("i_" + k for k in understand.INTENTS)}) end, 6)::double intent_score, "domain", complexity,
 array_to_string(regexp_extract_all(qn, {O.lit(understand.ENTITY)}), '|') entities, {_by_intent({k: v[0] for k, v in understand.WEIGHTS.items()}, 0.6)} dense_weight,
 greatest(3, floor(10 * case when complexity = 'complex' then greatest(2.0::double, {_by_intent(understand.MULTIPLIERS, 1.0)}) else {_by_intent(understand.MULTIPLIERS, 1.0)} end)::int) top_k from c"""
)
def query_analysis(spark, d):
    out = understand.analyse(spread(table(spark, d, "feedback").select("feedback_id", "question"))).dropDuplicates(["feedback_id"])
    return out.select("feedback_id", "intent", F.round("intent_score", 6).alias("intent_score"), "domain", "complexity", F.array_join("entities", "|").alias("entities"), "dense_weight", "top_k")


_REF = "'(CS|AMC|GM)[0-9]{0,2}\\s+([0-9]+[A-Z]?(?:[.\\-][0-9]+[A-Za-z]?)?)'"


@query(
    ANALYSE_SQL
    + f""", v as (select feedback_id query_id, intent, "domain" dom, question q0, regexp_extract(question, {_REF}, 0) ref, regexp_extract(question, {_REF}, 1) base, regexp_extract(question, {_REF}, 2) num from c join (select distinct feedback_id, question from feedback where question is not null) using (feedback_id)),
 w as (select query_id, {O.distinct("list_filter([q0, case when ref <> '' then replace(q0, ref, case base when 'CS' then 'AMC' when 'AMC' then 'CS' else 'CS' end || ' ' || num) end, case when ref <> '' then replace(q0, ref, case base when 'CS' then 'GM' when 'AMC' then 'GM' else 'AMC' end || ' ' || num) end, case intent when 'definition' then case when not contains(lower(q0), 'qu''est-ce que') then 'définition ' || q0 end when 'requirement' then 'exigences ' || q0 when 'procedure' then 'procédure ' || q0 end, case intent when 'definition' then case when not contains(lower(q0), 'qu''est-ce que') then 'qu''est-ce que ' || q0 end when 'requirement' then 'conditions requises ' || q0 when 'procedure' then 'étapes ' || q0 end, case when dom = 'licensing' and not contains(lower(q0), 'fcl') then 'FCL ' || q0 when dom = 'operations' and not contains(lower(q0), 'ops') then 'OPS ' || q0 end], lambda x: x is not null)")}[1:5] l from v)
 select query_id, (generate_subscripts(l, 1) - 1)::int variant_no, unnest(l) variant from w"""
)
def query_variants(spark, d):
    rows = understand.analyse(feedback_rows(spark, d).where("question is not null")).withColumnRenamed("feedback_id", "query_id")
    return understand.variants(rows)


# Feedback ---------------------------------------------------------------------------------------------------------------------------

FB = """with f as (select * from (select *, row_number() over (partition by feedback_id order by received_at) rn from feedback) where rn = 1),
 p as (select *, coalesce(is_positive, case when coalesce(answer_quality,0) + coalesce(answer_completeness,0) + coalesce(answer_accuracy,0) > 0 then (coalesce(answer_quality,0) + coalesce(answer_completeness,0) + coalesce(answer_accuracy,0)) / 3.0 >= 3 else true end) good from f)"""


@query(
    FB
    + """, g as (select collection_name c, coalesce(user_name, '') u, cast(created_at as date) d, good::int p from p)
 select case when grouping(c) = 0 then 'collection' when grouping(u) = 0 then 'user' when grouping(d) = 0 then 'day' else 'all' end "level",
 case when grouping(c) = 0 then c when grouping(u) = 0 then u when grouping(d) = 0 then d::varchar else '' end "name", count(*) total, sum(p)::bigint positive, (count(*) - sum(p))::bigint negative, round(100.0::double * sum(p) / count(*), 1) satisfaction
 from g group by grouping sets ((c), (u), (d), ())"""
)
def feedback_stats(spark, d):
    return feedback.statistics(feedback_rows(spark, d))


@query(FB + " select feedback_id, question from p where not good order by created_at desc, feedback_id limit 20")
def negative_questions(spark, d):
    f = feedback_rows(spark, d)
    return f.where(~feedback.positive()).orderBy(F.desc("created_at"), "feedback_id").limit(20).select("feedback_id", "question")


@query(
    FB
    + """ select cast(created_at as date)::varchar "day", count(*) total, sum(good::int)::bigint positive, round(100.0::double * sum(good::int) / count(*), 1) rate from p where created_at >= (select max(created_at) from f) - interval 30 days group by 1"""
)
def feedback_trends(spark, d):
    return feedback.trends(feedback_rows(spark, d))


for _key in ("source_file", "chunk_id"):

    def _rel(spark, d, key=_key):
        return feedback.relevance(feedback_rows(spark, d), key)

    _rel.__name__ = {"source_file": "source_relevance", "chunk_id": "chunk_relevance"}[_key]
    query(FB + f", s as (select unnest(sources_feedback) s from f) select s.{_key} {_key}, count(*) votes, round(avg(s.relevance_score), 2) mean, round((avg(s.relevance_score) - 3) / 10, 3) boost from s where s.relevance_score > 0 and s.{_key} is not null group by 1")(_rel)


def _similar(spark, d):
    f = feedback_rows(spark, d)
    asked = f.where(F.substring("feedback_id", 3, 20).cast("long") % 20 == 0).select(F.col("feedback_id").alias("query_id"), "question")
    return feedback.similar_questions(asked, f.select(F.col("feedback_id").alias("other_id"), "question"), 0.6, 5)


SIM_SQL = (
    FB
    + """, t as materialized (select feedback_id id, list_distinct(list_filter(regexp_extract_all(lower(coalesce(question, '')), '[a-zàâäéèêëïîôùûüç0-9]+'), lambda w: length(w) >= 3)) t from f),
 j as (select a.id query_id, b.id other_id, len(list_intersect(a.t, b.t))::double / len(list_distinct(list_concat(a.t, b.t))) raw from t a, t b where substr(a.id, 3)::bigint % 20 = 0 and a.id <> b.id and len(a.t) > 0 and len(b.t) > 0),
 k as (select query_id, other_id, round(raw, 3) similarity from j where raw >= 0.6::double), r as (select *, row_number() over (partition by query_id order by similarity desc, other_id) - 1 rnk from k)"""
)


@query(SIM_SQL + " select query_id, other_id, similarity, rnk::int rank from r where rnk < 5")
def similar_questions(spark, d):
    return _similar(spark, d)


@query(SIM_SQL + " select query_id, round(sum(case when good then 0.1::double else -0.1::double end * similarity), 6) boost from r join p on p.feedback_id = r.other_id where rnk < 3 group by 1")
def feedback_boosts(spark, d):
    return feedback.rerank_boosts(_similar(spark, d), feedback_rows(spark, d))


# Answers ----------------------------------------------------------------------------------------------------------------------------


def answers(spark, d):
    return spread(table(spark, d, "cache_entries").select("entry_id", "question", "answer", "context_str", "sources")).select(
        F.col("entry_id").alias("id"), "question", "answer", F.col("context_str").alias("context"), F.array("context_str").alias("texts"), F.coalesce(F.transform("sources", lambda s: s["source_file"]), F.array().cast("array<string>")).alias("files")
    )


def _share_sql(found, of):
    return f"(case when len({of}) > 0 then len({found})::double / len({of}) else 0.0 end)"


_SENT = "list_filter(list_transform(regexp_split_to_array(answer, '[.!?]\\s+'), lambda s: trim(s)), lambda s: length(s) > 20)"
_CSENT = "list_filter(list_transform(regexp_split_to_array(context_str, '[.!?\\n]+'), lambda s: trim(s)), lambda s: length(s) > 30)[1:50]"
_QK = f"list_filter(list_distinct({O.words_like('question', '^[a-z]{3,}$')}), lambda w: not list_contains({O.many(evaluate.ASKING)}, w))"
_QW = f"list_distinct({O.words_like('question', '^[a-z]{4,}$')})"
_REFS = "list_distinct(list_transform(regexp_extract_all(answer, '(?i)(?:CS|AMC|GM)[\\s-]?[0-9]+(?:\\.[0-9]+)*'), lambda r: replace(upper(r), ' ', '-')))"
_UNSURE = " or ".join(f"contains(lower(answer), {O.lit(u)})" for u in evaluate.UNSURE)
_NOAC = "coalesce(answer, '') = '' or coalesce(context_str, '') = ''"
METRICS_SQL = f"""with m as (select entry_id id,
 round(case when {_NOAC} then 0.0 when len({_SENT}) = 0 then 0.5 else {_share_sql(f"list_filter({_SENT}, lambda s: len({O.words_like('s', '^[a-z]{4,}$')}) > 0 and len(list_filter({O.words_like('s', '^[a-z]{4,}$')}, lambda w: contains(lower(context_str), w)))::double / len({O.words_like('s', '^[a-z]{4,}$')}) > 0.5)", _SENT)} end::double, 6) faithfulness,
 round(case when coalesce(question, '') = '' or coalesce(answer, '') = '' then 0.0 when len({_QK}) = 0 then 0.5 else greatest(0.0, least(1.0, {_share_sql(f"list_filter({_QK}, lambda w: contains(lower(answer), w))", _QK)} * case when length(answer) < 50 then 0.5::double when length(answer) > 2000 then 0.8::double else 1.0::double end - case when {_UNSURE} then 0.3::double else 0.0::double end)) end::double, 6) answer_relevance,
 round(case when coalesce(question, '') = '' then 0.0 when len({_QW}) = 0 then 0.5 else case when len(list_filter({_QW}, lambda w: contains(lower(coalesce(context_str, '')), w)))::double / len({_QW}) > 0.3 then 1.0 else 0.0 end end::double, 6) context_precision,
 round(case when {_NOAC} then 0.0 when len({_CSENT}) = 0 then 0.5 else least(1.0, {_share_sql(f"list_filter({_CSENT}, lambda s: len({O.words_like('s', '^[a-z]{5,}$')}) >= 3 and len(list_filter({O.words_like('s', '^[a-z]{5,}$')}[1:5], lambda w: contains(lower(answer), w))) >= 2)", _CSENT)} * 2) end::double, 6) context_utilization,
 (case when coalesce(len(sources), 0) = 0 then 0.0 else case greatest(0, least(5, len(list_distinct(list_filter(list_transform(sources, lambda s: s.source_file), lambda f: coalesce(f, '') <> ''))))) when 5 then 1.0 when 4 then 0.8 when 3 then 0.8 when 2 then 0.6 when 1 then 0.4 else 0.2 end end)::double source_coverage,
 round(case when coalesce(answer, '') = '' then 0.5 when len({_REFS}) = 0 then 1.0 else len(list_filter({_REFS}, lambda r: contains(upper(coalesce(context_str, '')), r)))::double / len({_REFS}) end::double, 6) reference_accuracy,
 round(case when coalesce(answer, '') = '' then 0.0 when length(answer) < 50 then 0.3 else least(1.0, case when length(answer) > 500 then 1.0::double when length(answer) > 200 then 0.8::double when length(answer) > 100 then 0.6::double else 0.4::double end + case when regexp_matches(answer, '[-•*]\\s|[0-9]+[.)]\\s|:\\n') then 0.1::double else 0 end + case when regexp_matches(answer, '(?i)CS[\\s-]?[0-9]+|AMC[\\s-]?[0-9]+') then 0.1::double else 0 end) end::double, 6) completeness
 from cache_entries), o as (select *, round(faithfulness * 0.25::double + answer_relevance * 0.25::double + context_precision * 0.15::double + context_utilization * 0.15::double + reference_accuracy * 0.1::double + completeness * 0.1::double, 3) overall from m)"""
_METRICS = ("faithfulness", "answer_relevance", "context_precision", "context_utilization", "source_coverage", "reference_accuracy", "completeness", "overall")


@query(METRICS_SQL + " select * from o")
def answer_metrics(spark, d):
    return evaluate.metrics(answers(spark, d)).select("id", *_METRICS)


@query(METRICS_SQL + ", z as (select * from o order by id desc limit 500) select count(*) n, " + ", ".join(f"round(avg({k}), 3) mean_{k}" for k in (*evaluate.WEIGHTS, "overall")) + " from z")
def metrics_summary(spark, d):
    return evaluate.summary(evaluate.metrics(answers(spark, d)), "id", 500)


_SPLIT = "list_filter(list_transform(string_split(regexp_replace({x}, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) > 20)"
_GTOK = f"list_filter(regexp_split_to_array(translate(lower({{x}}), '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{{{{|}}}}~', ''), '[ \\t\\r\\n\\f]+'), lambda w: length(w) > 2 and not list_contains({O.many(evaluate.GROUNDING_STOPWORDS)}, w))".replace("{{", "{").replace("}}", "}")
GROUND_SQL = f"""with a as (select entry_id id, lower(coalesce(context_str, '')) ctx, {_SPLIT.replace("{x}", "answer")} l from cache_entries),
 b as (select id, ctx, (generate_subscripts(l, 1) - 1)::int pos, unnest(l) sentence from a), h as materialized (select id, list_distinct({_GTOK.replace("{x}", "ctx")}) held from a),
 c as (select b.*, held, {_GTOK.replace("{x}", "sentence")} tokens, list_concat(list_transform(list_filter(list_zip(regexp_extract_all(sentence, {O.lit(evaluate.NUMERIC)}, 1), regexp_extract_all(sentence, {O.lit(evaluate.NUMERIC)}, 2)), lambda z: regexp_matches(lower(z[2]), {O.lit(evaluate.UNITS)})), lambda z: z[1] || ' ' || z[2]), regexp_extract_all(sentence, {O.lit(evaluate.CLAIM)})) claims from b join h using (id)),
 e as (select *, len(claims)::int n_claims, len(list_filter(claims, lambda x: contains(ctx, lower(x)) or len(list_filter(regexp_extract_all(x, '[0-9]+(?:[.,][0-9]+)?'), lambda n: contains(ctx, n) or contains(ctx, replace(n, '.', ',')) or contains(ctx, replace(n, ',', '.')))) > 0))::int n_verified,
  case when len(tokens) = 0 then 1.0::double else len(list_filter(tokens, lambda w: list_contains(held, w)))::double / len(tokens) end overlap from c),
 s as (select id, pos, sentence, n_claims, n_verified, round(case when n_claims > 0 then 0.4::double * overlap + 0.6::double * n_verified / n_claims else overlap end, 6) score from e)"""


@query(GROUND_SQL + " select id, pos, md5(sentence) sentence, n_claims, n_verified, score, score >= 0.3 grounded from s")
def grounding_sentences(spark, d):
    return evaluate.grounding_sentences(answers(spark, d), "id", "answer", "context").withColumn("sentence", F.md5("sentence"))


@query(GROUND_SQL + ", r as (select id, count(*) sentences, sum((score >= 0.3)::int)::bigint grounded, round(avg(score), 6) score from s group by 1) select *, case when score >= 0.7 then 'low' when score >= 0.4 then 'medium' else 'high' end risk from r")
def grounding_report(spark, d):
    return evaluate.grounding_report(evaluate.grounding_sentences(answers(spark, d), "id", "answer", "context"))


@query()
def grounding_evidence(spark, d):
    return evaluate.evidence(answers(spark, d), "id", "answer", "context")


# Text quality and enrichment --------------------------------------------------------------------------------------------------------

_SHOWN = "length(regexp_replace(t, '[^\\p{L}\\p{N}\\p{P}\\p{S}\\p{M} \\n\\r\\t]', '', 'g'))"
#: DuckDB has no back-references: runs of five of each character that the tables have.
_REPEATED = "(?i)" + "|".join(("\\" + c if not c.isalnum() and ord(c) < 128 else c) + "{5,}" for c in [chr(i) for i in range(32, 127) if not 97 <= i <= 122] + list("\t\r\f\u00a0éèêëàâäáãìíïîòóôöõùúûüçñß–—•…«»°·“”’œ°"))
QUALITY_SQL = f"""with a as (select distinct file_id, coalesce(text, '') t, quality_score from extractions), b as (select *, greatest(length(t), 1)::double n from a),
 c as (select *, {_SHOWN} / n shown, length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) / n letters,
  ({O.count("t", "[ﬀﬁﬂﬃﬄ]{2,}")} > 3)::int + ({O.count("t", "[^\\p{L}\\p{N}_\\s.,;:!?'\"()-]{5,}")} > 3)::int + ({O.count("t", "(?i)[A-Z]{20,}")} > 3)::int + ({O.count("t", _REPEATED)} > 3)::int + (len({O.words_like("t", "^[bcdfghjklmnpqrstvwxz]{6,}$")}) > 3)::int noise,
  len({O.words_like("t", "^[a-zà-ÿ]{2,}$")}) / n * 1000 found, len(list_filter(string_split(t, chr(10)), lambda s: length(trim(s)) > 0 and length(trim(s)) < 5))::double / len(string_split(t, chr(10))) short from b),
 q as (select file_id, t, quality_score, case when t = '' then 0.0::double else greatest(0.0, least(1.0, 1.0::double - case when shown < 0.95 then (0.95::double - shown) * 2 else 0 end - case when letters < 0.5 then (0.5::double - letters) * 1.5::double else 0 end
  - noise * 0.1::double - case when found < 100 then (100 - found) / 200 else 0 end - case when short > 0.2 then (short - 0.2::double) * 0.5::double else 0 end)) end s from c)"""


@query(QUALITY_SQL + " select distinct file_id, round(s, 6) score, case when s >= 0.9 then 'excellent' when s >= 0.75 then 'good' when s >= 0.5 then 'fair' when s >= 0.25 then 'poor' else 'unusable' end \"level\", s < 0.5 to_ocr from q")
def extraction_quality(spark, d):
    rows = table(spark, d, "extractions").select("file_id", "text").distinct().withColumn("s", T.extraction_quality("text"))
    return rows.select("file_id", F.round("s", 6).alias("score"), T.quality_level(F.col("s")).alias("level"), (F.col("s") < 0.5).alias("to_ocr")).distinct()


@query(f"select doc_id, t = '' or length(t) < 500 or {_SHOWN} / greatest(length(t), 1)::double < 0.85 suspect from (select doc_id, coalesce(text, '') t from documents)")
def suspect_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.is_suspect("text").alias("suspect"))


@query(
    f"""select distinct document_id, page_number, round(case when n = 0 then 0.0 else greatest(0.0, 1.0 - (case when n < 100 then 0.3 when n < 500 then 0.1 else 0.0 end + least(0.4, 0.1 * {O.count("t", "\\[illisible\\]")}) + case when length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) / greatest(n, 1)::double < 0.3 then 0.2 else 0.0 end)) end::double, 6) confidence
 from (select document_id, page_number, coalesce(text, '') t, length(coalesce(text, '')) n from ocr_pages)"""
)
def ocr_confidence(spark, d):
    return table(spark, d, "ocr_pages").select("document_id", "page_number", F.round(T.ocr_confidence("text"), 6).alias("confidence")).distinct()


@query(
    """with p as (select distinct document_id, page_number, text, confidence from ocr_pages) select document_id, count(*) total_pages, count(case when coalesce(text, '') <> '' then 1 end) processed_pages, round(coalesce(avg(case when confidence > 0 then confidence end), 0), 6) avg_confidence,
 md5(coalesce(string_agg(case when coalesce(text, '') <> '' then '--- Page ' || page_number || ' ---' || chr(10) || text end, chr(10) || chr(10) order by page_number), '')) digest from p group by 1"""
)
def ocr_document(spark, d):
    p = table(spark, d, "ocr_pages").select("document_id", "page_number", "text", "confidence").distinct()
    full = F.coalesce("text", F.lit("")) != ""
    block = F.concat(F.lit("--- Page "), F.col("page_number").cast("string"), F.lit(" ---\n"), F.col("text"))
    out = p.groupBy("document_id").agg(
        F.count("*").alias("total_pages"), F.count(F.when(full, 1)).alias("processed_pages"), F.round(F.coalesce(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))), F.lit(0.0)), 6).alias("avg_confidence"),
        F.array_sort(F.collect_list(F.when(full, F.struct("page_number", block.alias("b"))))).alias("x"),
    )
    return out.select("document_id", "total_pages", "processed_pages", "avg_confidence", F.md5(F.array_join(F.transform("x", lambda v: v["b"]), "\n\n")).alias("digest"))


def vocabulary(spark, d):
    """The glossary's words (a fixed table of a few hundred rows; a list in an expression is no place for a large one)."""
    rows = table(spark, d, "glossary").select(F.explode(F.split(F.lower("term"), "[^a-zà-ÿ]+")).alias("w")).where("length(w) > 2").distinct()
    if (n := rows.count()) > 100_000:
        raise ValueError(f"a vocabulary of {n} words must be joined, not listed")
    return sorted(r.w for r in rows.collect())


_DW = O.words_like("t", "^[a-zà-ÿ]{2,}$")
_DS = "list_filter(list_transform(regexp_split_to_array(t, '[.!?]+'), lambda s: trim(s)), lambda s: s <> '')"
_REFP = T.REGULATION_REF
DENSITY_SQL = f"""with v as (select list(distinct w) v from (select unnest(regexp_split_to_array(lower(term), '[^a-zà-ÿ]+')) w from glossary) where length(w) > 2), a as (select chunk_key, text t from chunks),
 m as (select chunk_key, t, greatest(len({_DW}), 1)::double n, len(list_filter({_DW}, lambda w: list_contains(v, w))) tech, ({O.count("t", "[0-9]+(?:\\.[0-9]+)?")} + {O.count("t", "[=<>≤≥±×÷∑∏√∫]")} * 3) / greatest(length(t), 1)::double * 100 numeric_ratio,
  greatest(len({_DS}), 1)::double ns, list_sum(list_prepend(0, list_transform({_DS}, lambda s: length(s)))) total, {O.count("t", "(?m)^[ \\t]*[-*•][ \\t]+|\\([ ]*[a-z0-9]+[ ]*\\)|[0-9]+[.)][ ]+")} lists, {O.count("t", _REFP)} refs,
  len(list_filter(regexp_extract_all(t, {O.lit(T.WORDS)}), lambda w: regexp_matches(w, '^[A-Z]{{2,}}$'))) upper_n, {O.count("t", "[()\\[\\]{}]")} / greatest(length(t), 1)::double * 100 brackets from a, v),
 s as (select chunk_key, t, case when t is null or length(t) < 50 then 0.5::double else greatest(0.0, least(1.0, (tech / n * 2 + least(numeric_ratio, 5) / 5 * 1.5::double + least(lists / ns, 2) / 2 + least(refs / n * 100, 3) / 3 * 1.5::double + upper_n / n + least(brackets, 3) / 3 + (1 - least(total / ns, 200) / 200) * 0.5::double) / 8.5::double)) end s from m),
 k as (select chunk_key, s, case when t is null or length(t) < 50 then 'normal' when s >= 0.5 then 'very_dense' when s >= 0.3 then 'dense' when s >= 0.15 then 'normal' else 'sparse' end kind from s)"""


@query(DENSITY_SQL + " select chunk_key, round(s, 6) score, kind, greatest(600, least(2500, case kind when 'very_dense' then 800 when 'dense' then 1200 when 'normal' then 1500 else 2000 end))::int chunk_size from k")
def content_density(spark, d):
    s = T.density_score("text", vocabulary(spark, d))
    rows = spread(table(spark, d, "chunks").select("chunk_key", "text")).select("chunk_key", "text", s.alias("s")).withColumn("kind", T.density_type("text", F.col("s")))
    return rows.select("chunk_key", F.round("s", 6).alias("score"), "kind", T.adaptive_size(F.col("kind")).alias("chunk_size"))


@query(
    f"""select chunk_key, round((case when {O.count("t", "(?i)\\b(?:FCL|CAT|ORO|Part|AMC)\\.\\w+")} > 2 then 0.3 else 0 end + case when {O.count("t", "(?i)[0-9]+\\s*(?:heures?|h|ans?|jours?|mois|%)")} > 3 then 0.2 else 0 end + case when {O.count("t", "(?m)^\\s*[-–—•(]\\s*")} > 5 then 0.2 else 0 end
 + case when len(list_filter(x, lambda s: len(list_filter(regexp_split_to_array(s, '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '')) < 15)) / len(x)::double > 0.5 then 0.3 else 0 end)::double, 6) score
 from (select chunk_key, coalesce(text, '') t, regexp_split_to_array(coalesce(text, ''), '[.!?]') x from chunks)"""
)
def semantic_density(spark, d):
    return table(spark, d, "chunks").select("chunk_key", F.round(T.semantic_density("text"), 6).alias("score"))


_PHR = "list_transform(list_filter(regexp_extract_all(t, '[^.]*[.]'), lambda s: regexp_matches(s, {p})), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g'))"


@query(
    f"""with a as (select chunk_key, coalesce(text, '') t from chunks), b as (select chunk_key, {O.distinct(f"list_filter(list_concat({_PHR.replace('{p}', O.lit(T.DEFINES))}, {_PHR.replace('{p}', O.lit(T.REQUIRES))}), lambda s: length(s) > 20 and length(s) < 300)")}[1:5] l from a where length(t) >= 50) select chunk_key, unnest(l) phrase from b"""
)
def key_phrases(spark, d):
    return table(spark, d, "chunks").select("chunk_key", F.explode(T.key_phrases("text")).alias("phrase"))


def keywords_of(chunks: DataFrame, vocab, most: int = 10) -> DataFrame:
    """chunk_key, rank, keyword: up to three references (upper case, sorted), then the words with the highest weighted counts."""
    from pyspark.sql import Window

    t = chunks.where(F.length("text") >= 20)
    refs = t.select("chunk_key", F.slice(F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(T.REGULATION_REF), 0), F.upper))), 1, 3).alias("refs"))
    ws = t.select("chunk_key", F.posexplode(F.filter(T.words("text"), lambda w: w.rlike(r"^[a-zà-ÿ]{3,}$") & ~w.isin(T.CHUNK_STOPWORDS))).alias("pos", "w"))
    c = ws.groupBy("chunk_key", "w").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    score = F.round(F.col("n") * F.when(F.col("w").isin(vocab), 2.0).otherwise(1.0) * F.when(F.length("w") > 8, 1.3).otherwise(1.0), 6)
    r = c.withColumn("score", score).withColumn("r", F.row_number().over(Window.partitionBy("chunk_key").orderBy(F.desc("score"), "first")) - 1).where(F.col("r") < most)
    words = r.join(refs.select("chunk_key", F.size("refs").alias("k")), "chunk_key").where(F.col("r") < most - F.col("k")).select("chunk_key", (F.col("r") + F.col("k")).alias("rank"), F.col("w").alias("keyword"))
    return refs.select("chunk_key", F.posexplode("refs").alias("rank", "keyword")).unionByName(words)


@query(
    f"""with v as (select list(distinct w) v from (select unnest(regexp_split_to_array(lower(term), '[^a-zà-ÿ]+')) w from glossary) where length(w) > 2), t as (select chunk_key, text from chunks where length(text) >= 20),
 rf as (select chunk_key, list_sort(list_distinct(list_transform(regexp_extract_all(text, {O.lit(_REFP)}), lambda x: upper(x))))[1:3] refs from t),
 ws as (select chunk_key, unnest(l) w, generate_subscripts(l, 1) pos from (select chunk_key, list_filter({O.words_like("text", "^[a-zà-ÿ]{3,}$")}, lambda w: not list_contains({O.many(T.CHUNK_STOPWORDS)}, w)) l from t)),
 c as (select chunk_key, w, round(count(*) * case when list_contains(any_value(v), w) then 2.0::double else 1 end * case when length(w) > 8 then 1.3::double else 1 end, 6) score, min(pos) f from ws, v group by 1, 2),
 r as (select *, row_number() over (partition by chunk_key order by score desc, f) - 1 r from c)
 select chunk_key, (generate_subscripts(refs, 1) - 1)::int rank, unnest(refs) keyword from rf union all select r.chunk_key, (r + len(refs))::int, w from r join rf using (chunk_key) where r < 10 - len(refs)"""
)
def chunk_keywords(spark, d):
    return keywords_of(spread(table(spark, d, "chunks").select("chunk_key", "text")), vocabulary(spark, d)).select("chunk_key", "rank", "keyword")


@query(
    """select document_id, page_number, md5(trim(array_to_string(list_filter(string_split(text, chr(10)), lambda s: trim(s) = '' or not (regexp_matches(trim(s), '^[A-Z0-9]{1,3}$') or regexp_matches(trim(s), '(?i)^.*(?:printed copies|copie non tenu|all rights kept).*$'))), chr(10)))) digest from (select distinct document_id, page_number, text from ocr_pages)"""
)
def noise_clean(spark, d):
    return table(spark, d, "ocr_pages").select("document_id", "page_number", "text").distinct().select("document_id", "page_number", F.md5(T.clean_lines("text")).alias("digest"))


@query("select doc_id, md5(array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\\r?\\n'), lambda s: trim(regexp_replace(s, '[ \\t]+', ' ', 'g'))), lambda s: s <> ''), chr(10))) digest from documents")
def whitespace_normalise(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.single_spaces("text")).alias("digest"))


@query(
    """with a as (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n[ \\t\\r\\n]*\\n'), lambda s: regexp_replace(s, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')), lambda s: s <> '') p from documents where text is not null) select doc_id, (generate_subscripts(p, 1) - 1)::int pos, md5(unnest(p)) digest from a"""
)
def paragraph_split(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(T.paragraphs("text")).alias("pos", "p"))
    return rows.select("doc_id", "pos", F.md5("p").alias("digest"))


@query(
    """select doc_id, md5(trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(text, '(?is)<(script|style|noscript)[^>]*>.*?</(?:script|style|noscript)>', '', 'g'), '(?i)<br[ ]*/?>|</p>|</div>|</li>|</h[1-6]>|</tr>', chr(10), 'g'), '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \\t]+', ' ', 'g'), '\\n[ \\n]*\\n', chr(10) || chr(10), 'g'))) digest from documents"""
)
def html_to_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.html_text("text")).alias("digest"))


@query(
    """with p as (select distinct document_id, page_number, text from ocr_pages where coalesce(text, '') <> ''), l as (select document_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> '') l from p),
 n as (select document_id, count(*) pages from l group by 1), e as (select document_id, unnest(list_distinct([l[1], l[-1]])) line from l where len(l) > 0), c as (select document_id, line, count(*) n from e where length(line) > 2 group by 1, 2)
 select c.document_id, line, n from c join n using (document_id) where pages >= 3 and n >= floor(0.7 * pages)"""
)
def repeated_headers(spark, d):
    p = table(spark, d, "ocr_pages").select("document_id", "page_number", "text").where("coalesce(text, '') <> ''").distinct()
    lines = F.filter(F.transform(F.split("text", "\n"), lambda s: F.trim(s)), lambda s: s != "")
    rows = p.select("document_id", lines.alias("l"))
    pages = rows.groupBy("document_id").agg(F.count("*").alias("pages"))
    edge = rows.where(F.size("l") > 0).select("document_id", F.explode(F.array_distinct(F.array(F.element_at("l", 1), F.element_at("l", -1)))).alias("line")).where(F.length("line") > 2)
    c = edge.groupBy("document_id", "line").agg(F.count("*").alias("n"))
    return c.join(pages, "document_id").where((F.col("pages") >= 3) & (F.col("n") >= F.floor(0.7 * F.col("pages")))).select("document_id", "line", "n")


HEADER = r"(?i)^[ \t]*(?:BOOK[ \t]+[0-9]+[ \t]*[-–—][ \t]*|Appendix[ \t]+[A-Z0-9]+[ \t]*(?:to|[-–—])[ \t]*)?((CS|AMC|GM)(?:-[A-Z0-9]+|[0-9]{1,2})?)[ \-]+([0-9]+[A-Z]?(?:[.\-][0-9A-Za-z]+)*(?:\([0-9A-Za-z]+\))*)(?:[ \t]+([^\r\n]*))?[ \t\r]*$"


@query(
    f"""with l as (select doc_id, unnest(x) line, generate_subscripts(x, 1) no from (select doc_id, string_split(text, chr(10)) x from documents where text is not null)), h as (select *, regexp_matches(line, {O.lit(HEADER)}) head from l),
 s as (select *, sum(head::int) over (partition by doc_id order by no) sec from h)
 select doc_id, (sec - 1)::int section_no, max(case when head then regexp_extract(line, {O.lit(HEADER)}, 1) || ' ' || regexp_extract(line, {O.lit(HEADER)}, 3) end) section_id, max(case when head then trim(coalesce(regexp_extract(line, {O.lit(HEADER)}, 4), '')) end) title,
 md5(trim(coalesce(string_agg(case when not head then line end, chr(10) order by no), ''))) body from s where sec > 0 group by doc_id, sec"""
)
def section_split(spark, d):
    from foliary.operators.sections import split_sections

    out = split_sections(table(spark, d, "documents"), "doc_id", "text", HEADER)
    return out.select("doc_id", "section_no", "section_id", "title", F.md5("body").alias("body"))


# Tables -----------------------------------------------------------------------------------------------------------------------------


@query("select e.group_name, e.original_path from (select distinct group_name, original_path from extractions where original_path is not null) e where not exists (select 1 from incoming_chunks c where c.collection_name = e.group_name and regexp_replace(c.path, '/+', '/', 'g') = regexp_replace(e.original_path, '/+', '/', 'g'))")
def incremental_new(spark, d):
    """Files extracted that no delivery of their collection has."""

    def key(df, path):
        return df.withColumn("k", F.regexp_replace(path, "/+", "/"))

    e = key(table(spark, d, "extractions").select("group_name", "original_path").where("original_path is not null").distinct(), "original_path")
    c = key(table(spark, d, "incoming_chunks"), "path").select(F.col("collection_name").alias("group_name"), "k").distinct()
    return e.join(c, ["group_name", "k"], "left_anti").select("group_name", "original_path")


@query("select coalesce(nullif(trim(group_name), ''), 'ALL') grp, count(distinct original_path) n, md5(string_agg(distinct original_path, '|' order by original_path)) digest from extractions where coalesce(trim(original_path), '') <> '' group by 1")
def manifest_groups(spark, d):
    e = table(spark, d, "extractions").where("coalesce(trim(original_path), '') <> ''")
    rows = e.select(F.coalesce(F.nullif(F.trim("group_name"), F.lit("")), F.lit("ALL")).alias("grp"), "original_path").distinct()
    return rows.groupBy("grp").agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("original_path")), "|")).alias("digest"))


@query("select base_name, collection_name, source_file, count(*) n from chunks group by rollup (base_name, collection_name, source_file)")
def collection_counts(spark, d):
    return table(spark, d, "chunks").rollup("base_name", "collection_name", "source_file").agg(F.count("*").alias("n"))


@query("select collection_name, coalesce(boundary_type, '') boundary, count(*) n, min(length(text)) shortest, max(length(text)) longest, round(avg(length(text)), 2) mean from chunks group by 1, 2")
def chunk_stats(spark, d):
    n = F.length("text").cast("long")
    return table(spark, d, "chunks").groupBy("collection_name", F.coalesce("boundary_type", F.lit("")).alias("boundary")).agg(F.count("*").alias("n"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.round(F.avg(n), 2).alias("mean"))


@query("select s parent, count(*) pages, min(doc_id) first from (select doc_id, string_split(path, '/')[3] s from documents where path is not null and len(string_split(path, '/')) >= 4) group by 1")
def page_sections(spark, d):
    parts = F.split("path", "/")
    rows = table(spark, d, "documents").where(F.col("path").isNotNull() & (F.size(parts) >= 4)).select("doc_id", F.element_at(parts, 3).alias("parent"))
    return rows.groupBy("parent").agg(F.count("*").alias("pages"), F.min("doc_id").alias("first"))


@query(
    """with r as (select feedback_id || ':' || lpad(o::varchar, 4, '0') pos, chunk_id from (select distinct on (feedback_id) feedback_id, sources_feedback from feedback order by feedback_id), lateral (select unnest(sources_feedback).chunk_id chunk_id, generate_subscripts(sources_feedback, 1) - 1 o))
 select r.pos, c.chunk_key, c.text is not null has_text from r join (select chunk_id, min(chunk_key) chunk_key from chunks group by 1) m using (chunk_id) join chunks c using (chunk_key)"""
)
def get_by_ids(spark, d):
    from foliary.operators.tables import get_rows

    f = feedback_rows(spark, d).select("feedback_id", F.posexplode("sources_feedback").alias("o", "s"))
    ids = f.select(F.concat("feedback_id", F.lit(":"), F.lpad(F.col("o").cast("string"), 4, "0")).alias("pos"), F.col("s.chunk_id").alias("chunk_id"))
    return get_rows(table(spark, d, "chunks"), ids, "chunk_id", "chunk_key").select("pos", "chunk_key", F.col("text").isNotNull().alias("has_text"))


# Cache ------------------------------------------------------------------------------------------------------------------------------


@query(
    f"""with v as materialized (select entry_id, collection_name, list_transform(question_embedding, lambda x: (x::double / (len2 + 1e-12))::float) u from (select *, sqrt(list_sum(list_transform(question_embedding, lambda x: x::double * x::double))) len2 from cache_entries where {OK64}) where len2 > 0),
 m as (select q.entry_id query_id, c.entry_id, round({O.squared_l2("c.u", "q.u")}, 9) d from v q join v c on q.collection_name = c.collection_name and q.entry_id % 20 = 0 and q.entry_id <> c.entry_id),
 b as (select *, row_number() over (partition by query_id order by d, entry_id) rn from m) select query_id, entry_id, round(1 - d / 2, 6) similarity from b where rn = 1 and round(1 - d / 2, 6) >= 0.95"""
)
def cache_lookup(spark, d):
    e = spread(table(spark, d, "cache_entries").select("entry_id", "collection_name", "question_embedding"))
    q = e.where("entry_id % 20 = 0").select(F.col("entry_id").alias("query_id"), "collection_name", F.col("question_embedding").alias("embedding"))
    others = e.where("entry_id % 20 <> 0")
    near = cache.lookup(q, others, least=-1.0)
    # entries of the question set itself are looked up among one another without the entry asked about
    own = e.where("entry_id % 20 = 0")
    both = cache.lookup(q, own, least=-1.0, most=2).where("query_id <> entry_id")
    best = search.ranked(near.union(both), ["query_id"], [F.desc("similarity"), F.col("entry_id")], 1)
    return best.where("similarity >= 0.95").select("query_id", "entry_id", "similarity")


@query("with n as (select max(created_epoch) now from cache_entries) select entry_id, round(w, 9) worth from (select entry_id, round(hit_count / (greatest(0, now - created_epoch) + 1), 12) w from cache_entries, n) order by w, entry_id limit (select floor(count(*) * 0.1)::bigint from cache_entries)")
def cache_evict(spark, d):
    e = table(spark, d, "cache_entries")
    now = e.agg(F.max("created_epoch")).first()[0]
    return cache.evict(e, now).select("entry_id", F.round("worth", 9).alias("worth"))


@query("with n as (select max(created_epoch) now from cache_entries) select collection_name, count(*) entries, sum(hit_count)::bigint hits, sum((now - created_epoch > coalesce(ttl, 3600))::int)::bigint expired from cache_entries, n group by 1")
def cache_stats(spark, d):
    e = table(spark, d, "cache_entries")
    return cache.statistics(e, e.agg(F.max("created_epoch")).first()[0])


@query("select collection_name, entry_id, hit_count from (select *, row_number() over (partition by collection_name order by hit_count desc, entry_id) rn from cache_entries) where rn <= 10")
def cache_top(spark, d):
    return cache.top_hits(table(spark, d, "cache_entries")).select("collection_name", "entry_id", "hit_count")


# Chunking (sequential per text; tested against properties and small hand-made cases) ------------------------------------------------


def _chunked(name, make):
    def run(spark, d):
        from foliary.operators import chunking

        out = make(chunking, spread(table(spark, d, "documents").select("doc_id", "text", F.coalesce("source", F.lit("")).alias("source"))))
        return out.select("id", "chunk_no", F.length("text").alias("size"), F.md5("text").alias("digest"), "kind")

    run.__name__ = name
    query()(run)


_chunked("simple_chunk", lambda c, t: c.simple_chunks(t, "doc_id", "text"))
_chunked("block_chunk", lambda c, t: c.block_chunks(t, "doc_id", "text"))
_chunked("semantic_chunk", lambda c, t: c.semantic_chunks(t, "doc_id", "text"))
_chunked("adaptive_chunk", lambda c, t: c.adaptive_chunks(t, "doc_id", "text"))
_chunked("generic_chunk", lambda c, t: c.generic_chunks(t, "doc_id", "text", "source"))
_chunked("parent_child_chunk", lambda c, t: c.parent_child_chunks(t, "doc_id", "text", "source"))


@query()
def section_chunk(spark, d):
    from foliary.operators import chunking
    from foliary.operators.sections import split_sections

    s = split_sections(table(spark, d, "documents"), "doc_id", "text", HEADER)
    out = chunking.section_chunks(s, "doc_id", "body", "section_id", "title")
    return out.select("id", "chunk_no", F.length("text").alias("size"), F.md5("text").alias("digest"))


@query()
def parent_child_join(spark, d):
    from foliary.operators import chunking

    c = chunking.parent_child_chunks(table(spark, d, "documents").withColumn("source", F.col("doc_id").cast("string")), "doc_id", "text", "source")
    return context.parents(materialize(c.select("chunk_id", "parent_id", "text"), "chunks")).select("child", "parent", F.md5("parent_text").alias("digest"))


# More tables ------------------------------------------------------------------------------------------------------------------------


@query(
    f"""with e as (select chunk_key src, unnest({O.refers_to("text")}) ref from chunks), b as (select chunk_key dst, upper(unnest({O.section_refs("section_id")})) ref from chunks union select src, ref from e),
 m as (select distinct e.src, b.dst from e join b using (ref) where e.src <> b.dst), r as (select *, row_number() over (partition by src order by dst) - 1 rnk from m) select src, dst, rnk::int rank from r where rnk < 5"""
)
def related_chunks(spark, d):
    return context.related_chunks(table(spark, d, "chunks"), "chunk_key", "text", "section_id")


@query(
    FB
    + """ select feedback_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') created, coalesce(user_name, '') user_name, collection_name, regexp_replace(coalesce(question, ''), '[\\r\\n;]+', ' ', 'g') question, case when good then '👍' else '👎' end rating, regexp_replace(coalesce(suggested_answer, ''), '[\\r\\n;]+', ' ', 'g') suggested from p"""
)
def feedback_export(spark, d):
    return feedback.export_rows(feedback_rows(spark, d))


@query("select distinct group_name, left(regexp_replace(lower(regexp_replace(strip_accents(coalesce(group_name, '')), '[^A-Za-z0-9]+', '_', 'g')), '^_+|_+$', '', 'g'), 50) safe from extractions")
def collection_names(spark, d):
    return table(spark, d, "extractions").select("group_name", T.collection_name("group_name").alias("safe")).distinct()


@query("select chunk_key, concat_ws('_', source_file, left(regexp_replace(coalesce(section_id, 'semantic'), '[^A-Za-z0-9.()\\-]+', '_', 'g'), 50), chunk_index::varchar) made from chunks")
def chunk_ids(spark, d):
    return table(spark, d, "chunks").select("chunk_key", T.chunk_id("source_file", "section_id", "chunk_index").alias("made"))


@query(
    """select coalesce("method", '') "method", count(*) files, count(case when coalesce(text, '') <> '' and error is null then 1 end) extracted, count(case when error is not null then 1 end) failed, sum(length(coalesce(text, '')))::bigint chars
 from (select distinct file_id, "method", text, error from extractions) group by 1"""
)
def pipeline_stats(spark, d):
    e = table(spark, d, "extractions").select("file_id", "method", "text", "error").distinct()
    got = (F.coalesce("text", F.lit("")) != "") & F.col("error").isNull()
    return e.groupBy(F.coalesce("method", F.lit("")).alias("method")).agg(F.count("*").alias("files"), F.count(F.when(got, 1)).alias("extracted"), F.count("error").alias("failed"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
