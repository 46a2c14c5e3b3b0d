"""Queries of context, sections, enrichment and routing over the given tables, with their SQL twins. Imported by foliary.queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliary.functions import text as T
from foliary.operators import cache, chunking, context, rerank, search, sections, understand
from foliary.plans import oracle as O
from foliary.queries import ANALYSE_SQL, HEADER, HYBRID_SQL, INDEX_SQL, QUALITY_SQL, answered, answered_questions, lexical, query, table, vocabulary
from foliary.session import scratch_path, spread
from foliary.sources import readers

# Context ----------------------------------------------------------------------------------------------------------------------------

FULL_SQL = f"""with {INDEX_SQL}, src as (select bm.query_id, bm.chunk_id, bm.rnk, c.text, c.collection_name collection, c.source_file, c.section_id, c.section_title, bm.rnk / 100.0::double distance
 from bm join chunks c on c.chunk_key = bm.chunk_id)"""
HEAD_SQL = """'[source=' || coalesce(source_file, '') || case when coalesce(length(section_id), 0) > 0 then ', section=' || section_id || case when length(section_title) > 40 then ' (' || substr(section_title, 1, 40) || '...)' when length(section_title) > 0 then ' (' || section_title || ')' else '' end else '' end
 || ', chunk=' || chunk_id || ', dist=' || printf('%.3f', distance) || ']' || chr(10) || coalesce(text, '')"""


def full_sources(spark, d, k=30):
    c = table(spark, d, "chunks").select(F.col("chunk_key").alias("chunk_id"), "text", F.col("collection_name").alias("collection"), "source_file", "section_id", "section_title")
    return lexical(spark, d, k).join(c, "chunk_id").withColumn("distance", F.col("rank") / 100.0)


@query(FULL_SQL + f" select query_id, md5(string_agg({HEAD_SQL}, chr(10) || chr(10) order by rnk, chunk_id)) digest from src group by 1")
def context_blocks(spark, d):
    return context.context_blocks(full_sources(spark, d)).select("query_id", F.md5("context").alias("digest"))


@query(
    FULL_SQL
    + f""", one as (select query_id, collection, '=== CONTEXTE ' || collection || ' ===' || chr(10) || string_agg({HEAD_SQL}, chr(10) || chr(10) order by rnk, chunk_id) part from src group by 1, 2)
 select query_id, md5(string_agg(part, chr(10) || chr(10) order by collection)) digest from one group by 1"""
)
def all_collections_context(spark, d):
    return context.collections_context(full_sources(spark, d)).select("query_id", F.md5("context").alias("digest"))


@query(
    FULL_SQL
    + f""", asked as (select distinct query_id, unnest({O.refers_to("text")}) ref from src where rnk < 15),
 later as (select query_id, chunk_id, rnk, regexp_replace(upper(section_id), '[\\s\\-]', '', 'g') ref from src where rnk >= 15),
 m as (select query_id, chunk_id, row_number() over (partition by query_id order by rnk, chunk_id) - 1 place from later semi join asked using (query_id, ref))
 select query_id, chunk_id, place::int place from m where place < 5"""
)
def retrieved_references(spark, d):
    return context.retrieved_references(full_sources(spark, d))


@query(
    """with n as (select chunk_key, coalesce(text, '') t, lag(coalesce(text, ''), 2) over w p2, lag(coalesce(text, ''), 1) over w p1, lead(coalesce(text, ''), 1) over w n1, lead(coalesce(text, ''), 2) over w n2 from chunks window w as (partition by path order by chunk_index, chunk_key))
 select chunk_key, md5(concat_ws(chr(10), case when p1 is not null then '[CONTEXTE PRÉCÉDENT]' || chr(10) || concat_ws(' ', substr(p2, 1, 200) || '...', substr(p1, 1, 200) || '...') || chr(10) end, '[CONTENU PRINCIPAL]' || chr(10) || t || chr(10),
  case when n1 is not null then '[CONTEXTE SUIVANT]' || chr(10) || concat_ws(' ', substr(n1, 1, 200) || '...', substr(n2, 1, 200) || '...') end)) digest from n"""
)
def neighbour_window(spark, d):
    out = context.neighbour_window(table(spark, d, "chunks"), ["path"], ["chunk_index", "chunk_key"], 2)
    return out.select("chunk_key", F.md5("expanded_text").alias("digest"))


@query(
    """with n as (select chunk_key, coalesce(text, '') t, lag(right(text, 100)) over (partition by path order by chunk_index, chunk_key) p from chunks)
 select chunk_key, md5(case when length(p) > 0 then '[...' || p || ']' || chr(10) || chr(10) || t else t end) digest from n"""
)
def previous_context(spark, d):
    out = context.with_previous(table(spark, d, "chunks"), ["path"], ["chunk_index", "chunk_key"])
    return out.select("chunk_key", F.md5("text_in_context").alias("digest"))


@query(FULL_SQL + " select query_id, md5(case when length(c) > 8000 then trim(substr(c, 1, 8000) || chr(10) || '[...]') else trim(c) end) digest from (select query_id, string_agg(coalesce(section_title, ''), ' ' order by rnk, chunk_id) c from src group by 1)")
def offline_context(spark, d):
    s = full_sources(spark, d).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", F.coalesce("section_title", F.lit("")).alias("t")))).alias("x"))
    return s.select("query_id", F.md5(T.offline_context(F.array_join(F.transform("x", lambda v: v["t"]), " "))).alias("digest"))


# Lexical index ----------------------------------------------------------------------------------------------------------------------


@query("select 'new' state, true stale union all select 'built', false union all select 'grown', (select count(*) > 0 from incoming_chunks) union all select 'later', true")
def bm25_stale(spark, d):
    """Whether an index is stale: before it is built, after, when the corpus has grown, and when a version is later than any indexed."""
    rows = table(spark, d, "chunks").select(F.col("chunk_key").alias("chunk_id"), "text", F.col("ingested_at").alias("v"))
    more = rows.union(table(spark, d, "incoming_chunks").select("incoming_id", "text", F.col("arrived_at")))
    later = rows.withColumn("v", F.col("v") + F.expr("interval 1 day"))
    index = search.LexicalIndex(spark, scratch_path(spark, "lexical"))
    said = [("new", index.stale(rows, "v"))]
    index.build(rows, version="v")
    again = search.LexicalIndex(spark, index.path)
    said += [("built", again.stale(rows, "v")), ("grown", again.stale(more, "v")), ("later", again.stale(later, "v"))]
    return spark.createDataFrame(said, "state string, stale boolean")


# Federated rerank -------------------------------------------------------------------------------------------------------------------


@query(
    HYBRID_SQL
    + """, fr as (select query_id, collection, chunk_id, distance, row_number() over (partition by query_id, collection order by distance, chunk_id) - 1 rnk from dd),
 fm as (select query_id, collection, concat_ws('::', collection, chunk_id::varchar) "key", round(sum(1 / (60 + rnk)::double), 12) rrf, avg(distance) distance, min(rnk) first from fr where rnk < 3 group by all),
 o as (select *, row_number() over (partition by query_id order by rrf desc, collection, first, "key") - 1 rnk from fm)
 select query_id, "key", (row_number() over (partition by query_id order by round(1 / (1 + distance), 6) desc, rnk) - 1)::int rank from o where rnk < 20 qualify row_number() over (partition by query_id order by round(1 / (1 + distance), 6) desc, rnk) <= 10"""
)
def federated_rerank(spark, d):
    found = search.dense_top_k(answered_questions(spark, d), answered(spark, d), 3, by=["collection"])
    return rerank.federated_rerank(search.federated_fuse(found, 10), F.round(1 / (1 + F.col("distance")), 6), 10).select("query_id", "key", "rank")


# Sections and chunks ----------------------------------------------------------------------------------------------------------------

FORM = sections.CODE_FORMS["all"]
CODES_SQL = f"""with p as (select doc_id, string_split(regexp_replace(text, {O.lit(FORM)}, chr(1) || '\\1', 'g'), chr(1)) p from documents where text is not null),
 r as (select doc_id, len(p) > 1 has, unnest(case when len(p) > 1 then p[2:] else p end) body, generate_subscripts(case when len(p) > 1 then p[2:] else p end, 1) - 1 section_no from p),
 c as (select *, regexp_extract(body, {O.lit(FORM)}, 1) code0 from r), l as (select *, string_split(substr(body, length(code0) + 1), chr(10)) x from c),
 t as (select *, trim(regexp_replace(coalesce(x[1], ''), '[\r\t]', ' ', 'g')) t1, trim(regexp_replace(coalesce(x[2], ''), '[\r\t]', ' ', 'g')) t2 from l),
 s as (select doc_id, section_no, case when has then upper(code0) else 'DOCUMENT' end code, case when has then substr(case when t1 <> '' then t1 else t2 end, 1, 100) else '' end title, trim(body) body from t)"""


def _codes(spark, d):
    return sections.code_sections(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


@query(CODES_SQL + " select doc_id, section_no::int section_no, code, title, md5(body) digest from s")
def xml_sections(spark, d):
    return _codes(spark, d).select("doc_id", "section_no", "code", "title", F.md5("body").alias("digest"))


@query(CODES_SQL + " select doc_id, section_no::int section_no, md5(code || case when title <> '' then ' - ' || title else '' end || chr(10) || chr(10) || body) digest from s where length(body) >= 50")
def xml_section_chunks(spark, d):
    return sections.code_section_chunks(_codes(spark, d)).select("doc_id", "section_no", F.md5("text").alias("digest"))


@query(CODES_SQL + " select doc_id, section_no::int section_no, code, substr(title, 1, 50) title, length(body)::int length, md5(substr(regexp_replace(body, '[ \t\n\x0b\f\r]+', ' ', 'g'), 1, 150)) preview from s")
def xml_summary(spark, d):
    return sections.section_summary(_codes(spark, d), "doc_id").withColumn("preview", F.md5("preview"))


@query()
def merged_sections(spark, d):
    s = sections.split_sections(table(spark, d, "documents"), "doc_id", "text", HEADER).withColumn("kind", F.regexp_extract("section_id", "^[A-Za-z]+", 0))
    out = chunking.merged_section_chunks(s, "doc_id")
    return out.select("id", "chunk_no", "section_id", F.length("text").alias("size"), F.md5("text").alias("digest"), F.size("merged").alias("merged"))


@query()
def adaptive_smart_chunk(spark, d):
    rows = spread(table(spark, d, "documents").select("doc_id", "text", F.coalesce("source", F.lit("")).alias("source")))
    out = chunking.adaptive_smart_chunks(rows, "doc_id", "text", "source", vocabulary(spark, d))
    return out.select("id", "chunk_no", "density_type", "chunk_size", F.size("keywords").alias("n_keywords"), F.md5("enriched_text").alias("digest"))


_META = "(regexp_matches(t, '(?m)^(?:[0-9]+\\.)+\\s+[A-ZÀÉÈ]') or regexp_matches(t, '(?mi)^(?:Article|Chapitre|Chapter)\\s+[0-9]+') or regexp_matches(t, '(?mi)^(?:CS|AMC|GM)(?:[0-9]{0,2}|-[A-Z]+)?[\\s\\-]+[0-9]+') or regexp_matches(t, '(?m)^(?:Annex|Annexe|Appendix|APPENDIX)\\s+[A-Z0-9]+'))".replace("\\\\", "\\")


@query(
    f"""select chunk_key, {_META} has_header, ({O.count("t", "(?m)^\\s*[-–—•]\\s+")} + {O.count("t", "(?m)^\\s*\\([a-z]\\)\\s+")} + {O.count("t", "(?m)^\\s*[0-9]+\\)\\s+")})::int list_items,
 len({O.distinct("regexp_extract_all(t, '(?i)\\b(?:FCL|CAT|ORO|NCO|AMC|GM|CS|Part)[.\\-]?[0-9]+(?:\\.[A-Z]+\\.[0-9]+)?')")})::int n_refs, round(len(list_filter(regexp_split_to_array(t, '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '')) / greatest(length(t), 1)::double, 6) word_density
 from (select chunk_key, coalesce(text, '') t from chunks)""".replace("\\\\", "\\")
)
def chunk_metadata(spark, d):
    m = table(spark, d, "chunks").select("chunk_key", T.chunk_metadata("text").alias("m"))
    return m.select("chunk_key", F.col("m.has_header").alias("has_header"), F.col("m.list_items").cast("int").alias("list_items"), F.size("m.refs").alias("n_refs"), F.round("m.word_density", 6).alias("word_density"))


@query("select chunk_key, md5(case when len(keywords) > 0 then '[Keywords: ' || array_to_string(keywords, ' | ') || ']' || chr(10) || chr(10) || coalesce(text, '') else coalesce(text, '') end) digest from chunks")
def chunk_enriched(spark, d):
    return table(spark, d, "chunks").select("chunk_key", F.md5(T.enriched(F.coalesce("text", F.lit("")), F.col("keywords"))).alias("digest"))


_FAMILIES = ", ".join(f"list_transform(regexp_extract_all(t, {O.lit(p)}, 1), lambda x: {{'ref': regexp_replace(upper(x), '[\\s\\-]', '', 'g'), 'family': {O.lit(n)}, 'position': strpos(t, x)}})" for n, p in T.REFERENCE_FAMILIES).replace("\\\\", "\\")


@query(
    f"""with a as (select chunk_key, list_concat({_FAMILIES}) x from (select chunk_key, coalesce(text, '') t from chunks)), u as (select chunk_key, unnest(x) r, generate_subscripts(x, 1) n from a),
 f as (select chunk_key, r.ref ref, r.family family, r.position "position", n, row_number() over (partition by chunk_key, r.ref order by n) k from u) select chunk_key, ref, family, "position"::int "position" from f where k = 1"""
)
def reference_families(spark, d):
    rows = table(spark, d, "chunks").select("chunk_key", F.explode(T.references("text")).alias("r"))
    return rows.select("chunk_key", "r.ref", "r.family", "r.position")


@query()
def repeated_headers_removed(spark, d):
    out = sections.without_repeated_lines(table(spark, d, "extractions").select("file_id", "text").distinct(), "file_id", "text")
    return out.select("file_id", F.md5("text").alias("digest"))


# Text and routing -------------------------------------------------------------------------------------------------------------------

_LANG = {k: f"len(list_filter({O.words('text')}, lambda w: list_contains({O.many(v)}, w)))" for k, v in T.FUNCTION_WORDS.items()}


@query(
    f"""with n as (select distinct file_id, text, {", ".join(f"{v} n_{k}" for k, v in _LANG.items())} from extractions)
 select file_id, case when text is null or length(text) < 50 or greatest({", ".join("n_" + k for k in _LANG)}) = 0 then 'unk' {" ".join(f"when n_{k} = greatest({', '.join('n_' + x for x in _LANG)}) then '{k}'" for k in _LANG)} end "language" from n"""
)
def language_detect(spark, d):
    return spread(table(spark, d, "extractions").select("file_id", "text").distinct()).select("file_id", T.language("text").alias("language"))


@query(f"select distinct file_id, regexp_replace(regexp_replace(translate(coalesce(filename, ''), '{T.ACCENTS[0]}', '{T.ACCENTS[1]}'), '[^A-Za-z0-9._\\-]+', '_', 'g'), '^_+|_+$', '', 'g') clean_name from extractions".replace("\\\\", "\\"))
def file_name_clean(spark, d):
    return table(spark, d, "extractions").select("file_id", T.clean_file_name("filename").alias("clean_name")).distinct()


@query(
    QUALITY_SQL
    + """, o as (select file_id, s, coalesce(quality_score, 0) conf, extension = '.pdf' or extension = 'pdf' engine, file_id % 7 = 0 forced from q join (select distinct file_id fid, extension from extractions) on fid = file_id)
 select distinct file_id, case when not coalesce(engine, false) then case when s < 0.5 then 'classic_fallback' else 'classic' end when forced then 'llm_ocr' when s >= 0.5 then 'classic' when conf > s then 'llm_ocr' else 'classic_kept' end route from o"""
)
def ocr_routing(spark, d):
    e = table(spark, d, "extractions").select("file_id", "text", "quality_score", "extension").distinct()
    engine = F.coalesce(F.col("extension").isin(".pdf", "pdf"), F.lit(False))
    return e.select("file_id", T.ocr_route(T.extraction_quality("text"), engine, F.col("file_id") % 7 == 0, F.coalesce("quality_score", F.lit(0.0))).alias("route")).distinct()


@query("select distinct feedback_id, coalesce(contains(answer_text, 'ERREUR DE COMMUNICATION AVEC LE LLM') or contains(answer_text, 'Le serveur n''a pas pu répondre') or contains(answer_text, 'Veuillez reposer votre question'), false) failed from feedback")
def failed_answers(spark, d):
    return table(spark, d, "feedback").select("feedback_id", T.failed_answer("answer_text").alias("failed")).distinct()


@query("select feedback_id, part_no::int part_no, part from (select feedback_id, unnest(p) part, generate_subscripts(p, 1) - 1 part_no from (select feedback_id, case when len(g) > 0 then g[1:5] else [question] end p from (select distinct feedback_id, question, list_filter(list_transform(string_split(coalesce(answer_text, ''), chr(10)), lambda s: trim(regexp_replace(s, '^[ \t]*(?:[0-9]+[.)]|[-*•])[ \t]*', ''))), lambda s: length(s) > 10) g from feedback)))")
def sub_questions(spark, d):
    f = table(spark, d, "feedback").select("feedback_id", "question", "answer_text").distinct()
    return f.select("feedback_id", F.posexplode(T.sub_questions("answer_text", "question")).alias("part_no", "part"))


@query("select file_id, filename, unique_name from (select file_id, filename, case when n = 0 then filename else regexp_extract(filename, '^(.*?)([.][^.]*)?$', 1) || '_' || n || regexp_extract(filename, '^(.*?)([.][^.]*)?$', 2) end unique_name from (select file_id, filename, row_number() over (partition by group_name, lower(filename) order by file_id) - 1 n from (select distinct file_id, group_name, filename from extractions)))")
def unique_file_names(spark, d):
    files = table(spark, d, "extractions").select("file_id", "group_name", "filename").distinct()
    return readers.unique_names(files, ["group_name"], "filename", ["file_id"]).select("file_id", "filename", "unique_name")


@query("select distinct incoming_id from incoming_chunks where path is not null and incoming_id % 3 = 0 and regexp_replace(path, '/+', '/', 'g') not in (select regexp_replace(path, '/+', '/', 'g') from incoming_chunks where incoming_id % 3 = 1 and path is not null)")
def missing_files(spark, d):
    """Paths of one delivery that another, taken as the listing, does not have."""
    i = table(spark, d, "incoming_chunks").where("path is not null").select("incoming_id", "path")
    return readers.missing_files(i.where("incoming_id % 3 = 0"), i.where("incoming_id % 3 = 1")).select("incoming_id").distinct()


@query("select s section, count(*) pages, min(doc_id) first from (select doc_id, string_split(path, '/')[2] s from documents where path is not null and len(string_split(path, '/')) >= 3) group by 1")
def pages_by_section(spark, d):
    return readers.pages_by_section(table(spark, d, "documents").where("path is not null").select(F.col("doc_id").alias("id"), "path"), sep="/")


@query("select base_name, count(distinct feedback_id) n from feedback where base_name = (select min(base_name) from feedback) group by 1")
def feedback_of_base(spark, d):
    f = table(spark, d, "feedback")
    return readers.feedback_of(f, f.agg(F.min("base_name")).first()[0]).groupBy("base_name").agg(F.countDistinct("feedback_id").alias("n"))


@query("with n as (select max(created_epoch) now from cache_entries), e as (select case when hit_count > 0 then 'hit' else 'miss' end ev from cache_entries union all select 'evict' from cache_entries, n where now - created_epoch > coalesce(ttl, 3600)) select count(*) filter (ev = 'hit') hits, count(*) filter (ev = 'miss') misses, count(*) filter (ev = 'evict') evictions, round(count(*) filter (ev = 'hit') / (count(*) filter (ev <> 'evict'))::double, 3) hit_rate from e")
def cache_events(spark, d):
    e = table(spark, d, "cache_entries")
    now = e.agg(F.max("created_epoch")).first()[0]
    log = e.select(F.when(F.col("hit_count") > 0, "hit").otherwise("miss").alias("event")).union(e.where(F.lit(now) - F.col("created_epoch") > F.coalesce("ttl", F.lit(3600.0))).select(F.lit("evict")))
    return cache.event_statistics(log)


@query("select count(*) n from cache_entries where collection_name is distinct from (select min(collection_name) from cache_entries)")
def cache_invalidate(spark, d):
    e = table(spark, d, "cache_entries")
    return cache.invalidate(e, e.agg(F.min("collection_name")).first()[0]).agg(F.count("*").alias("n"))


_ORDER = "list_sort([" + ", ".join(f"{{'s': -i_{k}, 'n': {n}, 'k': '{k}'}}" for n, k in enumerate(understand.INTENTS)) + "])"
_SECTIONS = "case intent " + " ".join(f"when '{k}' then '{'|'.join(v)}'" for k, v in understand.SECTIONS.items()) + " else '' end"


@query(
    ANALYSE_SQL
    + f""" select feedback_id, array_to_string(list_transform(list_filter({_ORDER}[2:3], lambda x: x.s < 0), lambda x: x.k), '|') secondary, {_SECTIONS} sections,
 intent in ('definition', 'requirement', 'reference', 'factual') exact_match, intent = 'comparison' or complexity = 'complex' reword, intent = 'factual' recent from c"""
)
def search_hints(spark, d):
    out = understand.analyse(spread(table(spark, d, "feedback").select("feedback_id", "question"))).dropDuplicates(["feedback_id"])
    return out.select("feedback_id", F.array_join("secondary_intents", "|").alias("secondary"), F.array_join("filter_sections", "|").alias("sections"), "exact_match", "reword", "recent")


@query(
    QUALITY_SQL.replace(" shown,", " shown, ", 1)
    + """ select distinct file_id, case when t = '' then '' else concat_ws('|', case when shown < 0.85 then 'unprintable' end, case when letters < 0.4 then 'few_letters' end, case when found < 50 then 'few_words' end, case when short > 0.3 then 'short_lines' end) end issues from q join (select file_id, t, shown, letters, found, short from c) using (file_id, t)"""
)
def extraction_issues(spark, d):
    rows = table(spark, d, "extractions").select("file_id", T.extraction_issues("text").alias("i")).distinct()
    shared = ("unprintable", "few_letters", "few_words", "short_lines")
    return rows.select("file_id", F.array_join(F.filter("i", lambda x: x.isin(*shared)), "|").alias("issues")).distinct()
