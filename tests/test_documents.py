import random
from collections import Counter
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from foliary import queries
from foliary.functions import segments as S
from foliary.functions import text as T
from foliary.operators import chunking, context, evaluate, search, sections
from foliary.sources import readers


def test_placing_units():
    assert S.place([10, 10, 10], 40, 5) == [([0, 1, 2], False)]
    assert S.place([30, 30, 100, 5], 40, 20) == [([0], False), ([1], False), ([2], True), ([3], False)]
    assert S.place([], 40, 5) == [] and S.place([5, 100, 5], 40, 20) == [([1], True), ([0, 2], False)]


def test_section_keeps_its_text():
    parts = [f"({c}) " + f"word{c} " * 60 for c in "abcdef"]
    out = S.section("CS 25.1", "Title", "\n".join(parts), 900, 200)
    assert all(p.text.startswith("[CS 25.1 - Title]\n\n") and len(p.text) <= 900 for p in out) and len(out) > 2
    assert [k for p in out for k in p.extra["markers"]] == [f"({c})" for c in "abcdef"]
    assert S.section("CS 25.1", "", "short")[0].extra["complete"] and S.section("a", "b", "  ") == []


def test_small_neighbouring_sections_share_a_chunk():
    long = "A sentence of the section is here. " * 20
    rows = [("CS 1", "CS", "One", "small a"), ("CS 2", "CS", "Two", "small b"), ("CS 3", "CS", "Three", long), ("CS 4", "CS", "", "small c"), ("CS 5", "CS", "E", "")]
    out = S.section_list(rows, 1500, 200)
    assert [p.extra["section_id"] for p in out] == ["CS 1 | CS 2", "CS 3", "CS 4"]
    assert out[0].text == "[CS 1 - One]\n\nsmall a\n\n---\n\n[CS 2 - Two]\n\nsmall b" and out[0].header == S.MERGED_TITLE and out[2].text == "[CS 4]\n\nsmall c"


def test_headers_and_density(spark):
    assert all(map(S.is_header, ["1.2 Scope", "GENERAL REQUIREMENTS", "Chapter IV - Rules"]))
    assert not any(map(S.is_header, ["1. The operator must check it", "x", "a" * 200, "plain words of a sentence"]))
    texts = ["See FCL.055 and CAT.OP and ORO.GEN. 3 h 4 h 5 h 6 h.", "", "One long sentence " + "of many words " * 20 + "ends here."]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [round(r[0], 6) for r in df.select(T.semantic_density("t")).collect()] == [S.dense_share(t) for t in texts]


def test_lexical_index_equals_postings(spark, tmp_path):
    corpus = spark.createDataFrame([(i, f"pump valve {'seal ' * (i % 4)} part{i % 7} CS 25.{i}") for i in range(300)] + [(900, None), (901, "")], "chunk_id long, text string")
    q = spark.createDataFrame([(1, "seal pump"), (2, "CS 25.7 valve seal seal"), (3, "nothing known")], "query_id long, question string")
    index = search.LexicalIndex(spark, f"file://{tmp_path}/ix")
    assert index.stale(corpus)
    index.build(corpus)
    assert not search.LexicalIndex(spark, f"file://{tmp_path}/ix").stale(corpus) and index.stale(corpus.limit(5))
    want = {(r.query_id, r.chunk_id, r["rank"], round(r.score, 6)) for r in search.bm25(q, search.postings(corpus), 10).collect()}
    for kw in ({}, {"block": 1}, {"per_pass": 1}):
        assert {(r.query_id, r.chunk_id, r["rank"], round(r.score, 6)) for r in index.search(q, 10, **kw).collect()} == want
    assert index.search(q.limit(0)).count() == 0


def test_dense_within_own_group_and_passes(spark):
    rows = [(i, f"g{i % 3}", [float(i), 1.0]) for i in range(30)]
    corpus = spark.createDataFrame(rows, "chunk_id long, g string, embedding array<float>")
    q = spark.createDataFrame([(i, f"g{i % 3}", [float(i), 1.0]) for i in range(6)], "query_id long, g string, embedding array<float>")
    got = {(r.query_id, r.chunk_id) for r in search.dense_top_k(q, corpus, 2, by=["g"], within=True).collect()}
    assert got == {(i, c) for i in range(6) for c in sorted((x for x, g, _ in rows if g == f"g{i % 3}"), key=lambda x: (abs(x - i), x))[:2]}
    one = {tuple(r) for r in search.dense_top_k(q, corpus, 3).collect()}
    assert {tuple(r) for r in search.dense_top_k(q, corpus, 3, per_pass=2).collect()} == one and len(one) == 18


def test_context_of_few_rows(spark):
    src = spark.createDataFrame([(1, 0, "a.txt", "CS 25.1", "T" * 50, 7, 0.5, "see CS 25.3", "c1"), (1, 1, "b.txt", None, None, 8, 0.25, None, "c2"), (1, 2, "c.txt", "CS-25.3", "", 9, 0.1, "x", "c1")], "query_id long, rank int, source_file string, section_id string, section_title string, chunk_id long, distance double, text string, collection string")
    text = context.context_blocks(src).first().context
    assert text.startswith(f"[source=a.txt, section=CS 25.1 ({'T' * 40}...), chunk=7, dist=0.500]\nsee CS 25.3\n\n[source=b.txt, chunk=8, dist=0.250]\n\n\n[source=c.txt, section=CS-25.3, chunk=9")
    assert [r.chunk_id for r in context.retrieved_references(src, first=2).collect()] == [9]
    assert context.collections_context(src).first().context.count("=== CONTEXTE") == 2 and context.context_blocks(src.limit(0)).count() == 0


def test_code_sections_and_repeated_lines(spark):
    df = spark.createDataFrame([(1, "intro CS 25.101 Title here\nbody AMC 25.5\nsecond line\nmore"), (2, "no code"), (3, None)], "id long, text string")
    got = [(r.id, r.section_no, r.code, r.title) for r in sections.code_sections(df, "id", "text").orderBy("id", "section_no").collect()]
    assert got == [(1, 0, "CS 25.101", "Title here"), (1, 1, "AMC 25.5", "second line"), (2, 0, "DOCUMENT", "")]
    pages = "\f".join(f"HEAD\nbody {i}\nFoot" for i in range(4))
    out = sections.without_repeated_lines(spark.createDataFrame([(1, pages), (2, "A\nb\fA\nc")], "id long, text string"), "id", "text")
    assert {r.id: r.text for r in out.collect()} == {1: "\f".join(f"body {i}" for i in range(4)), 2: "A\nb\fA\nc"}


def plain_without_repeated_lines(text, share=0.7, least_pages=3):
    pages = text.split("\f")
    if len(pages) < least_pages:
        return text
    pages = [p.replace("\r\n", "\n").replace("\r", "\n").split("\n") for p in pages]
    full = [[x.strip() for x in p if x.strip()] or [""] for p in pages]
    often = [{x for x, n in Counter(f[end] for f in full).items() if len(x) > 2 and n >= int(share * len(pages))} for end in (0, -1)]
    return "\f".join("\n".join(x for i, x in enumerate(p) if not (i == 0 and x.strip() in often[0] or i == len(p) - 1 and x.strip() in often[1])) for p in pages)


def test_repeated_lines_of_odd_pages(spark):
    texts = ["", " ", "\f\f", "\n\f \f\t\n", "a\r\nb", "\f".join(["HEAD"] * 3), "HEAD\na\fHEAD\nb\f\fHEAD\nc", "\nHEAD\na\fHEAD\nb\fHEAD\nc\f"]
    texts += ["HEAD\r\na\r\nFoot\r\f\u00a0HEAD\t\rb\n\u3000Foot\fHEAD\nc\nFoot", "Both\na\nx1\fBoth\nb\nx2\fx3\nc\nBoth\fx4\nd\nBoth", "ab\n1\fab\n2\fab\n3"]
    rng = random.Random(7)
    texts += ["\f".join("".join(rng.choice(["HEAD", " HEAD ", "Foot", "ab", "\u00e9t\u00e9", "", "\n", "\n", "\r\n", "\r", "\t", "\u00a0"]) for _ in range(rng.randint(0, 7))) for _ in range(rng.randint(1, 12))) for _ in range(400)]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "id long, text string")
    for kw in ({}, {"share": 0.3}, {"share": 0.1, "least_pages": 1}):
        out = {r.id: r.text for r in sections.without_repeated_lines(df, "id", "text", **kw).collect()}
        assert out == {-1: None} | {i: plain_without_repeated_lines(t, **kw) for i, t in enumerate(texts)}


def test_query_without_repeated_headers_on_blank_pages(spark, tmp_path):
    rows = [(1, ""), (2, None), (3, " \n"), (4, "HEAD\na\fHEAD\nb\f\fHEAD\nc"), (4, "HEAD\na\fHEAD\nb\f\fHEAD\nc")]
    spark.createDataFrame(rows, "file_id long, text string").write.parquet(f"{tmp_path}/extractions.parquet")
    got = sorted((r.file_id, r.digest) for r in queries.queries()["repeated_headers_removed"](spark, str(tmp_path)).collect())
    assert got == [(1, md5(b"").hexdigest()), (2, None), (3, md5(b" \n").hexdigest()), (4, md5(b"a\fb\f\fc").hexdigest())]


def test_metrics_store_and_readers(spark, tmp_path):
    store = f"file://{tmp_path}/metrics"
    assert evaluate.load_metrics(spark, store) is None
    for n in (1, 2):
        evaluate.store_metrics(spark.createDataFrame([(f"2024-01-0{n}", n / 4)], "timestamp string, overall double"), store)
    r = evaluate.store_summary(evaluate.load_metrics(spark, store), ["overall"]).first()
    assert (r.n, r.mean_overall, r["first"], r["last"]) == (2, 0.375, "2024-01-01", "2024-01-02")
    assert evaluate.store_summary(evaluate.load_metrics(spark, store), ["overall"], 1).first().mean_overall == 0.5
    (tmp_path / "list.csv").write_text('path;x\n"/a/b;c.xml";1\n/d/e.txt;2\n;3\n')
    paths = readers.paths_of_csv(spark, f"file://{tmp_path}/list.csv")
    assert {r.path for r in paths.collect()} == {"/a/b;c.xml", "/d/e.txt"} and {r.path for r in readers.xml_files(paths).collect()} == {"/a/b;c.xml"}
    with pytest.raises(ValueError):
        readers.paths_of_csv(spark, f"file://{tmp_path}/list.csv", "nope")
    files = spark.createDataFrame([(1, "a.pdf"), (2, "A.pdf"), (3, "b")], "i int, n string").withColumn("d", F.lit(1))
    assert [r.unique_name for r in readers.unique_names(files, ["d"], "n", ["i"]).orderBy("i").collect()] == ["a.pdf", "A_1.pdf", "b"]
    pages = spark.createDataFrame([(1, "T", ["A", "B"], "<p>x</p>")], "id int, title string, ancestors array<string>, html string")
    page = readers.page_texts(pages).first()
    assert page.path == "A > B > T" and page.text.startswith("# T\n\nx")


def test_small_text_rules(spark):
    r = spark.range(1).select(
        T.wiki_base(F.lit("https://w.org/wiki/spaces/AB/pages/1")).alias("w"), T.valid_path(F.lit("../x")).alias("p"), T.valid_path(F.lit("a/b..c")).alias("p2"), T.clean_file_name(F.lit("Été n° 1.pdf")).alias("f"),
        T.offline_context(F.lit("[source=a, chunk=3, dist=1]\nx\n\n\n\ny")).alias("o"), T.failed_answer(F.lit(None).cast("string")).alias("a"), T.sub_questions(F.lit("1. What is the limit?\nno"), F.lit("q")).alias("s"),
        T.ocr_route(F.lit(0.2), F.lit(True), F.lit(False), F.lit(0.1)).alias("r"),
    ).first()
    assert (r.w.base, r.w.context, r.p, r.p2, r.f, r.o, r.a, r.s, r.r) == ("https://w.org", "/wiki", False, True, "Ete_n_1.pdf", "x\n\ny", False, ["What is the limit?"], "classic_kept")
    df = spark.createDataFrame([(1, "A pump must be tested. " * 30, "s"), (2, None, "s"), (3, "short", "s")], "id long, text string, src string")
    out = chunking.adaptive_smart_chunks(df, "id", "text", "src", ["pump"]).collect()
    assert {x.id for x in out} == {1} and out[0].enriched_text.startswith("[Keywords: ") and out[0].text in out[0].enriched_text
