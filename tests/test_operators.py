"""Hand-made cases and properties of the core operators."""

import random

from pyspark.sql import functions as F

from foliary.functions import segments as S
from foliary.functions import text as T
from foliary.functions import vectors as V
from foliary.operators import cache, context, feedback, rerank, search, tables, understand
from foliary.operators.components import connected_components
from foliary.operators.sections import split_sections
from foliary.plans import pipeline
from foliary.plans.providers import embed, hash_embedder


def test_sections_golden(spark):
    from foliary.queries import HEADER

    df = spark.createDataFrame([(1, "before\nCS 25.613  Fatigue\nbody\nAMC1 25.631\nx"), (2, None), (3, "")], "id int, t string")
    got = [tuple(r) for r in split_sections(df, "id", "t", HEADER).orderBy("id", "section_no").collect()]
    assert got == [(1, 0, "CS 25.613", "Fatigue", "body"), (1, 1, "AMC1 25.631", "", "x")]


def test_refs_match(spark):
    df = spark.createDataFrame([("CS 25.11", False), ("CS 25.1(a)", True), ("CS-25.1", True), ("X | CS 25.1", True), (None, False)], "s string, ok boolean")
    got = df.select("ok", T.refs_match(T.section_refs("s"), F.array(F.lit("cs25.1"))).alias("m")).collect()
    assert all(r.ok == r.m for r in got)


def test_tokens(spark):
    df = spark.createDataFrame([("physics 3 the CS 25.613(a)",), (None,), ("",)], "t string")
    got = [r.x for r in df.select(T.index_tokens("t").alias("x")).collect()]
    assert got[0] == ["cs-3", "cs-25.613(a)", "physics", "cs", "25", "613"] and got[1] == [] and got[2] == []


def test_bm25_and_fuse(spark):
    corpus = spark.createDataFrame([(1, "valve pump"), (2, "pump"), (3, None), (4, "")], "chunk_id long, text string")
    q = spark.createDataFrame([(9, "pump pump valve"), (8, "nothing here")], "query_id long, question string")
    got = search.bm25(q, search.postings(corpus)).collect()
    assert [(r.query_id, r.chunk_id, r["rank"]) for r in got] == [(9, 1, 0), (9, 2, 1)]
    one = spark.createDataFrame([(9, 1, 0)], "query_id long, chunk_id long, rank int")
    f = search.fuse(one, one, 5).first()
    assert abs(f.rrf - 1.1 / 60) < 1e-9 and f.distance == 0


def test_dense_handles_bad_vectors_and_ties(spark):
    c = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [1.0]), (5, [float("nan"), 0.0]), (6, [0.0, 1.0])], "chunk_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, embedding array<float>")
    got = [(r.query_id, r.chunk_id, r.distance) for r in search.dense_top_k(q, c, 2).collect()]
    assert got == [(1, 1, 0.0), (1, 2, 0.0)]
    assert search.dense_top_k(q.limit(0), c, 2).count() == 0


def test_lost_in_middle(spark):
    df = spark.createDataFrame([(1, i) for i in range(7)], "query_id int, rank int")
    want = {"alternating": [0, 2, 4, 6, 5, 3, 1], "bookends": [0, 1, 2, 4, 5, 6, 3], "reverse_middle": [0, 1, 3, 2, 4, 5, 6]}
    for how, order in want.items():
        got = [r["rank"] for r in rerank.lost_in_middle(df, how).orderBy("position").collect()]
        assert got == order, how


def test_polarity(spark):
    df = spark.createDataFrame([(None, 3, 3, 3, True), (None, 0, 0, 0, True), (None, 1, 1, 1, False), (False, 5, 5, 5, False)], "is_positive boolean, answer_quality int, answer_completeness int, answer_accuracy int, want boolean")
    assert all(r.p == r.want for r in df.select("want", feedback.positive().alias("p")).collect())


def test_keyword_filter_falls_back(spark):
    df = spark.createDataFrame([(1, "a valve"), (1, "b"), (2, "c")], "query_id int, text string")
    got = rerank.keyword_filter(df, F.array(F.lit("valve"))).collect()
    assert sorted((r.query_id, r.text) for r in got) == [(1, "a valve"), (2, "c")]


def test_neighbours_and_get_rows(spark):
    df = spark.createDataFrame([("s", 1, "x" * 300), ("s", 2, "b"), ("t", 1, "c")], "src string, n int, text string")
    got = {(r.src, r.n): r for r in context.neighbours(df, ["src"], ["n"]).collect()}
    assert got["s", 2].previous_text == "x" * 200 + "..." and got["t", 1].previous_text is None
    ids = spark.createDataFrame([(0, "t"), (1, "zz"), (2, "s")], "pos int, src string")
    assert [(r.pos, r.n) for r in tables.get_rows(df, ids, "src", "n").orderBy("pos").collect()] == [(0, 1), (2, 1)]


def test_components(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 501), (7, 7), (None, 3), (501, 500)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len(got) == 203 and set(got.values()) == {0, 500}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([float("nan"), 1.0],)], "v array<float>")
    rows = df.select(V.norm("v").alias("n"), V.usable("v", 2).alias("ok"), V.fixed_length("v", 3).alias("f")).collect()
    assert rows[0].n == 5 and [r.ok for r in rows] == [True, False, False] and len(rows[0].f) == 3


def test_intents(spark):
    df = spark.createDataFrame([("Qu'est-ce que la fatigue ?", "definition"), ("how to replace the pump", "procedure"), ("hello", "general"), (None, "general")], "question string, want string")
    assert all(r.intent == r.want for r in understand.analyse(df).collect())


def test_cache_put_and_evict(spark):
    unit = lambda i: [1.0 if j == i else 0.0 for j in range(64)]
    shape = "entry_id long, collection_name string, question_embedding array<float>, hit_count int, created_epoch double, ttl double"
    old = spark.createDataFrame([(1, "c", unit(0), 5, 10.0, None), (2, "c", unit(1), 0, 0.0, 5.0)], shape)
    new = spark.createDataFrame([(3, "c", unit(0), 0, 20.0, None), (4, "c", unit(2), 0, 20.0, None)], shape)
    got = {r.entry_id: r.hit_count for r in cache.put(old, new).collect()}
    assert got == {2: 0, 3: 5, 4: 0}
    assert [r.entry_id for r in cache.evict(old, 20.0, 0.5).collect()] == [2]
    assert [r.entry_id for r in cache.alive(old, 100.0).collect()] == [1]


def test_chunkers_hold_their_bounds():
    r = random.Random(3)
    for _ in range(60):
        words = ["word%d" % r.randint(0, 50) for _ in range(r.randint(0, 900))]
        text = "".join(w + r.choice([" ", " ", ". ", "\n\n", "; "]) for w in words)
        assert all(len(b) <= 200 for b in S.blocks(text, 200))
        assert "".join("".join(S.blocks(text, 200)).split()) == "".join(text.split())
        for p in S.semantic(text, 400, 100, 800, 50):
            assert len(p.text) <= 800
        starts = [p.start for p in S.semantic(text, 400, 100, 800, 50)]
        assert starts == sorted(set(starts))
        joined = " ".join(S.simple(text, 300, 0))
        assert "".join(joined.split()) == "".join(text.split())
        S.generic(text, "f"), S.parent_child(text, "f"), S.section("CS 1", "t", text), S.adaptive(text)
    assert S.simple("") == [] and S.semantic("") == [] and S.generic("  ") == [] and S.parent_child("", "f") == []


def test_chunk_goldens():
    assert S.paragraphs_of("a\n\n b \n \nc") == ["a", "b", "c"]
    assert S.overlapped(["abc", "def"], 2) == ["abc", "bc\ndef"]
    assert [k for k, _ in S.subsections("intro\n(a) one\n(b) two")] == ["", "(a)", "(b)"]
    assert S.block_kind("| a | b |\n|---|---|\n| 1 | 2 |") == "table" and S.block_kind("- a\n- b") == "list" and S.is_header("1. Introduction")


def test_pipeline(spark):
    docs = spark.createDataFrame([(1, "The pump must be tested every 30 days. " * 20, "a.txt"), (2, "The valve is replaced after 10 cycles. " * 20, "b.txt"), (3, None, "c.txt")], "doc long, text string, source string")
    corpus = pipeline.ingest(docs, "doc", "text", "source", target=300).withColumn("collection", F.lit("c")).withColumn("section_id", F.lit(None).cast("string"))
    q = spark.createDataFrame([(1, "When is the pump tested?"), (2, "valve replaced")], "query_id long, question string")
    got = {r.query_id: r for r in pipeline.ask(q, corpus, 3).collect()}
    assert "pump" in got[1].answer and "valve" in got[2].answer and 0 <= got[1].overall <= 1
    asked = embed(q, "question", hash_embedder(), "query")
    assert pipeline.ask_collections(asked, corpus, 2).count() == 2


def test_append_and_delete(spark, tmp_path):
    p = str(tmp_path / "store")
    c = spark.createDataFrame([("b", "c", 1, [1.0, 2.0]), ("b", "d", 2, None)], "base_name string, collection_name string, id int, embedding array<float>")
    tables.append_chunks(c, p, 2)
    assert spark.read.parquet(p).count() == 2
    tables.rebuild_collections(c.where("id = 1"), p)
    assert spark.read.parquet(p).count() == 2
    assert tables.delete_collection(spark, p, "b", "c") == 1 and spark.read.parquet(p).count() == 1


def test_table_text_and_urls(spark):
    df = spark.createDataFrame([([["a", "bb"], ["ccc", None]],)], "rows array<array<string>>")
    assert df.select(T.table_text(F.col("rows")).alias("t")).first().t == "| a   | bb |\n| --- | -- |\n| ccc |    |"
    u = spark.createDataFrame([("https://example.org/a", True), ("http://localhost/x", False), ("ftp://example.org", False), ("http://10.1.2.3/", False), (None, False), ("nonsense", False)], "u string, want boolean")
    assert all(r.ok == r.want for r in u.select("want", T.safe_url("u").alias("ok")).collect())


def test_hyde_and_variations(spark):
    corpus = embed(spark.createDataFrame([(1, "the pump is tested"), (2, "the valve leaks")], "chunk_id long, text string"), "text", hash_embedder())
    q = spark.createDataFrame([(1, "pump test")], "query_id long, question string")
    h = spark.createDataFrame([(1, "the pump is tested by the crew after every landing of the aircraft")], "query_id long, text string")
    assert pipeline.hyde(q, corpus, h, 2).orderBy("rank").first().key == "1"
    r = spark.createDataFrame([(1, "q", "short\n1. a numbered line here\nhow is the pump tested\n")], "query_id long, question string, reply string")
    assert [x.variant for x in pipeline.parsed_variations(r).orderBy("variant_no").collect()] == ["q", "how is the pump tested"]
