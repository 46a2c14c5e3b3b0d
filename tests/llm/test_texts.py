import random
import re

import pytest

from foliary.llm.packing import differencing, fill, pack_texts
from foliary.llm.splitting import BLANK, SplitPlan, split_text, split_texts
from foliary.llm.tokens import decode, encode, encode_texts, encoding, rank_file, safe_parts


@pytest.fixture(scope="module")
def enc():
    return encoding(rank_file())


def texts(n=150, seed=6):
    r = random.Random(seed)
    bits = ["word ", "Größe", "  ", "\n", "don't", "123", "😀", "<|endoftext|>", ". ", "́", "x" * 40, "\t", "'ll", "漢字"]
    return ["".join(r.choice(bits) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_encoding_round_trip_and_reference(enc):
    tokenizers = pytest.importorskip("tokenizers")
    from foliary.session import tokenizer_dir

    other = tokenizers.Tokenizer.from_file(f"{tokenizer_dir()}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    for t in texts():
        ids = encode(t, enc)
        assert decode(ids, enc) == t.encode() and ids.tolist() == other.encode(t, add_special_tokens=False).ids


def test_safe_parts_do_not_change_ids(enc):
    for t in texts(60):
        long = (t + " and so on") * 30
        parts = safe_parts(long, 50)
        assert "".join(parts) == long
        whole = enc.encode_ordinary(long)
        assert [i for p in parts for i in enc.encode_ordinary(p)] == whole


def test_encode_table(spark, enc):
    df = spark.createDataFrame([(1, "a b", 9), (2, None, 9), (3, "", 9), (3, "", 9), (None, "x", 9)], "doc_id long, text string, ids int")
    got = sorted([(r.doc_id is None, r.doc_id, r.ids) for r in encode_texts(df, "doc_id", "text").collect()], key=str)
    assert len(got) == 5 and (False, 2, []) in got and (False, 3, []) in got and (False, 1, enc.encode_ordinary("a b")) in got
    assert encode_texts(df.limit(0), "doc_id", "text").count() == 0


def test_differencing_is_even():
    r = random.Random(1)
    sizes = [r.randint(1, 900) for _ in range(400)]
    parts = differencing(sizes, 40)
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert sorted(i for p in parts for i in p) == list(range(400)) and max(sums) - min(sums) < 100
    places = fill(sizes, 2048)
    used = {}
    for s, w in zip(sizes, places):
        used[w] = used.get(w, 0) + s
    assert max(used.values()) <= 2048 and sum(sizes) / (2048 * len(used)) > 0.93
    assert fill([], 10) == [] and fill([10, 10], 10) == [0, 1] and fill([0], 10) == [0]


def test_pack_table(spark, enc):
    rows = [(i, "word " * (7 * i % 400)) for i in range(120)] + [(500, "long words here " * 3000), (501, None), (502, "")]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "id long, text string, container string, n_tokens int")
    got = pack_texts(df, "id", "text", 512, 8).collect()
    room, size = {}, {}
    for g in got:
        room[g.container] = room.get(g.container, 0) + g.n_tokens
        size[g.id] = size.get(g.id, 0) + g.n_tokens
    assert max(room.values()) <= 512 and size == {i: len(encode(t, enc)) for i, t in rows}
    assert sum(g.id == 500 for g in got) == -(-size[500] // 512) and sum(g.id == 5 for g in got) == 1
    assert pack_texts(df.limit(0), "id", "text").count() == 0


def test_split_properties():
    r = random.Random(2)
    plan = SplitPlan(60, 12, 20, 2)
    for _ in range(1500):
        t = "".join(r.choice(["a", "bc ", ". ", "\n", " ", "x" * r.randint(1, 70), "! ", "\r\n", "\t", "\f", "é; "]) for _ in range(r.randint(1, 100)))
        ps = split_text(t, plan)
        forced = max(len(x.strip(BLANK)) for x in re.split(r"[\r\n\f]|(?<=[.!?;:])[ \t]", t)) > 60
        assert all(0 < e - s <= 60 for s, e, _ in ps) and ps[0][0] == 0 and ps[-1][1] == len(t)
        assert all(a[0] < b[0] <= a[1] < b[1] for a, b in zip(ps, ps[1:])) and any(p[2] for p in ps) == forced


def test_split_table(spark):
    df = spark.createDataFrame([(1, "a. " * 1000, 1), (2, None, 1), (3, "", 1), (4, "short", 1)], "id long, text string, start int")
    assert {r.id for r in split_texts(df, "id", "text").collect()} == {1, 4}
    assert {r.id for r in split_texts(df, "id", "text", whole=False).collect()} == {1}
    assert split_texts(df.limit(0), "id", "text").count() == 0


def test_containers_do_not_depend_on_the_partitions(spark):
    from foliary.llm.packing import pack_texts

    rows = [(i % 180, "word " * (3 * i % 300) + str(i % 180)) for i in range(200)] + [(None, "x"), (5, None)]
    df = spark.createDataFrame(rows, "id long, text string")
    a, b = (sorted(map(repr, pack_texts(x, "id", "text", capacity=128, windows_per_group=4).collect())) for x in (df.coalesce(1), df.repartition(6)))
    assert a == b and len(a) > 200
