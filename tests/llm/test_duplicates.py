import random

import pytest

from foliary.llm.history import HashForest, known_incoming, settle
from foliary.llm.near_duplicates import near_duplicate_groups, near_duplicate_pairs
from foliary.llm.signatures import ForestPlan, likeness, signature_table


def corpus(seed=1, n=60):
    """Random texts, of which some are edited, copied or shuffled; and short ones."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        ws = [r.choice(vocab) for _ in range(r.randint(25, 90))]
        out.append(ws)
        for _ in range(r.randint(0, 3)):
            edit = list(ws)
            for _ in range(r.randint(0, len(ws) // 5)):
                edit[r.randrange(len(edit))] = r.choice(vocab)
            if r.random() < 0.3:
                r.shuffle(edit)
            out.append(edit)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


def groups_by_force(rows, threshold=0.75, least=20):
    rows = [(i, t) for i, t in rows if t is not None and len(t.split()) >= least]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(rows):
        for j, b in rows[:n]:
            if likeness(a, b) >= threshold:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i, _ in rows}


def test_likeness_counts_repeats():
    assert likeness("a a b", "a b b") == 2 / 4 and likeness("", "") == 0 and likeness("A-b", "a B") == 1


@pytest.mark.parametrize("window", [64, 2])
def test_groups_equal_brute_force(spark, window):
    rows = corpus()
    want = groups_by_force(rows)
    df = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "id long, text string, key string, keys long")
    got = {r.id: r.group_id for r in near_duplicate_groups(df, "id", "text", window=window).collect()}
    several = {i: g for i, g in want.items() if sum(x == g for x in want.values()) > 1}
    assert got == several


def test_pairs_nulls_repeats_and_empty(spark):
    t = " ".join(f"w{i}" for i in range(30))
    rows = [(1, t), (1, t), (2, t.upper()), (3, None), (4, ""), (5, "short text"), (None, t), (6, t + " more"), (7, "y " * 200_000)]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {tuple(r) for r in near_duplicate_pairs(df, "id", "text").collect()}
    assert got == {(1, 2), (1, 6), (2, 6)}
    assert near_duplicate_pairs(df.limit(0), "id", "text").count() == 0


def test_known_incoming_equals_brute_force(spark):
    rows = corpus(5, 50)
    old, new = rows[:60], [(i, n % 4, t) for n, (i, t) in enumerate(rows[60:])]
    new += [(900, 3, rows[61][1]), (901, 0, None), (902, 0, "few words")]
    want, kept = set(), []
    for b, i, t in sorted((b, i, t) for i, b, t in new):
        if t is None or len(t.split()) < 20:
            continue
        if any(likeness(t, o) >= 0.75 for _, o in old) or any(likeness(t, o) >= 0.75 for o in kept):
            want.add(i)
        else:
            kept.append(t)
    h = spark.createDataFrame([(i, t, 1) for i, t in old], "id long, text string, batch int")
    n = spark.createDataFrame([(i, b, t) for i, b, t in new], "id long, batch int, text string")
    assert {r.id for r in known_incoming(h, n, "id", "id", "batch").collect()} == want
    assert {r.id for r in known_incoming(h.limit(0), n.limit(0), "id", "id", "batch").collect()} == set()


def test_settle_follows_arrival(spark):
    order = spark.createDataFrame([(i, i) for i in range(6)], "id long, place int")
    links = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (4, 5)], "a long, b long")
    known = spark.createDataFrame([(4,)], "id long")
    assert {r.id for r in settle(order, links, known).collect()} == {1, 3, 4}


def test_forest_append_and_merge_give_the_same(spark, tmp_path):
    rows = corpus(9, 20)
    df = spark.createDataFrame(rows, "id long, text string")
    plan = ForestPlan()
    signed = signature_table(df, "id", "text", plan)
    one = HashForest(spark, f"file://{tmp_path}/one", plan)
    one.append(signed)
    two = HashForest(spark, f"file://{tmp_path}/two", plan)
    two.append(signed.where("id % 2 = 0"))
    two.append(signed.where("id % 2 = 1"))
    find = lambda f: {(r.a, r.b) for r in f.probe(signed).collect()}
    want = find(one)
    assert find(two) == want and {(i, i) for i, _ in rows} <= want
    two.merge()
    assert find(two) == want
    assert HashForest(spark, f"file://{tmp_path}/none", plan).probe(signed).count() == 0


def test_crowded_family_is_settled_by_its_first(spark):
    """More near copies than a crowd holds, in the batch alone and against a crowded history."""
    r = random.Random(8)
    base = [f"w{i}" for i in range(60)]

    def copy():
        ws = list(base)
        for _ in range(3):
            ws[r.randrange(60)] = f"e{r.randrange(10_000)}"
        return " ".join(ws)

    family = [(i, i % 3, copy()) for i in range(150)]
    other = [(1000 + i, 0, " ".join(f"o{i}x{j}" for j in range(30))) for i in range(5)]
    new = spark.createDataFrame(family + other, "id long, batch int, text string")
    none = spark.createDataFrame([], "id long, text string")
    got = {x.id for x in known_incoming(none, new, "id", "id", "batch").collect()}
    kept, want = [], set()
    for b, i, t in sorted((b, i, t) for i, b, t in family + other):
        if any(likeness(t, o) >= 0.75 for o in kept):
            want.add(i)
        else:
            kept.append(t)
    assert got == want
    old = spark.createDataFrame([(i, copy()) for i in range(120)], "id long, text string")
    assert {x.id for x in known_incoming(old, new, "id", "id", "batch").collect()} == {i for i, _, _ in family}


def texts_for(seed, n, start):
    r = random.Random(seed)
    return [(start + i, " ".join(r.choice([f"v{j}" for j in range(900)]) for _ in range(r.randint(25, 60)))) for i in range(n)]


def edited(text, r, words):
    ws = text.split()
    for _ in range(words):
        ws[r.randrange(len(ws))] = f"n{r.randrange(10**6)}"
    return " ".join(ws)


def test_forest_persists_over_sessions_and_follows_the_batch(spark, tmp_path):
    """Reopened, appended to, merged: the same answers as without a forest, ids as they are given."""
    r, path = random.Random(3), f"file://{tmp_path}/kept"
    old = texts_for(1, 120, 0)
    first = [(i, i % 2, edited(t, r, 2) if i % 3 == 0 else " ".join(f"z{i}w{k}" for k in range(30))) for i, t in old[:40]]  # ids as in the history
    second = [(500 + i, 0, edited(t, r, 1)) for i, _, t in first[1:3]] + [(600, 0, old[77][1]), (601, 1, edited(old[80][1], r, 2)), (602, 1, None)]
    h = spark.createDataFrame(old, "id long, text string")
    one, two = (spark.createDataFrame(x, "id long, b long, text string") for x in (first, second))
    HashForest(spark, path).add(h, "id", "text")
    with_forest = {x.id for x in known_incoming(None, one, "id", "id", "b", forest=HashForest(spark, path)).collect()}
    assert with_forest == {x.id for x in known_incoming(h, one, "id", "id", "b").collect()} == {i for i, _, _ in first if i % 3 == 0}
    accepted = [(1000 + i, t) for i, _, t in first if i not in with_forest]
    kept = HashForest(spark, path)
    kept.add(spark.createDataFrame(accepted, "id long, text string"), "id", "text")
    assert len(kept.runs) == 2
    want = {x.id for x in known_incoming(h.union(spark.createDataFrame(accepted, "id long, text string")), two, "id", "id", "b").collect()}
    assert want == {501, 502, 600, 601}
    assert {x.id for x in known_incoming(None, two, "id", "id", "b", forest=HashForest(spark, path)).collect()} == want
    again = HashForest(spark, path)
    again.merge()
    assert len(again.runs) == 1 and {x.id for x in known_incoming(None, two, "id", "id", "b", forest=HashForest(spark, path)).collect()} == want
    with pytest.raises(ValueError):
        HashForest(spark, path, ForestPlan(threshold=0.8))


def test_recall_against_brute_force_at_several_thresholds(spark):
    r = random.Random(6)
    base = texts_for(4, 40, 0)
    rows = [(n * 100 + k, edited(t, r, k)) for n, (_, t) in enumerate(base) for k in range(7)]
    df = spark.createDataFrame(rows, "id long, text string")
    for threshold in (0.6, 0.75, 0.9):
        links = {(a, b) for n, (a, x) in enumerate(rows) for b, y in rows[n + 1 : n + 8] if likeness(x, y) >= threshold}
        groups = {x.id: x.group_id for x in near_duplicate_groups(df, "id", "text", ForestPlan(threshold=threshold)).collect()}
        met = sum(groups.get(a, a) == groups.get(b, -b) for a, b in links)
        assert len(links) > 50 and met / len(links) >= 0.98, threshold


def test_hot_prefix_is_cut_and_still_whole(spark):
    """A family that fills its prefixes, cut into parts and finished in blocks, gives one group; so does a crowd of unlike texts give none."""
    r = random.Random(12)
    t = " ".join(f"h{i}" for i in range(60))
    rows = [(i, edited(t, r, 2)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {x.id: x.group_id for x in near_duplicate_groups(df, "id", "text", window=8, hot=20).collect()}
    assert got == {i: 0 for i in range(300)}
