import numpy as np

from foliary.llm.vectors import ListIndex, ListPlan, nearest_vectors

SHAPE = "id long, v array<float>, rank int"


def test_recall_and_exact_cosines(spark):
    r = np.random.default_rng(4)
    centers = r.standard_normal((60, 64))
    x = np.concatenate([c + 0.25 * r.standard_normal((12, 64)) for c in centers]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], SHAPE)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(len(x)) for j in np.argsort(-s[i])[:5]}
    got = nearest_vectors(df, "id", "v", plan=ListPlan(rows_per_list=32, rows_per_unit=128)).collect()
    assert len({(g.a, g.b) for g in got} & want) / len(want) >= 0.95
    assert all(abs(g.cosine - s[g.a, g.b]) < 1e-5 for g in got)


def test_recall_of_far_neighbours_at_the_defaults(spark):
    x = np.random.default_rng(6).standard_normal((4000, 64)).astype(np.float32)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i, r in enumerate(np.argpartition(-s, 4, axis=1)[:, :5]) for j in r}
    got = nearest_vectors(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], SHAPE), "id", "v").collect()
    assert len({(g.a, g.b) for g in got} & want) / len(want) >= 0.9


def test_bad_rows_copies_and_empty(spark):
    one, two = [1.0] + [0.0] * 63, [1.0, 0.1] + [0.0] * 62
    rows = [(i, one, 0) for i in range(9)] + [(1, one, 0), (20, two, 0), (30, None, 0), (31, [0.0] * 64, 0), (32, [float("nan")] * 64, 0), (33, [1.0], 0), (None, one, 0), (34, [2.0 * x for x in one], 0)]
    df = spark.createDataFrame(rows, SHAPE)
    got = {}
    for g in nearest_vectors(df, "id", "v", k=3).collect():
        got.setdefault(g.a, []).append((g["rank"], g.b))
    assert sorted(got) == [*range(9), 20, 34]
    assert [b for _, b in sorted(got[5])] == [0, 1, 2] and [b for _, b in sorted(got[0])] == [1, 2, 3] and [b for _, b in sorted(got[20])] == [0, 1, 2]
    assert nearest_vectors(df.limit(0), "id", "v").count() == 0
    assert nearest_vectors(df.where("id = 20"), "id", "v").count() == 0


def test_graph_search_finds_the_nearest_lists():
    r = np.random.default_rng(2)
    x = r.standard_normal((20_000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ix = ListIndex.fit(x, 20_000 * 8, ListPlan(entries=8))
    ids, _ = ix.search(x[:500], 6)
    best = np.argsort(-(x[:500] @ ix.centroids.T), axis=1)[:, :6]
    assert len(ix.centroids) > 500 and np.mean([len({*a} & {*b}) / 6 for a, b in zip(ids, best)]) > 0.9


def test_the_index_does_not_depend_on_the_partitions(spark):
    x = np.random.default_rng(9).standard_normal((1500, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], SHAPE)
    a, b = ({(g.a, g.b) for g in nearest_vectors(y, "id", "v", plan=ListPlan(rows_per_list=16, per_list=4, probes=4)).collect()} for y in (df.coalesce(1), df.repartition(7)))
    assert a == b
