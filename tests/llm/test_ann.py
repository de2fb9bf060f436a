"""Nearest neighbours against brute force."""

import numpy as np
from tidefold.llm import ann


def brute(rows, k, is_query):
    kept = {}
    for i, v in rows:  # of equal ids the least vector counts
        kept[i] = min(kept.get(i, tuple(v)), tuple(v))
    rows = [(i, np.array(v, dtype=np.float64)) for i, v in kept.items()]
    out = {}
    for i, v in rows:
        if is_query(i):
            near = sorted(((-float(v @ w), j) for j, w in rows if j != i and len(w) == len(v)))[:k]
            out[i] = [(j, -p) for p, j in near]
    return out


def compare(spark, rows, bad=(), least=0.9, **more):
    s = ann.Settings(k=5, cell=40, leaf=8, pack=16, **more)
    df = spark.createDataFrame([(i, [float(x) for x in v], 1, "x") for i, v in rows] + [(i, v, 1, "x") for i, v in bad], "vec_id long, embedding array<float>, rank int, cell string")
    rows = [(i, np.array(v, dtype=np.float32).tolist()) for i, v in rows]
    got = {}
    for r in ann.search_table(df, "id % 4 = 0", settings=s).orderBy("query_id", "rank").collect():
        assert r.rank == len(got.setdefault(r.query_id, [])) + 1
        got[r.query_id].append((r.id, r.score))
    want = brute(rows, 5, lambda i: i % 4 == 0)
    assert set(got) == {q for q, near in want.items() if near}
    found = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in got)
    total = sum(len(want[q]) for q in got)
    assert found >= least * total
    of = {}
    for i, v in rows:
        of[i] = min(of.get(i, v), v)
    for q, near in got.items():
        assert len(near) == len(want[q])
        scores = [p for _, p in near]
        assert scores == sorted(scores, reverse=True)
        for i, p in near:
            assert abs(p - float(np.dot(of[q], of[i]))) < 1e-9
    return got, want


def test_recall_and_invalid(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v) for i, v in enumerate(rng.standard_normal((600, 16)))]
    bad = [(1000, None), (1004, [0.0] * 16), (1008, [float("nan")] * 16), (1012, [None] * 16), (1016, [float("inf")] + [1.0] * 15), (None, [1.0] * 16), (1020, [])]
    compare(spark, rows, bad)


def test_clusters_and_unequal_norms(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 16)) * 3
    rows = [(i, centres[i % 12] * rng.uniform(0.2, 3) + rng.standard_normal(16) * 0.2) for i in range(500)]
    compare(spark, rows)


def test_copies_ties_and_few(spark):
    rng = np.random.default_rng(5)
    same = rng.standard_normal(8)
    rows = [(i, same) for i in range(200)] + [(200 + i, rng.standard_normal(8)) for i in range(20)]
    got, want = compare(spark, rows + rows[:3])
    for q in range(0, 200, 4):
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]  # the least other ids
    compare(spark, [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (4, [1.0, 1.0, 1.0])])
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.search_table(df, "id % 4 = 0").count() == 0


def test_quantile():
    assert abs(ann.Settings(dims=2, probability=0.95).quantile - 5.991) < 1e-3
    assert abs(ann.Settings(dims=8, probability=0.95).quantile - 15.507) < 1e-3


def test_ties_of_different_vectors(spark):
    """Equal products go to the least ids, within leaves and cells and across them."""
    rng = np.random.default_rng(6)
    rows = [(0, [1.0, 0.0, 0.0])] + [(i, [0.5, float(rng.uniform(-0.8, 0.8)), float(rng.uniform(-0.3, 0.3))]) for i in range(1, 200)]
    order = rng.permutation(200)
    got, _ = compare(spark, [rows[k] for k in order], probability=0.999)
    assert got[0] == [(i, 0.5) for i in range(1, 6)]


def test_ids_with_several_vectors(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.standard_normal(8)) for i in range(60)] + [(i, rng.standard_normal(8)) for i in range(0, 60, 3)]
    compare(spark, rows, probability=0.999)
