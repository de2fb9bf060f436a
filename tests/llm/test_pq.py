"""Links, components and counts against all pairs."""

import math

import numpy as np
import pytest
from tidefold.llm import pq


def slow(rows, similarity=0.95):
    vs = []
    for key, v in rows:
        ok = key is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        vs.append(np.array(v, dtype=float) / max(abs(x) for x in v) if ok else None)
    n, root = [0] * len(rows), list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(vs):
        for j, b in enumerate(vs):
            if i != j and a is not None and b is not None and len(a) == len(b) and a @ b >= similarity * np.sqrt((a @ a) * (b @ b)):
                n[i] += 1
                root[top(i)] = top(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[top(i)] = min(least.get(top(i), key), key)
    return sorted(((key, n[i], least.get(top(i)), key is not None and key == least[top(i)]) for i, (key, _) in enumerate(rows)), key=str)


def found(spark, rows, s, kind="float"):
    df = spark.createDataFrame([(k, v, "x", 1) for k, v in rows], f"vec_id long, embedding array<{kind}>, key string, `n links` int")
    return sorted((tuple(r) for r in pq.near_duplicates(df, "vec_id", "embedding", s).select("id", "n_links", "component_id", "kept").collect()), key=str)


def groups(rng, count, dims, copies, noise):
    """Centres, each with near copies; some centres lie near each other."""
    out = []
    for _ in range(count):
        c = rng.standard_normal(dims)
        out += [(c + noise * np.linalg.norm(c) / math.sqrt(dims) * rng.standard_normal(dims)).tolist() for _ in range(rng.integers(1, copies))]
    return out


@pytest.mark.parametrize(("dims", "block"), [(16, 2048), (16, 5), (3, 64)])
def test_against_all_pairs(spark, dims, block):
    rng = np.random.default_rng(dims + block)
    vectors = groups(rng, 40, dims, 8, 0.2)
    rows = [(1000 - 7 * k, v) for k, v in enumerate(vectors)]
    got, want = found(spark, rows, pq.Settings(per_cell=10, block=block, reach=100), "double"), slow(rows)
    assert got == want and sum(r[1] for r in want) > 100


def test_recall_of_the_probes(spark):
    """The settings in force miss next to nothing, and link nothing that is not near."""
    rng = np.random.default_rng(1)
    rows = list(enumerate(groups(rng, 300, 32, 9, 0.28)))
    got, want = found(spark, rows, pq.Settings(per_cell=16), "double"), slow(rows)
    counts = lambda x: {r[0]: r[1] for r in x}
    g, w = counts(got), counts(want)
    assert all(g[k] <= w[k] for k in w) and sum(g.values()) >= 0.99 * sum(w.values()) > 300


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    base = [1.0, 2.0, 3.0]
    rows = [
        (5, base), (4, base), (4, base), (3, [2.0, 4.0, 6.0]), (9, [1.0, 2.0, 3.01]), (None, base), (10, None), (11, []), (12, [0.0, 0.0, 0.0]), (13, [nan, 1.0, 1.0]), (14, [inf, 1.0, 1.0]),
        (15, [None, 1.0, 1.0]), (16, [1.0, 2.0]), (17, [1.0, 2.0]), (18, [-1.0, -2.0, -3.0]), (19, [1e-30, 2e-30, 3e-30]), (20, [1e30, 2e30, 3e30]), (21, [0.0, 1.0]), (22, [-0.0, 1.0]), (23, [7.0]), (2, [5.0]),
    ]
    assert found(spark, rows, pq.Settings()) == slow(rows)


def test_copies(spark):
    """A vector that makes up a third of all rows is one class; a crowd of different near copies meets in blocks."""
    rng = np.random.default_rng(2)
    one = rng.standard_normal(8)
    rows = [(k, one.tolist()) for k in range(300)] + [(1000 + k, (one + 0.01 * rng.standard_normal(8)).tolist()) for k in range(120)] + [(2000 + k, rng.standard_normal(8).tolist()) for k in range(200)]
    assert found(spark, rows, pq.Settings(block=16, per_cell=50), "double") == slow(rows)


def test_lengths_that_the_sample_does_not_know(spark):
    rng = np.random.default_rng(4)
    rows = list(enumerate(groups(rng, 20, 6, 5, 0.1) + groups(rng, 20, 5, 5, 0.1)))
    assert found(spark, rows, pq.Settings(sample=0), "double") == slow(rows)


def test_table_lookup_loses_nothing():
    """What the table says is within the code's own error of the distance."""
    rng = np.random.default_rng(6)
    points = rng.standard_normal((500, 20))
    points /= np.linalg.norm(points, axis=1)[:, None]
    s = pq.Settings(codes=16)
    book = pq.fit(points, 4, s)
    own, near = pq.probes(points, book, s)
    codes, off = pq.encode(points - book.centroids[own], book)
    for cell in range(4):
        inside = own == cell
        said = pq.looked_up(points - book.centroids[cell], codes[inside], book)
        real = np.sqrt(pq._distances(points, points[inside]))
        assert (np.abs(said - real) <= off[inside][None, :] + 1e-3).all()
    assert near[np.arange(500), own].all()


def test_empty(spark):
    assert found(spark, [], pq.Settings()) == []
    assert found(spark, [(1, None)], pq.Settings()) == [(1, 0, 1, True)]
