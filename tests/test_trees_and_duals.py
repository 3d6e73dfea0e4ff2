"""The partitioned k-d tree and the dual solvers against brute force and their optimality conditions."""

import numpy as np
import pytest

from arrayloom.operators import cells, classifiers, duals, neighbors, stats


def brute(queries, points, k):
    out = {}
    for q, v in queries:
        d = sorted((float(((np.array(p) - np.array(v)) ** 2).sum()), i) for i, p in points)[:k]
        out[q] = [(i, round(x, 9)) for x, i in d]
    return out


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        out.setdefault(r["q"], []).append((r["p"], round(r["d2"], 9)))
    return out


@pytest.mark.parametrize("dims,k", [(2, 4), (3, 1), (8, 7)])
def test_tree_search(spark, dims, k):
    rng = np.random.default_rng(dims)
    x = np.round(rng.normal(size=(1500, dims)), 1)  # many ties
    x[::7] = x[0]  # and a hot point
    points = [(i, v.tolist()) for i, v in enumerate(x)]
    queries = [(i, v) for i, v in points if i % 50 == 0] + [(9000, [50.0] * dims), (9001, [-50.0] * dims)]
    p, q = spark.createDataFrame(points, "p long, pv array<double>"), spark.createDataFrame(queries, "q long, qv array<double>")
    got = neighbors.nearest_by_tree(q, p, k, unit=60).collect()
    assert by_query(got) == brute(queries, points, k)


def test_tree_compares_few(spark):
    rng = np.random.default_rng(5)
    x = rng.random((6000, 2))
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "p long, pv array<double>")
    q = p.filter("p % 50 = 0").toDF("q", "qv")
    rows = neighbors.nearest_by_tree(q, p, 5, work=True, unit=500).collect()
    assert len(rows) == 600
    assert sum({r["q"]: r["compared"] for r in rows}.values()) < 0.05 * 120 * 6000


def test_tree_of_few_points(spark):
    p = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [1.0, 0.0])], "p long, pv array<double>")
    q = spark.createDataFrame([(7, [0.9, 0.0]), (8, None)], "q long, qv array<double>")
    assert by_query(neighbors.nearest_by_tree(q, p, 5).collect()) == {7: [(3, 0.01), (1, 0.81)]}
    assert neighbors.nearest_by_tree(q, p.filter("false"), 5).count() == 0


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 6))
    y = (x @ rng.normal(size=6) + rng.normal(size=300) * 0.5 > 0).astype(int) + (x[:, 0] > 1)
    return spark.createDataFrame([(i, int(a), b.tolist()) for i, (a, b) in enumerate(zip(y, x))] + [(400, None, [0.0] * 6), (401, 1, None)], "id long, label int, vec array<double>"), x, y


@pytest.mark.parametrize("squared", [False, True])
@pytest.mark.parametrize("block", [100, 4096])
def test_dual_hinge(points, squared, block, monkeypatch):
    df, x, y = points
    monkeypatch.setattr(duals, "BLOCK", block)
    model, gap = duals.train_dual(df, 6, 0.7, squared, tolerance=1e-3)
    assert gap.max() <= 1e-3
    clean = df.filter("id < 400")
    primal = classifiers.train_linear(clean, 6, 0.7, "squared_hinge" if squared else "hinge", tolerance=1e-5)
    assert model.labels == primal.labels
    for label, w, v in zip(model.labels, model.weights, primal.weights):
        s = np.where(y == label, 1.0, -1.0)
        value = lambda w: 0.5 * w @ w + 0.7 * (np.maximum(0, 1 - s * (x @ w)) ** (1 + squared)).sum()  # noqa: B023, E731
        assert value(w) <= value(v) * (1 + 1.2e-3)
        assert np.abs(w - v).max() < 0.05


@pytest.mark.parametrize("squared", [False, True])
def test_dual_regression(spark, squared, monkeypatch):
    monkeypatch.setattr(duals, "BLOCK", 100)
    rng = np.random.default_rng(3)
    x, truth = rng.normal(size=(300, 4)), np.array([1.0, -2.0, 0.5, 0.0])
    y = x @ truth + rng.normal(size=300) * 0.1
    df = spark.createDataFrame([(i, float(a), b.tolist()) for i, (a, b) in enumerate(zip(y, x))], "id long, label double, vec array<double>")
    w, gap = duals.train_dual_svr(df, 4, 1.0, 0.1, squared)
    assert gap <= 1e-3 and np.abs(w - truth).max() < 0.1
    primal = classifiers.train_svr(df, 4, 1.0, 0.1, squared=squared)
    value = lambda w: 0.5 * w @ w + (np.maximum(0, np.abs(x @ w - y) - 0.1) ** (1 + squared)).sum()
    assert value(w) <= value(primal) * (1 + 1.2e-3)


def test_level():
    rng = np.random.default_rng(1)
    for _ in range(200):
        k = rng.integers(2, 6)
        b, q, top = rng.normal(size=k), rng.random() + 0.1, np.zeros(k)
        top[rng.integers(k)] = rng.random()
        v = duals.level(b, top, q)
        assert abs(v.sum()) < 1e-9 and (v <= top + 1e-12).all()
        slope = q * v + b  # equal where free, no larger at the top
        free = v < top - 1e-9
        if free.any():
            assert np.ptp(slope[free]) < 1e-8 and (slope[~free] <= slope[free].mean() + 1e-8).all()


def test_joint(points, monkeypatch):
    df, x, y = points
    monkeypatch.setattr(duals, "BLOCK", 100)
    model, gap = duals.train_joint(df, 6, 0.5)
    assert gap <= 1e-3
    own = (y[:, None] == np.array(model.labels)).astype(float)
    value = lambda w: 0.5 * (w * w).sum() + 0.5 * ((x @ w.T + 1 - own).max(1) - (x @ w.T * own).sum(1)).sum()
    best = value(model.weights)
    rng = np.random.default_rng(2)
    assert all(value(model.weights + rng.normal(size=model.weights.shape) * s) > best * (1 - 1e-3) for s in (1e-3, 1e-2, 0.1) for _ in range(50))


def test_rows_after_repeats(spark):
    rows = [(1, "a"), (1, "a"), (1, "a"), (2, "b"), (None, "n"), (2, "b")]
    df = spark.createDataFrame(rows, "k int, t string").repartition(3)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r))
    for n in range(8):
        assert sorted(map(tuple, cells.after(df, n, "k").collect()), key=str) == sorted(ordered[n:], key=str)
    assert cells.after(df.filter("false"), 2, "k").count() == 0


def test_ranks(spark):
    rng = np.random.default_rng(4)
    rows = [("a", float(x)) for x in rng.normal(size=4000)] + [("b", 1.0)] * 3000 + [("b", 2.0)] * 10 + [("c", 5.0), ("c", None)] + [("d", float(x // 10)) for x in range(2500)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(4)
    want = {(k, r): sorted(x for g, x in rows if g == k and x is not None)[r - 1] for k, n in (("a", 4000), ("b", 3010), ("c", 1), ("d", 2500)) for r in (1, 7, 1999, 2400, 3005) if r <= n}
    got = {(r.k, r["rank"]): r["value"] for r in stats.at_ranks(df, "x", [1, 7, 1999, 2400, 3005], ("k",), held=50).collect()}
    assert got == want
    assert [r["value"] for r in stats.at_ranks(df, "x", [9511], held=10).collect()] == [max(x for _, x in rows if x is not None)]
    assert stats.at_ranks(df, "x", [0, 10**6]).count() == 0


def test_svd_of_near_dependent_columns(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 4))
    x[:, 3] = x[:, 0] + 1e-9 * x[:, 3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id long, v array<double>").repartition(7)
    mean, rows, values = stats.svd_components(df, "v", 4, 4)
    want = np.linalg.svd(x - x.mean(0), compute_uv=False)
    assert np.allclose(values, want, rtol=1e-6) and want[-1] < 1e-7
    assert np.allclose(np.abs(np.linalg.svd(stats.triangle(df, "v", 4, fan=2), compute_uv=False)), np.linalg.svd(x, compute_uv=False), rtol=1e-6)
