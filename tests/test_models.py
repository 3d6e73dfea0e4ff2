"""Solvers at their optimum, folds of larger tables, saved models, and what has no SQL."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arrayloom.functions import storage
from arrayloom.operators import classifiers, encoders, joins, mixtures, origins, stats
from arrayloom.sources import models


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(240, 6))
    y = (x @ rng.normal(size=6) + rng.normal(size=240) * 0.5 > 0).astype(int) + (x[:, 0] > 1)
    return spark.createDataFrame([(i, int(a), b.tolist()) for i, (a, b) in enumerate(zip(y, x))], "id long, label int, vec array<double>").repartition(3), x, y


def objective(w, x, s, c, loss):
    value, slope, _ = classifiers.LOSSES[loss](s * (x @ w))
    return 0.5 * w @ w + c * value.sum(), w + c * x.T @ (s * slope)


@pytest.mark.parametrize("loss", ["squared_hinge", "logistic", "hinge"])
def test_linear_optimum(points, loss, monkeypatch):
    df, x, y = points
    for dense in (128, 0):  # whole Hessians, and products of Hessians
        monkeypatch.setattr(classifiers, "DENSE", dense)
        m = classifiers.train_linear(df, 6, 0.7, loss, tolerance=1e-3)
        for label, w in zip(m.labels, m.weights):
            s = np.where(y == label, 1.0, -1.0)
            start = np.linalg.norm(objective(np.zeros(6), x, s, 0.7, loss)[1])
            assert np.linalg.norm(objective(w, x, s, 0.7, loss)[1]) <= 1.1e-3 * start


def test_exact_hinge(points):
    """The rounded corner moves the optimum of the plain hinge by next to nothing."""
    df, x, y = points
    m = classifiers.train_linear(df, 6, 0.5, "hinge", tolerance=1e-4)
    s = np.where(y == m.labels[0], 1.0, -1.0)
    plain = lambda w: 0.5 * w @ w + 0.5 * np.maximum(0, 1 - s * (x @ w)).sum()
    w, best = np.zeros(6), np.inf
    for t in range(1, 20_000):
        w = w - (w - 0.5 * x.T @ (s * (s * (x @ w) < 1))) / (t + 10)
        best = min(best, plain(w))
    assert plain(m.weights[0]) <= best * 1.005


def test_no_convergence_is_told(points):
    with pytest.warns(RuntimeWarning):
        classifiers.train_linear(points[0], 6, 10.0, rounds=1, tolerance=1e-9)


def test_regression(points, spark):
    _, x, _ = points
    t = x @ np.arange(6.0) + 0.05
    df = spark.createDataFrame([(i, float(a), b.tolist()) for i, (a, b) in enumerate(zip(t, x))], "id long, label double, vec array<double>")
    ridge = np.linalg.solve(np.eye(6) + 2 * x.T @ x, 2 * x.T @ t)
    assert np.allclose(classifiers.train_svr(df, 6, 1.0, 0.0), ridge, atol=1e-5)
    assert np.abs(classifiers.train_svr(df, 6, 10.0, 0.01, squared=False, tolerance=1e-3) - np.arange(6.0)).max() < 0.1


def test_folds_of_a_large_table(spark):
    df = spark.range(400_003).select((F.col("id") * 7919 % 400_003).alias("id")).repartition(7)
    for _ in range(2):
        got = {r.fold: (r.n, r.lo, r.hi) for r in classifiers.folds(df, 4).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).collect()}
        assert got == {**{k: (100_000, k * 100_000, k * 100_000 + 99_999) for k in range(4)}, 4: (3, 400_000, 400_002)}


def test_validation_by_fold(points):
    df, x, _ = points
    scores = classifiers.cross_validated(df, 3, classifiers.linear_after_pca(6, 3))
    assert len(scores) == 3 and all(s > 40 for s in scores)
    assert all(s > 50 for s in classifiers.cross_validated(df, 3, classifiers.kernel_machines(most_rows=200)))
    _, right = classifiers.train_and_test(df.filter("id < 160"), df.filter("id >= 160"), 6)
    assert right.first()[0] > 60


def test_precomputed_kernel(points, spark):
    df, x, y = points
    rows = df.orderBy("id").collect()
    gram = classifiers.gram(x, x, "rbf", 1 / 6)
    table = spark.createDataFrame([(r.id, r.label, g.tolist()) for r, g in zip(rows, gram)], "id long, label int, vec array<double>")
    own, given = classifiers.train_kernel(df), classifiers.train_kernel(table, kind="precomputed")
    a = {r.id: r.predicted for r in classifiers.kernel_predicted(df, own).collect()}
    assert {r.id: r.predicted for r in classifiers.kernel_predicted(table, given).collect()} == a


def test_training_rows_of_each_label(spark):
    df = spark.range(3000).select("id", F.floor(F.col("id") / 1000).alias("label"))
    some = classifiers.some_rows(df, 90, "label", "id")
    assert {r.label: r.n for r in some.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()} == {0: 30, 1: 30, 2: 30}


def test_kmeans_by_partitions(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(rng.normal(size=8).tolist(),) for _ in range(300)], "vec array<double>")
    first, *others = (encoders.kmeans(df.repartition(n), 5, seed=2)[0] for n in (1, 4, 8))
    assert all(np.allclose(first, o) for o in others)


def test_far_points_keep_shares(spark):
    df = spark.createDataFrame([([100.0] * 400,)], "vec array<double>")
    r = encoders.responsibilities(df, np.array([0.5, 0.5]), np.array([[0.0] * 400, [99.0] * 400]), np.ones((2, 400))).first()
    assert r.a == pytest.approx([0.0, 1.0]) and np.isfinite(r.ll)


def test_saved_models(spark):
    folder = storage.shared_folder(spark) + "/test-models"
    model = [mixtures.Ppca(0.5, np.arange(3.0), np.ones((3, 2)), 0.1), mixtures.Ppca(0.5, np.zeros(3), np.zeros((3, 2)), 0.2)]
    path = f"{folder}/{np.random.default_rng().integers(1 << 40)}"
    calls = []
    for _ in range(2):
        got = models.trained_once(spark, path, lambda: calls.append(1) or model)
    assert len(calls) == 1 and len(got) == 2 and np.array_equal(got[0].mu, model[0].mu) and got[1].noise == 0.2 and got[0].w.shape == (3, 2)


def test_tiles(spark, monkeypatch):
    """Several tiles a side give what one gives."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(50, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    q, p = df.filter("id % 7 = 0").select(F.col("id").alias("q"), F.col("v").alias("qv")), df.select(F.col("id").alias("p"), F.col("v").alias("pv"))
    want = sorted(map(tuple, joins.nearest(q, p, 3).select("q", "p", "rank").collect()))
    kernel = lambda a, b: F.aggregate(F.zip_with(a, b, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    monkeypatch.setattr(joins.tiles, "__defaults__", (8,))
    assert sorted(map(tuple, joins.nearest(q, p, 3).select("q", "p", "rank").collect())) == want
    got = {(r.a_id, r.b_id): r.k for r in joins.symmetric_kernel(df, kernel).collect()}
    assert len(got) == 2500 and all(abs(got[i, j] - x[i] @ x[j]) < 1e-9 for i in range(50) for j in range(50))
    d2 = ((x[::7, None] - x[None]) ** 2).sum(2)
    assert want == sorted((7 * i, int(j), k + 1) for i, row in enumerate(d2) for k, j in enumerate(np.argsort(row)[:3]))


def test_covariance_far_from_zero(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(500, 3)) + 1e6
    df = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>").repartition(5)
    assert np.allclose(stats.as_matrix(stats.covariance(df, "v", 3), 3), np.cov(x.T, bias=True), rtol=1e-6, atol=1e-8)


def test_stability_needs_equal_bands(spark):
    a = spark.createDataFrame([(1, 0, 1, 2, [3.0, 4.0]), (1, 1, 1, 1, [2.0])], "id long, band int, rows int, cols int, data array<double>")
    assert origins.stability(a, a).first().s == 0
    with pytest.raises(Exception, match="different bands"):
        origins.stability(a, a.filter("band = 0")).collect()
