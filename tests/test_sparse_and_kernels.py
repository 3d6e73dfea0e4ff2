"""L1 machines, kernel machines over all rows, training that goes on after a stop, and pyramids put together again."""

import numpy as np
import pytest

from arrayloom.operators import classifiers, encoders, filters, geometry, kernel_duals, pyramids
from arrayloom.sources import models


def objective(w, x, s, c, loss):
    return np.abs(w).sum() + c * classifiers.LOSSES[loss](s * (x @ w))[0].sum()


@pytest.mark.parametrize("loss", ["squared_hinge", "logistic"])
def test_sparse_over_thousands_of_features(spark, loss):
    rng = np.random.default_rng(7)
    n, rows = 2000, 400
    x = rng.normal(size=(rows, n)) * (rng.random((rows, n)) < 0.05)
    truth = np.zeros(n)
    truth[:12] = 4 * rng.normal(size=12)
    y = (x @ truth + 0.1 * rng.normal(size=rows) > 0).astype(int)
    df = spark.createDataFrame([(i, int(a), b.tolist()) for i, (a, b) in enumerate(zip(y, x))] + [(9000, None, [0.0] * n), (9001, 1, None)], "id long, label int, vec array<double>").repartition(4)
    model, violation = classifiers.train_sparse(df, n, 0.3, loss)
    assert violation.max() <= 1e-3
    w, s = model.weights[0], np.where(y == model.labels[0], 1.0, -1.0)
    g = 0.3 * x.T @ (s * classifiers.LOSSES[loss](s * (x @ w))[1])  # the condition anew, over all features
    assert np.where(w != 0, np.abs(g + np.sign(w)), np.maximum(np.abs(g) - 1, 0)).max() <= 2e-3
    assert 0 < (w != 0).sum() < 300
    best = objective(w, x, s, 0.3, loss)
    assert all(objective(w + rng.normal(size=n) * e * (rng.random(n) < 0.01), x, s, 0.3, loss) >= best * (1 - 1e-6) for e in (1e-3, 0.1) for _ in range(30))


def test_sparse_several_labels(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5))
    y = x[:, :3].argmax(1)
    df = spark.createDataFrame([(i, int(a), b.tolist()) for i, (a, b) in enumerate(zip(y, x))], "id long, label int, vec array<double>")
    model, violation = classifiers.train_sparse(df, 5, 0.5)
    assert len(model.labels) == 3 and violation.max() <= 1e-3
    assert (np.abs(model.weights[:, 3:]) < np.abs(model.weights[:, :3]).max()).all()
    assert classifiers.train_sparse(df.filter("false"), 5)[0].labels == ()


@pytest.mark.parametrize("shape", [(8, 8), (16, 32)])
def test_pyramids_put_together(shape):
    rng = np.random.default_rng(0)
    plane, stack = rng.normal(size=shape), rng.normal(size=(3, *shape))
    assert np.allclose(geometry.laplacian_inverse(geometry.laplacian_pyramid(plane, 2)), plane)
    for bands in (2, 3, 4, 5):
        assert np.allclose(geometry.steerable_inverse(geometry.steerable_pyramid(plane, 2, bands)), plane)
        p = pyramids.Pyramid(*shape, 2, bands)
        assert np.allclose(p.inverse(*p.responses(stack)), stack)
    with pytest.raises(ValueError):
        geometry.steerable_inverse(geometry.steerable_pyramid(plane[:6, :6], 2))


def rings(rows, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rows, 3))
    return x, (np.hypot(x[:, 0], x[:, 1]) + 0.2 * rng.normal(size=rows) > 1.2).astype(int) + (x[:, 2] > 1)


@pytest.mark.parametrize("working,block", [(1024, 1024), (60, 100)])
def test_kernel_machines_over_all_rows(spark, monkeypatch, working, block):
    """The same machines as one that holds the whole matrix, with a working set of a tenth of the rows too."""
    monkeypatch.setattr(kernel_duals, "WORKING", working)
    monkeypatch.setattr(kernel_duals, "BLOCK", block)
    x, y = rings(500, 4)
    df = spark.createDataFrame([(i, int(a), b.tolist()) for i, (a, b) in enumerate(zip(y, x))] + [(900, None, [0.0] * 3), (901, 1, None)], "id long, label int, vec array<double>").repartition(3)
    model = kernel_duals.train_kernel_all(df, 2.0, "rbf", 0.5)
    assert model.violations.max() <= 1e-3
    k = classifiers.gram(x, x, "rbf", 0.5)
    scored = kernel_duals.kernel_values(df, model).filter("label is not null").orderBy("id").collect()
    assert scored[-1].scores is None
    got = np.array([r.scores for r in scored if r.id < 500])
    for t, label in enumerate(model.labels):
        s = np.where(y == label, 1.0, -1.0)
        alphas, bias = classifiers.smo(k, s, 2.0)
        assert np.abs(got[:, t] - (k @ alphas + bias)).max() < 0.02
    predicted = [r.predicted for r in kernel_duals.kernel_labels(df, model).filter("id < 500").orderBy("id").collect()]
    assert predicted == [model.labels[i] for i in got.argmax(1)]


def test_kernel_machines_of_odd_tables(spark):
    df = spark.createDataFrame([(1, 3, [0.0, 1.0]), (2, 3, [0.0, 1.0]), (3, 3, [2.0, 1.0])], "id long, label int, vec array<double>")
    one = kernel_duals.train_kernel_all(df)
    assert [r.predicted for r in kernel_duals.kernel_labels(df, one).collect()] == [3.0] * 3
    none = kernel_duals.train_kernel_all(df.filter("false"))
    assert none.labels == () and none.support.count() == 0
    twins = df.withColumn("label", (df.id > 1).cast("int"))  # equal vectors of both labels
    assert kernel_duals.train_kernel_all(twins, kind="linear", gamma=1.0).violations.max() <= 1e-3


@pytest.mark.parametrize("train", [lambda df, rounds, kept: encoders.kmeans(df, 5, 3, 1e-9, rounds, "vec", kept), lambda df, rounds, kept: encoders.gmm(df, 3, 3, 1e-12, rounds, 1e-6, "vec", kept)], ids=["kmeans", "gmm"])
def test_training_goes_on(spark, tmp_path, train):
    """Stopped after three rounds, and in the middle of writing one, training ends in the model of a run without a stop."""
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(v.tolist(),) for v in np.concatenate([rng.normal(size=(150, 3)), 3 + rng.normal(size=(150, 3))])], "vec array<double>").repartition(3)
    whole = train(df, 8, None)
    rounds = models.Rounds(spark, str(tmp_path / "r"), "first")
    assert rounds.last() is None
    train(df, 3, rounds)
    assert rounds.last()[0] == 2
    (tmp_path / "r" / "round=3" / "_temporary").mkdir(parents=True)  # a job that died before its commit
    rows = spark.read.parquet(str(tmp_path / "r")).filter("round = 2").drop("round")
    rows.limit(rows.count() - 1).coalesce(1).write.parquet(str(tmp_path / "r" / "round=4"))  # and a round that isn't whole
    assert rounds.last()[0] == 2
    for got, want in zip(train(df, 8, rounds), whole, strict=True):
        assert np.allclose(got, want, rtol=1e-9, atol=1e-9)
    assert rounds.last()[0] > 2
    for got, want in zip(train(df, 8, rounds), whole, strict=True):  # once more, from its last round
        assert np.allclose(got, want, rtol=1e-9, atol=1e-9)
    with pytest.raises(ValueError):
        models.Rounds(spark, str(tmp_path / "r"), "second").last()


def test_values_at_centres():
    """Against a loop over pixels; a map of zeros, and a centre half way between two pixels."""
    rng = np.random.default_rng(5)
    maps = rng.normal(size=(6, 5, 7)) + 1j * rng.normal(size=(6, 5, 7))
    maps[2], maps[3] = 0, 0
    maps[3, 1, 0], maps[3, 2, 0] = 1j, 1j
    want = []
    for m in maps:
        total = sum(abs(v) for row in m for v in row)
        centre = [round(sum((i, j)[axis] * abs(m[i - 1, j - 1]) for i in range(1, 6) for j in range(1, 8)) / total) if total else 1 for axis in (0, 1)]
        want.append(m[centre[0] - 1, centre[1] - 1])
    assert np.allclose(filters.at_centres(maps), want) and filters.at_centres(maps)[2] == 0
    assert filters.at_centres(maps)[3] == 1j  # rows 2 and 3 weigh alike: 2.5 goes to 2
