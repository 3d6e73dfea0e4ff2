"""Operators that run in numpy, against analytic cases and brute force."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from arrayloom.functions import vectors as V
from arrayloom.operators import cells, classifiers, encoders, filters, fourier, geometry, joins, kernels, mixtures, pyramids, stats, stencils
from arrayloom.sources import readers

RNG = np.random.default_rng(0)


def frame(spark, images):
    return spark.createDataFrame([(i, i % 3, *a.shape, a.ravel().tolist()) for i, a in enumerate(images)], "id long, label int, channels int, rows int, cols int, data array<double>")


def test_bicubic_keeps_points_and_is_zero_outside():
    a = RNG.random((6, 7)) * 255
    y, x = np.meshgrid(np.arange(6.0), np.arange(7.0), indexing="ij")
    assert np.allclose(geometry.bicubic(a, y, x, 0, 255), a)
    assert geometry.bicubic(a, np.array([0.0]), np.array([-0.1]), 0, 255) == 0
    ramp = np.add.outer(np.arange(6.0), 2 * np.arange(7.0))
    assert geometry.bicubic(ramp, np.array([2.5]), np.array([3.25]), -99, 99) == pytest.approx(2.5 + 6.5)


def test_rotation():
    a = RNG.random((1, 8, 8))
    assert np.allclose(geometry.rotated(a, 0), a) and np.allclose(geometry.rotated(a, 360), a)
    quarter = geometry.rotated(a, 90)[0]
    assert np.allclose(quarter, np.rot90(a[0])) or np.allclose(quarter, np.rot90(a[0], -1))
    assert geometry.rotated_whole(a, 45).shape == (1, 12, 12)
    assert len(list(geometry.pad_resize_rotate(a, 8, 90))) == 4 and geometry.angles_of(0) == [0.0]


def test_shapes():
    a = RNG.random((3, 4, 6))
    assert geometry.crop_square(a).shape == (3, 4, 4) and geometry.pad_square(a).shape == (3, 6, 6)
    assert geometry.resize_longest(a, 12).shape == (3, 8, 12) and geometry.crop_resize(a, 5).shape == (3, 5, 5) and geometry.pad_resize(a, 5).shape == (3, 5, 5)
    assert np.allclose(geometry.rescale(a, 4, 6, 0, 1), a)
    assert [cells.pad_offset(3, n) for n in (3, 4, 5, 6, 2)] == [0, 1, 1, 1, 0]
    assert cells.center_grid(128, 3) == [60, 64, 68] and cells.center_grid(4, 4) == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        cells.center_grid(10, 4)
    with pytest.raises(ValueError):
        geometry.box(a, 4, 0, 3, 2)
    assert geometry.square_box(a, 1, 1, 2, 3, 4).shape == (3, 4, 4)


def test_log_polar_round_trip():
    y, x = np.mgrid[0:33, 0:33]
    a = np.exp(-((y - 16) ** 2 + (x - 20) ** 2) / 60.0)[None]
    back = geometry.from_log_polar(geometry.polar(a, 128, 64, (16, 16), 15, log=True), 33, 33, (16, 16), 15)
    r = np.hypot(y - 16, x - 16)
    live = (r > 3) & (r < 12)
    assert np.abs(back[0] - a[0])[live].max() < 0.03


def test_augmentation_depends_on_seed_and_id_only(spark):
    df = frame(spark, [RNG.random((1, 8, 8)) for _ in range(6)])
    how = geometry.Augmentation(8, 8, 90, (0.8, 1.2), (0.5, 2.0), (0, 9))
    a = {(r.id, tuple(r.data)) for r in geometry.augmented(df, how, 3).collect()}
    b = {(r.id, tuple(r.data)) for r in geometry.augmented(df.repartition(5), how, 3).collect()}
    assert a == b and geometry.augmented(df, how, 3).count() == 24


def test_wavelets_and_laplacian():
    a = RNG.random((16, 16))
    for name in geometry.WAVELETS:
        bands = geometry.wavelet_transform(a, 2, name)
        assert np.allclose(geometry.wavelet_inverse(bands, name), a)
        assert sum((p * p).sum() for b in bands for p in b) == pytest.approx((a * a).sum())
    levels = geometry.laplacian_pyramid(a, 3)
    assert [p.shape[0] for p in levels] == [16, 8, 4, 2] and len(geometry.laplacian_pyramid(RNG.random((5, 5)), 2)) == 1


def test_fft(spark):
    a = RNG.random((3, 4, 6))
    df = spark.createDataFrame([(i, a[i].ravel().tolist(), [0.0] * 24) for i in range(3)], "id long, re array<double>, im array<double>")
    f = {r.id: np.array(r.re) + 1j * np.array(r.im) for r in fourier.transformed(df, (4, 6), (0, 1)).collect()}
    assert all(np.allclose(f[i].reshape(4, 6), np.fft.fft2(a[i])) for i in f)
    assert all(np.isclose((np.abs(f[i]) ** 2).sum() / 24, (a[i] ** 2).sum()) for i in f)
    back = fourier.transformed(fourier.transformed(df, (4, 6), (1,)), (4, 6), (1,), "ifft_plain").collect()
    assert all(np.allclose(np.array(r.re) / 6, a[r.id].ravel()) for r in back)
    assert len(fourier.transformed(df, (4, 6), (1,), "rfft").first().re) == 16


def test_pyramid_windows_and_shift():
    x = np.linspace(0, math.pi, 50)
    assert np.allclose(pyramids.h1(x) ** 2 + (pyramids.l1(x) / 2) ** 2, 1)
    theta = np.linspace(-math.pi, math.pi, 40, endpoint=False)
    assert np.allclose(sum(pyramids.g1(k, 4, theta) ** 2 + pyramids.g1(k, 4, theta + math.pi) ** 2 for k in range(4)), 1)
    p = pyramids.Pyramid(16, 16, 2, 4)
    stack = RNG.random((1, 16, 16))
    plain, moved = p.features(stack), p.features(np.roll(stack, 4, axis=1))
    assert all(np.isclose(np.linalg.norm(a), np.linalg.norm(b)) for a, b in zip(plain, moved))
    assert plain[0].shape == (256, 5) and plain[1].shape == (64, 4)
    assert [len(v) for v in p.scattering(stack, 1)] == [16, 5 * 16 + 4 * 4] and len(p.ring_features(stack)) == 2
    with pytest.raises(ValueError):
        pyramids.Pyramid(8, 4, 3, 2)


def test_kmeans_and_vlad(spark):
    points = np.concatenate([RNG.normal(m, 0.1, (40, 2)) for m in ((0, 0), (5, 5), (0, 5))])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, vec array<double>")
    centers, sizes = encoders.kmeans(df, 3, seed=4)
    assert sorted(sizes) == [40, 40, 40]
    assert {tuple(np.round(c)) for c in centers} == {(0, 0), (5, 5), (0, 5)}
    at = spark.createDataFrame([(0, [0.0, 0.0]), (0, [5.0, 5.0]), (1, [4.0, 0.0])], "id long, vec array<double>")
    got = {r.id: r.vec for r in encoders.vlad(at, np.array([[0.0, 0.0], [5.0, 5.0]]), ["id"]).collect()}
    assert got[0] == [0.0] * 4 and got[1] == [1.0, 0, 0, 0]
    tie = spark.createDataFrame([(0, [1.0])], "id long, vec array<double>")
    assert encoders.assigned(tie, np.array([[0.0], [2.0]])).first().k == 0
    with pytest.raises(ValueError):
        encoders.kmeans(tie, 2)


def test_mixtures(spark):
    points = np.concatenate([RNG.normal(-3, 0.5, (150, 2)), RNG.normal(3, 1, (150, 2))])
    df = spark.createDataFrame([(i // 50, p.tolist()) for i, p in enumerate(points)], "id long, vec array<double>")
    w, mu, var = encoders.gmm(df, 2, seed=1)
    order = np.argsort(mu[:, 0])
    assert np.allclose(w, 0.5, atol=0.05) and np.allclose(mu[order, 0], [-3, 3], atol=0.3) and np.allclose(var[order, 0], [0.25, 1], atol=0.3)
    f = encoders.fisher_vectors(df, w, mu, var, ["id"]).collect()
    assert len(f) == 6 and all(np.isclose(np.linalg.norm(r.vec), 1) for r in f)
    each = {(r.feature, r.k): r for r in mixtures.feature_mixtures(df, 2, seed=3).collect()}
    assert sorted(round(each[0, j].mu) for j in (0, 1)) == [-3, 3]
    model = mixtures.train_mppca(df, 2, 2, 1, seed=2)
    assert sorted(round(float(m.mu[0])) for m in model) == [-3, 3]
    assert all(np.isclose(np.linalg.norm(r.vec), 1) for r in mixtures.mppca_fisher(df, model).collect())
    axes = mixtures.axes_encoding(df, ["id"], 1).collect()
    assert len(axes) == 6 and all(np.isclose(np.linalg.norm(r.vec), 1) for r in axes)


def test_pca(spark):
    x = RNG.normal(size=(80, 4)) @ np.diag([3, 2, 1, 0.1])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>")
    mean, rows, values = stats.pca(df, "vec", 4, 2)
    cov = np.cov(x.T, bias=True)
    assert np.allclose(cov @ rows.T, rows.T * values) and np.allclose(mean, x.mean(0))
    assert np.allclose(stats.singular_values(values, 80), np.linalg.svd(x - x.mean(0))[1][:2])
    p = df.select(stats.project(F.col("vec"), mean.tolist(), rows.tolist()).alias("p")).collect()
    assert np.allclose([r.p for r in p], (x - x.mean(0)) @ rows.T)


def test_classifiers(spark):
    x = np.concatenate([RNG.normal(m, 0.4, (40, 2)) for m in ((2, 0), (-2, 1), (0, -3))])
    df = spark.createDataFrame([(i, float(i // 40 + 1), v.tolist()) for i, v in enumerate(x)], "id long, label double, vec array<double>")
    for model in (classifiers.train_linear(df, 2), classifiers.train_linear(df, 2, loss="logistic"), classifiers.train_linear(df, 2, l1=True, rounds=60), classifiers.train_crammer_singer(df, 2, rounds=40)):
        assert model.labels == (1.0, 2.0, 3.0)
        assert stats.accuracy(classifiers.predicted(df, model), "label", "predicted").first()[0] > 90
    k = classifiers.train_kernel(df, kind="rbf")
    assert stats.accuracy(classifiers.kernel_predicted(df, k), "label", "predicted").first()[0] > 95
    two = df.filter("label < 3")
    m = classifiers.train_linear(two, 2)
    assert np.allclose(m.weights[0], -m.weights[1])
    fold = {r.id: r.fold for r in classifiers.folds(df.limit(10), 3).collect()}
    assert [fold[i] for i in sorted(fold)] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3]
    c, best = classifiers.best_c(two.filter("id % 4 = 0"), 2, 1.0, 2.0, 2)
    assert c in (1.0, 2.0) and best >= 0
    y = spark.createDataFrame([(v.tolist(), float(v @ [1.5, -2])) for v in x], "vec array<double>, label double")
    assert np.allclose(classifiers.train_svr(y, 2, c=100, eps=0.001), [1.5, -2], atol=0.01)


def test_filters(spark):
    a = RNG.random((2, 9, 9))
    bank = filters.Bank("gaussian", 3.0, (0.0, 1.0), (0, 2))
    f = bank.spatial(9, 9)[0]
    assert np.allclose(filters.expanded(a, f), [[(c * k).sum() for k in f] for c in a])
    delta = np.zeros((1, 9, 9))
    delta[0, 0, 0] = 1
    assert np.allclose(filters.convolved(delta, np.fft.fft2(f))[0], f)
    m = filters.morlet(2.0, 0.2, 0.3, *filters.offsets(15, 15))
    assert abs(m.sum()) < 1e-9 and np.isclose((np.abs(m) ** 2).sum(), 1)
    for family in ("fourier_mellin", "inverse_gaussian", "ring", "fan", "blob"):
        b = filters.Bank(family, 2.0, (0.0, 1.0), (1, 2), inner=1.0, shifts=(1.0, 2.0))
        assert len(b.spatial(8, 8)) == 2 and np.isfinite(b.spatial(8, 8)[0]).all()
    df = frame(spark, [RNG.random((1, 9, 9)) for _ in range(4)])
    comp = filters.Composite(bank, ((0.5, 0.0),), ((0.5, 0.5),))
    assert all(np.isclose(np.linalg.norm(r.vec), 1) for r in filters.composite_features(df, comp).collect())
    assert np.isfinite(filters.Composite(bank, grid=True).features(a)).all()
    assert np.isclose(np.linalg.norm(comp.complex_features(a)), 1)
    assert filters.scattering_descriptors(df, bank, bank, 2, 3).count() == 4 * 9
    assert filters.magnitude_points(df, bank, 2).count() == 4 * 25 and filters.pixel_features(df, 4).count() == 16
    target = np.abs(np.fft.ifft2(np.fft.fft2(a[0])[None] * np.fft.fft2(f)))
    _, errors = filters.from_magnitudes(target, np.fft.fft2(f), RNG.random((9, 9)), rounds=60)
    assert errors[-1] < errors[0] / 2
    field = filters.segmented(target, np.fft.fft2(f), np.fft.fft2(np.eye(9)[:1].T @ np.eye(9)[:1]), RNG.random((9, 9)) - 0.5, rounds=5)
    assert set(np.unique(field)) <= {-1.0, 0.0, 1.0}
    assert filters.phase_differences([0, 1, 2], np.exp(1j * np.array([0.3, 0.5, 1.0])))[0] == pytest.approx(0)
    assert filters.map_centres(np.eye(5)[None]).tolist() == [1.0]
    pairs = spark.createDataFrame([(0, 0, 1, 1.0, 0.0), (0, 0, 2, 0.0, 2.0)], "id int, pos int, af int, re double, im double")
    r = filters.pair_features(pairs).first()
    assert r.mrm == pytest.approx(0.5) and r.jrp_sin == pytest.approx(-1)


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("c")).first().c
    arr = lambda *v: F.array(*map(F.lit, v))
    assert get(V.angle(F.lit(0.0), F.lit(-1.0))) == pytest.approx(3 * math.pi / 2)
    assert get(V.luminance(F.lit(255.0), F.lit(255.0), F.lit(255.0), 255.0)) == pytest.approx(255)
    assert get(V.l2_unit(arr(0.0, 0.0))) == [0.0, 0.0] and get(V.l2_unit(arr(3.0, 4.0))) == [0.6, 0.8]
    assert get(V.min_max(arr(2.0, 2.0), 0, 1, F.lit(2.0), F.lit(2.0))) == [2.0, 2.0]
    assert get(V.opponency(F.lit(0.0), F.lit(0.0), F.lit(0.0))[0]) == 0
    assert [get(stats.bin_of(F.lit(x), 1.0, 3)) for x in (0.0, 0.5, 9.9)] == [0, 0, 2]
    assert [get(stats.bin_of(F.lit(x), 1.0, 3, True)) for x in (-9.0, 0.5, 9.9)] == [0, 3, 6]
    assert get(stats.packed_bins(F.array(F.lit(1).cast("long"), F.lit(2).cast("long")), 3, 2)) == [7]
    assert get(kernels.low_pass(F.lit(1.0), True)) != get(kernels.low_pass(F.lit(1.0)))
    ext = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate((1, 3, 2, 2, 5, 1))], "k int, i int, v double")
    assert [r.v for r in stencils.extrema(ext, ["k"], "i", "v").filter("kind = 1").orderBy("i").collect()] == [3, 5]
    votes = spark.createDataFrame([(0, 1), (0, 1), (0, 2), (0, 3), (1, 2), (1, 2), (1, 3)], "k int, v int")
    assert {r.k: r.winner for r in stats.majority(votes, ["k"], "v").collect()} == {0: None, 1: 2}
    conf = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (3, 1)], "t int, p int")
    got = {(r.truth, r.predicted): r.share for r in stats.confusion(conf, "t", "p").collect()}
    assert got[1, 1] == pytest.approx(2 / 3) and got[2, 2] is None and len(got) == 9
    assert get(kernels.gaussian_2d(1.0, F.lit(0), F.lit(0))) == pytest.approx(1 / (2 * math.pi))


def test_joins(spark):
    p = RNG.random((200, 2)) * 10
    a = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], "a_id long, a_x double, a_y double")
    b = a.toDF("b_id", "b_x", "b_y")
    got = {(r.a_id, r.b_id) for r in joins.radius_join(a, b, ["x", "y"], 0.7).collect()}
    d2 = ((p[:, None] - p[None]) ** 2).sum(-1)
    assert got == {(i, j) for i in range(200) for j in range(200) if d2[i, j] <= 0.49}
    q = spark.createDataFrame([(i, p[i].tolist()) for i in range(5)], "q long, qv array<double>")
    pts = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(p)], "p long, pv array<double>")
    near = {(r.q, r["rank"]): r.p for r in joins.nearest(q, pts, 3).collect()}
    for i in range(5):
        assert [near[i, k] for k in (1, 2, 3)] == np.argsort(d2[i], kind="stable")[:3].tolist()


def test_readers(spark, tmp_path):
    images = [np.round(RNG.random((1, 3, 4)) * 255) for _ in range(5)]
    for a in images:
        a.flat[0], a.flat[1] = 0, 255
    (tmp_path / "a.bin").write_bytes(readers.encode_labelled([(i, a) for i, a in enumerate(images)]))
    got = readers.read_labelled_arrays(spark, str(tmp_path / "a.bin")).orderBy("pos").collect()
    assert [(r.label, r.channels, r.rows, r.cols) for r in got] == [(i, 1, 3, 4) for i in range(5)]
    assert all(np.array_equal(np.array(r.data).reshape(1, 3, 4), images[r.pos]) for r in got)
    assert readers.record_counts(spark, str(tmp_path / "a.bin")).first().records == 5
    assert readers.read_labelled_arrays(spark, str(tmp_path / "a.bin"), first=2).count() == 2
    (tmp_path / "bad.bin").write_bytes(struct.pack(">I", 9) + (tmp_path / "a.bin").read_bytes()[4:])
    with pytest.raises(Exception, match="9 records"):
        readers.read_labelled_arrays(spark, str(tmp_path / "bad.bin")).collect()
    assert readers.labelled_files(frame(spark, images), 2).count() >= 3
    (tmp_path / "s.bin").write_bytes(readers.encode_sparse([(1.0, {0: 0.5, 3: 2.0}), (2.0, {})]))
    r = readers.read_sparse(spark, str(tmp_path / "s.bin")).orderBy("pos")
    assert [(x.label, x.i, x.v) for x in r.collect()] == [(1.0, [0, 3], [0.5, 2.0]), (2.0, [], [])]
    assert r.select(readers.sparse_to_dense(F.col("i"), F.col("v"), 4).alias("d")).first().d == [0.5, 0, 0, 2.0]
    (tmp_path / "i.ppm").write_bytes(readers.encode_netpbm(RNG.random((3, 2, 5)) * 255))
    assert readers.read_images(spark, str(tmp_path / "i.ppm")).first().cols == 5
    (tmp_path / "d.txt").write_text(" ".join(map(str, range(4))) + " 7\n")
    assert readers.read_digits(spark, str(tmp_path / "d.txt"), 2).first().data == [0, 2, 1, 3]
    (tmp_path / "c.bin").write_bytes(struct.pack("<IHHH", 14, 9, 2, 2) + bytes([0, 255, 1, 2]))
    assert bytes(readers.read_characters(spark, str(tmp_path / "c.bin")).first().data) == bytes([255, 0, 254, 253])
    (tmp_path / "x.bin").write_bytes(bytes(27648) + bytes([5] * 27648))
    (tmp_path / "y.bin").write_bytes(bytes([1, 2]))
    assert {r.label: r.data[0] for r in readers.read_stl(spark, str(tmp_path / "x.bin"), str(tmp_path / "y.bin")).collect()} == {1: 0, 2: 5}
    (tmp_path / "l.txt").write_text('("a/b.png",3,((1,2),(30,40)))\n')
    assert tuple(readers.read_landmarks(spark, str(tmp_path / "l.txt")).first()) == ("a/b.png", 3, 1, 2, 30, 40)
    (tmp_path / "n.txt").write_text("1.0\n2.0\n")
    assert [x.label for x in readers.read_labels(spark, str(tmp_path / "n.txt")).collect()] == [1.0, 2.0]
    layered = spark.createDataFrame([(i, i % 2, [1.0, 3.0]) for i in range(4)], "id int, layer int, data array<double>")
    readers.write_layers(layered, str(tmp_path / "layers"), seed=1)
    assert spark.read.parquet(str(tmp_path / "layers")).filter("layer = 1").first().data == [0.0, 255.0]
    split = readers.first_per_class(spark.createDataFrame([(f"p{i}", i % 2) for i in range(20)], "path string, label int"), 3, 1)
    assert split.filter("train").count() == 6


def test_small_things(spark, tmp_path):
    a = RNG.random((16, 16))
    bands = geometry.steerable_pyramid(a, 2)
    assert [len(b) for b in bands] == [1, 3, 3, 1] and bands[-1][0].shape == (4, 4)
    flat = geometry.steerable_pyramid(np.ones((16, 16)), 1)
    assert all(abs(p).max() < 1e-9 for b in flat[:-1] for p in b)
    d = geometry.drawn(np.zeros((1, 9, 9)), [("circle", 4, 4, 3), ("point", 0, 0)], (1, 2, 3))
    assert d[:, 0, 0].tolist() == [1, 2, 3] and d[2, 4, 7] == 3 and d[0, 4, 4] == 0
    pts = spark.createDataFrame([(i, float(i % 5), float(i // 5)) for i in range(25)], "id long, x double, y double")
    grid = pts.select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("cloud"), F.col("id").alias("g"), "x", "y")
    assert joins.cloud_similarity(pts, pts, grid, ["x", "y"], 1.0).first().s == pytest.approx(2000)
    moved = pts.withColumn("x", F.col("x") + 3)
    assert joins.cloud_similarity(pts, moved, grid, ["x", "y"], 1.0).first().s < 100
    z = spark.createDataFrame([(0, 1.0, 1.0, 1.0, 0.0), (0, 2.0, 0.0, 2.0, 0.0)], "id int, are double, aim double, bre double, bim double")
    assert joins.complex_distance(z, ["id"]).first().d == -1
    (tmp_path / "c.bin").write_bytes(struct.pack("<IHHH", 13, 4, 2, 2) + struct.pack("<HB", 3, 200))
    assert readers.read_sparse_characters(spark, str(tmp_path / "c.bin")).first().v == [200.0]


def test_spans_of_record_files(spark, tmp_path):
    """One file is read by many tasks, in spans of whole records; a prefix needs no byte behind it; odd files are errors."""
    images = [(i % 3, np.arange(12.0).reshape(1, 3, 4) * (i + 1)) for i in range(50)]
    content = readers.encode_labelled(images)
    path = tmp_path / "some file.bin"
    path.write_bytes(content)
    got = readers.read_labelled_arrays(spark, str(path), span=100).withColumn("task", F.spark_partition_id()).orderBy("pos").collect()
    assert [(r.pos, r.label, r.channels, r.rows, r.cols) for r in got] == [(i, i % 3, 1, 3, 4) for i in range(50)]
    assert all(r.data == [round(k / 11 * 255) for k in range(12)] for r in got)
    assert len({r.task for r in got}) > 1
    for span in (1, 68, 10**9):
        assert readers.read_labelled_arrays(spark, str(path), span=span).count() == 50
    # The records behind the third are cut off.
    (tmp_path / "cut.bin").write_bytes(content[: 4 + 3 * (len(content) - 4) // 50 + 7])
    assert [r.pos for r in readers.read_labelled_arrays(spark, str(tmp_path / "cut.bin"), first=3).orderBy("pos").collect()] == [0, 1, 2]
    assert readers.record_counts(spark, str(tmp_path / "cut.bin")).first().records == 50
    for bad in (content[:200], content[:2]):
        (tmp_path / "bad.bin").write_bytes(bad)
        with pytest.raises(Exception, match="cut off|no header"):
            readers.read_labelled_arrays(spark, str(tmp_path / "bad.bin")).collect()
    (tmp_path / "none.bin").write_bytes(readers.encode_labelled([]))
    assert readers.read_labelled_arrays(spark, str(tmp_path / "none.bin")).count() == 0


def test_long_record_file(spark, tmp_path):
    """A sparse file above 2 GiB: the head counts, the first records and the last are read."""
    record = readers.encode_labelled([(7, np.arange(4.0).reshape(1, 2, 2))])[4:]
    size = (1 << 31) - 1
    with open(tmp_path / "long.bin", "wb") as f:
        f.write((4).to_bytes(4, "big") + record + size.to_bytes(4, "big"))
        f.seek(size, 1)
        f.write(record + record)
    spans = readers.labelled_spans(spark, str(tmp_path / "long.bin"), span=1).orderBy("start").collect()
    n = len(record)
    assert [(r.pos, r.start, r.stop) for r in spans] == [(0, 4, 4 + n), (1, 4 + n, 8 + n + size), (2, 8 + n + size, 8 + 2 * n + size), (3, 8 + 2 * n + size, 8 + 3 * n + size)]
    last = readers.read_spans(spark.createDataFrame(spans[2:]), readers.labelled_records, readers.IMAGE).collect()
    assert sorted((r.pos, r.label, r.data) for r in last) == [(2, 7, [0, 85, 170, 255]), (3, 7, [0, 85, 170, 255])]
    assert readers.record_counts(spark, str(tmp_path / "long.bin")).first().records == 4


def test_fixed_records(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"aabbccddee")
    (tmp_path / "b").write_bytes(b"")
    (tmp_path / "c").write_bytes(b"ffgghhi")
    got = readers.fixed_records(spark, str(tmp_path / "*"), 2, span=4).orderBy("number").collect()
    assert [(r.path[-1], r.pos, r.number, bytes(r.record)) for r in got] == [(p, k, n, v * 2) for n, (p, k, v) in enumerate([*((("a", i, x)) for i, x in enumerate([b"a", b"b", b"c", b"d", b"e"])), *((("c", i, x)) for i, x in enumerate([b"f", b"g", b"h"]))])]
