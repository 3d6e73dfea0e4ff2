"""Queries: clustering, encodings, mixtures, classifiers, pyramids and resampling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import classifiers, duals, encoders, geometry, kernel_duals, pyramids, stats
from .registry import EM, images, query, r6, vectors


def _first(spark, d, k: int) -> np.ndarray:
    """The vectors of ids below k, as a fixed model."""
    return np.array([r.v for r in vectors(spark, d).filter(F.col("id") < k).orderBy("id").collect()])


_DIST = "list_sum(list_transform(range(1, 65), lambda i: pow(e.v[i] - c.v[i], 2)))"
_NEAR = EM + f", d AS (SELECT e.id, e.label, e.v, c.id::INT AS k, c.v AS cv, {_DIST} AS d2 FROM e, e c WHERE c.id < 4), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, k) AS r FROM d) WHERE r = 1)"


@query(_NEAR + " SELECT id, k, round(d2, 5) AS d2 FROM n")
def hard_assignment(spark, d):
    return encoders.assigned(vectors(spark, d), _first(spark, d, 4), "v").select("id", "k", F.round("d2", 5).alias("d2"))


@query(_NEAR + " SELECT k, count(*) AS size, round(sum(d2), 4) AS distortion FROM n GROUP BY k")
def distortion(spark, d):
    near = encoders.assigned(vectors(spark, d), _first(spark, d, 4), "v")
    return encoders.cluster_stats(near, "v")[0].select("k", "size", F.round("distortion", 4).alias("distortion"))


@query(_NEAR + ", x AS (SELECT k, generate_subscripts(v, 1) - 1 AS i, unnest(v) AS v FROM n) SELECT k, i::INT AS i, round(avg(v), 6) AS m FROM x GROUP BY 1, 2")
def cluster_means(spark, d):
    near = encoders.assigned(vectors(spark, d), _first(spark, d, 4), "v")
    return encoders.cluster_stats(near, "v")[1].select("k", "i", r6("m").alias("m"))


@query(_NEAR + ", s AS (SELECT id, k, greatest(0, avg(d2) OVER (PARTITION BY id) - d2) AS s FROM d) SELECT id, k, round(s / sqrt(sum(s * s) OVER (PARTITION BY id)), 5) AS s FROM s")
def soft_assignment(spark, d):
    s = vectors(spark, d).select("id", F.posexplode(encoders.soft_assignment(F.col("v"), _first(spark, d, 4))).alias("k", "s"))
    return s.select("id", "k", F.round("s", 5).alias("s"))


@query(_NEAR + ", x AS (SELECT label, k, generate_subscripts(v, 1) - 1 AS i, unnest(v) AS v, unnest(cv) AS c FROM n), s AS (SELECT label, k * 64 + i AS j, sum(v - c) AS s FROM x GROUP BY 1, 2), p AS (SELECT label, j, sign(s) * sqrt(abs(s)) AS s FROM s) SELECT label, j::INT AS j, round(s / sqrt(sum(s * s) OVER (PARTITION BY label)), 5) AS s FROM p")
def vlad(spark, d):
    """One bag for each label."""
    out = encoders.vlad(vectors(spark, d), _first(spark, d, 4), ["label"], "v").select("label", F.posexplode("vec").alias("j", "s"))
    near = encoders.assigned(vectors(spark, d), _first(spark, d, 4), "v").select("label", "k").distinct()
    return out.join(near.withColumnRenamed("k", "k_"), ["label"]).filter(F.floor(F.col("j") / 64) == F.col("k_")).select("label", "j", F.round("s", 5).alias("s"))


_GMM = EM + ", c AS (SELECT id AS k, (id + 1) / 6.0 AS w, v AS mu, 0.05 AS var FROM e WHERE id < 3), p AS (SELECT e.id, e.label, c.k::INT AS k, e.v, c.w, c.mu, c.w * exp(-0.5 * 64 * ln(2 * pi() * 0.05) - 0.5 * list_sum(list_transform(range(1, 65), lambda i: pow(e.v[i] - c.mu[i], 2) / 0.05))) AS p FROM e, c), a AS (SELECT *, p / sum(p) OVER (PARTITION BY id) AS a, sum(p) OVER (PARTITION BY id) AS s FROM p)"


def _mixture(spark, d):
    mu = _first(spark, d, 3)
    return np.array([1 / 6, 2 / 6, 3 / 6]), mu, np.full(mu.shape, 0.05)


@query(_GMM + " SELECT id, k, round(a, 5) AS a FROM a")
def responsibilities(spark, d):
    r = encoders.responsibilities(vectors(spark, d), *_mixture(spark, d), "v")
    return r.select("id", F.posexplode("a").alias("k", "a")).select("id", "k", F.round("a", 5).alias("a"))


@query(_GMM + " SELECT round(avg(ln(s)), 5) AS avg_ll FROM (SELECT DISTINCT id, s FROM a)")
def log_likelihood(spark, d):
    return encoders.average_log_likelihood(encoders.responsibilities(vectors(spark, d), *_mixture(spark, d), "v")).select(F.round("avg_ll", 5).alias("avg_ll"))


@query(_GMM + ", x AS (SELECT k, a, generate_subscripts(v, 1) - 1 AS i, unnest(v) AS x FROM a) SELECT k, i::INT AS i, round(sum(a) / (SELECT count(*) FROM e), 6) AS weight, round(sum(a * x) / sum(a), 5) AS mu, round(sum(a * x * x) / sum(a) - pow(sum(a * x) / sum(a), 2), 5) AS var FROM x GROUP BY 1, 2")
def em_step(spark, d):
    m = encoders.em_step(vectors(spark, d), *_mixture(spark, d), "v")
    return m.select("k", "i", r6("weight").alias("weight"), F.round("mu", 5).alias("mu"), F.round("var", 5).alias("var"))


@query(_GMM + ", x AS (SELECT label, k, w, a, generate_subscripts(v, 1) - 1 AS i, unnest(v) AS x, unnest(mu) AS m FROM a), n AS (SELECT label, count(*) AS n FROM e GROUP BY 1), g AS (SELECT x.label, k, i, sum(a * (x - m)) / 0.05 * sqrt(0.05 / (any_value(n) * any_value(w))) AS gm, sum(a * (pow(x - m, 2) / 0.05 - 1)) * sqrt(0.5 / (any_value(n) * any_value(w))) AS gv FROM x JOIN n ON x.label = n.label GROUP BY 1, 2, 3), f AS (SELECT label, k * 64 + i AS j, gm AS s FROM g UNION ALL SELECT label, 192 + k * 64 + i, gv FROM g), u AS (SELECT label, j, sign(s) * sqrt(abs(s)) AS s FROM f) SELECT label, j::INT AS j, round(s / sqrt(sum(s * s) OVER (PARTITION BY label)), 4) AS s FROM u")
def fisher_vector(spark, d):
    f = encoders.fisher_vectors(vectors(spark, d), *_mixture(spark, d), ["label"], "v")
    return f.select("label", F.posexplode("vec").alias("j", "s")).select("label", "j", F.round("s", 4).alias("s"))


_LIN = EM + ", w AS (SELECT label, min(id) AS o, any_value(v ORDER BY id) AS w FROM (SELECT label, id, first_value(v) OVER (PARTITION BY label ORDER BY id) AS v FROM e) GROUP BY label), s AS (SELECT e.id, e.label AS truth, w.label, w.o, list_sum(list_transform(range(1, 65), lambda i: e.v[i] * w.w[i])) AS s FROM e, w), p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, o) AS r, sum(1 / (1 + exp(-s))) OVER (PARTITION BY id) AS t FROM s) WHERE r = 1)"


def _linear(spark, d):
    """The first vector of each label as its weights."""
    rows = vectors(spark, d).groupBy("label").agg(F.min_by("v", "id").alias("w"), F.min("id").alias("o")).orderBy("o").collect()
    return classifiers.Linear(tuple(float(r.label) for r in rows), np.array([r.w for r in rows]))


@query(_LIN.replace("any_value(v ORDER BY id)", "any_value(v)") + " SELECT id, label::DOUBLE AS predicted, round(s, 5) AS score, round(1 / (1 + exp(-s)) / t, 5) AS p FROM p")
def linear_predict(spark, d):
    p = classifiers.predicted(vectors(spark, d), _linear(spark, d), "v")
    return p.select("id", "predicted", F.round(F.array_max("scores"), 5).alias("score"), F.round(F.array_max(classifiers.probabilities(F.col("scores"))), 5).alias("p"))


@query(_LIN.replace("any_value(v ORDER BY id)", "any_value(v)") + " SELECT round(avg((label = truth)::INT::DOUBLE) * 100, 6) AS accuracy FROM p")
def linear_accuracy(spark, d):
    p = classifiers.predicted(vectors(spark, d), _linear(spark, d), "v")
    return stats.accuracy(p, "label", "predicted").select(r6("accuracy").alias("accuracy"))


_CENT = EM + ", x AS (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) AS v FROM e), m AS (SELECT label, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(v) AS m FROM x GROUP BY 1, 2) GROUP BY 1), n AS (SELECT id, label, k FROM (SELECT e.id, e.label, c.label AS k, row_number() OVER (PARTITION BY e.id ORDER BY " + _DIST + ", c.label) AS r FROM e, m c) WHERE r = 1), t AS (SELECT label AS truth, k AS predicted, count(*) AS n FROM n GROUP BY 1, 2), g AS (SELECT a.x::INT AS truth, b.x::INT AS predicted FROM range(0, 10) a(x), range(0, 10) b(x))"


@query(_CENT + " SELECT truth, predicted, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY truth), 6) AS share FROM g LEFT JOIN t USING (truth, predicted)")
def nearest_centroid(spark, d):
    """Class centroids, nearest-centroid labels and their confusion matrix."""
    df = vectors(spark, d)
    rows = stats.vector_mean(df, "v", ("label",)).orderBy("label").collect()
    labels = F.array(*[F.lit(r.label) for r in rows])
    near = encoders.assigned(df, np.array([r["mean"] for r in rows]), "v").withColumn("predicted", F.get(labels, F.col("k")))
    return stats.confusion(near, "label", "predicted").select("truth", "predicted", r6("share").alias("share"))


@query()
def kmeans_train(spark, d):
    centers, sizes = encoders.kmeans(vectors(spark, d), 8, seed=3, rounds=10, vec="v")
    return spark.createDataFrame([(i, float(s), [float(x) for x in c]) for i, (c, s) in enumerate(zip(centers, sizes, strict=True))], "k int, size double, center array<double>")


@query()
def gmm_train(spark, d):
    w, mu, var = encoders.gmm(vectors(spark, d).select(F.slice("v", 1, 4).alias("v")), 3, seed=2, rounds=5, vec="v")
    return spark.createDataFrame([(i, float(a), [float(x) for x in m], [float(x) for x in s]) for i, (a, m, s) in enumerate(zip(w, mu, var, strict=True))], "k int, weight double, mu array<double>, variance array<double>")


@query()
def svm_train(spark, d):
    """L2-regularised squared-hinge machines on all vectors, and the share they get right."""
    df = vectors(spark, d)
    model = classifiers.train_linear(df, 64, 1.0, vec="v", rounds=5)
    return stats.accuracy(classifiers.predicted(df, model, "v"), "label", "predicted")


_GAPS = "SELECT label::DOUBLE AS label, TRUE AS solved FROM embeddings GROUP BY label"


def _gaps(spark, labels, gaps):
    return spark.createDataFrame([(float(y), bool(g <= 1e-3)) for y, g in zip(labels, gaps, strict=True)], "label double, solved boolean")


@query(_GAPS)
def dual_hinge(spark, d):
    """Whether each label's hinge machine, solved in its dual over all vectors, is within a thousandth of its optimum."""
    model, gap = duals.train_dual(vectors(spark, d), 64, 1.0, vec="v")
    return _gaps(spark, model.labels, gap)


@query(_GAPS)
def joint_hinge(spark, d):
    """As dual_hinge, for the one machine of all labels."""
    model, gap = duals.train_joint(vectors(spark, d), 64, 1.0, vec="v")
    return _gaps(spark, model.labels, [gap] * len(model.labels))


@query(_GAPS)
def sparse_hinge(spark, d):
    """As dual_hinge, for the machines with an L1 penalty: whether each label's optimality condition holds within a thousandth."""
    model, violation = classifiers.train_sparse(vectors(spark, d), 64, 1.0, vec="v")
    return _gaps(spark, model.labels, violation)


@query(_GAPS)
def kernel_machines_all(spark, d):
    """As sparse_hinge, for kernel machines trained on all vectors."""
    model = kernel_duals.train_kernel_all(vectors(spark, d), vec="v")
    return _gaps(spark, model.labels, model.violations)


@query()
def cross_validation(spark, d):
    df = vectors(spark, d)
    scores = classifiers.cross_validated(df, 3, lambda train: lambda test, m=classifiers.train_linear(train, 64, vec="v", rounds=3): classifiers.predicted(test, m, "v"))
    return spark.createDataFrame(list(enumerate(map(float, scores))), "fold int, accuracy double")


def _summary(df, *keys):
    return df.select(*keys, "rows", "cols", F.round(F.aggregate("data", F.lit(0.0), lambda s, x: s + x), 6).alias("s"))


@query()
def augment(spark, d):
    how = geometry.Augmentation(8, 8, 180, (0.8, 1.2), (0.5, 1.5), (0.0, 0.2))
    return _summary(geometry.augmented(images(spark, d), how, seed=5), "id")


def _stacks(spark, d):
    return geometry.log_polar_stack(images(spark, d), 16, 16, [(3.5, 3.5)], 3.5).drop("point")


@query()
def pinwheel_pyramid(spark, d):
    f = pyramids.pyramid_features(_stacks(spark, d), pyramids.Pyramid(16, 16, 2, 4, 4))
    return f.select("id", "level", "point", F.size("vec").alias("n"), F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 6).alias("s"))


@query()
def scattering(spark, d):
    f = pyramids.scattering_features(_stacks(spark, d), pyramids.Pyramid(16, 16, 2, 2), 1)
    return f.select("id", "layer", F.size("vec").alias("n"), F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 5).alias("s"))


@query()
def laplacian_energy(spark, d):
    def f(a: np.ndarray, _: dict) -> np.ndarray:
        return np.array([[[float((p * p).sum()) for p in geometry.laplacian_pyramid(a[0], 2)]]])

    return _summary(geometry.stage(images(spark, d), f), "id")


@query()
def wavelet_energy(spark, d):
    def f(a: np.ndarray, _: dict) -> np.ndarray:
        return np.array([[[float(sum((p * p).sum() for p in b)) for b in geometry.wavelet_transform(a[0], 2)]]])

    return _summary(geometry.stage(images(spark, d), f), "id")
