"""Queries: filter-bank features, pair features, mixtures and machines beyond the fixed models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import classifiers, filters, geometry, joins, mixtures, stats
from ..sources import readers
from .registry import PX, images, pixels, query, r6, table, vectors


def _sum(c: str = "vec"):
    return F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), 5)


_Z = "z AS (SELECT a.id, a.x AS pos, a.y + 1 AS af, a.v AS re, b.v AS im FROM px a JOIN px b ON a.id = b.id AND a.x = b.x AND b.y = a.y + 4 WHERE a.y < 3)"


@query(
    PX + f", {_Z}, p AS (SELECT a.id, a.af AS a_af, b.af AS b_af, sqrt(a.re * a.re + a.im * a.im) AS am, sqrt(b.re * b.re + b.im * b.im) AS bm, b.af * atan2(a.im, a.re) - a.af * atan2(b.im, b.re) AS ph FROM z a JOIN z b ON a.id = b.id AND a.pos = b.pos AND a.af < b.af) "
    "SELECT id, a_af::INT AS a_af, b_af::INT AS b_af, round(sum(am * bm * cos(ph)) / sum(am * bm), 6) AS jrp_cos, round(sum(am * bm * sin(ph)) / sum(am * bm), 6) AS jrp_sin, round(sum(am * bm * least(am / bm, bm / am)) / sum(am * bm), 6) AS mrm FROM p GROUP BY 1, 2, 3"
)
def pair_features(spark, d):
    """Rows of the images as responses at three frequencies: weighted relative phases and magnitude ratios."""
    px = pixels(spark, d)
    im = px.select("id", "x", (F.col("y") - 4).alias("y"), F.col("v").alias("im"))
    z = px.filter("y < 3").join(im, ["id", "x", "y"]).select("id", F.col("x").alias("pos"), (F.col("y") + 1).alias("af"), F.col("v").alias("re"), "im")
    out = filters.pair_features(z)
    return out.select("id", F.col("a_af").cast("int").alias("a_af"), F.col("b_af").cast("int").alias("b_af"), r6("jrp_cos").alias("jrp_cos"), r6("jrp_sin").alias("jrp_sin"), r6("mrm").alias("mrm"))


_AB = "ab AS (SELECT a.id, a.v AS are, b.v AS aim, c.v AS bre, e.v AS bim FROM px a JOIN px b ON a.id = b.id AND a.i < 16 AND b.i = a.i + 16 JOIN px c ON a.id = c.id AND c.i = a.i + 32 JOIN px e ON a.id = e.id AND e.i = a.i + 48)"


def _ab(spark, d):
    v = vectors(spark, d)
    parts = [F.slice("v", 1 + 16 * k, 16).alias(n) for k, n in enumerate(("are", "aim", "bre", "bim"))]
    return v.select("id", F.arrays_zip(*parts).alias("z")).select("id", F.inline("z")).toDF("id", "are", "aim", "bre", "bim")


@query(PX + f", {_AB} SELECT id, round(-sqrt(sum(pow(are - bre, 2) + pow(aim - bim, 2))), 6) AS d FROM ab GROUP BY id")
def complex_distance(spark, d):
    return joins.complex_distance(_ab(spark, d), ["id"]).select("id", r6("d").alias("d"))


@query(PX + f", {_AB} SELECT id, round(sqrt(pow(sum(are * bre + aim * bim), 2) + pow(sum(aim * bre - are * bim), 2)) / sum(sqrt(are * are + aim * aim) * sqrt(bre * bre + bim * bim)), 6) AS c FROM ab GROUP BY id")
def complex_correlation(spark, d):
    c = filters.complex_correlation(*map(F.col, ("are", "aim", "bre", "bim")))
    return _ab(spark, d).groupBy("id").agg(r6(c).alias("c"))


@query(PX + "SELECT id, (i % 2)::INT AS f, round(sqrt(pow(sum(v * cos(i)), 2) + pow(sum(v * sin(i)), 2)), 5) AS m FROM px WHERE v > 0.1 GROUP BY 1, 2")
def sparse_responses(spark, d):
    """Pixels over a threshold against a sparse bank of two filters, on even and on odd pixels."""
    px = pixels(spark, d).filter("v > 0.1").select("id", (F.col("y") * 8 + F.col("x")).alias("i"), "v")
    bank = spark.range(64).select((F.col("id") % 2).cast("int").alias("f"), F.col("id").cast("int").alias("i"), F.cos(F.col("id")).alias("re"), F.sin(F.col("id")).alias("im"))
    return filters.sparse_responses(px, bank).select("id", "f", F.round("m", 5).alias("m"))


@query("SELECT p_partkey, p_brand, r <= 3 AS train FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part)")
def half_per_class(spark, d):
    """The first three of each class train."""
    from ..operators.cells import top_k

    p = table(spark, d, "part").withColumn("neg", -F.col("p_partkey"))
    top = top_k(p, 3, "neg", "p_partkey", ["p_brand"]).select("p_partkey", F.lit(True).alias("t"))
    return p.join(top, "p_partkey", "left").select("p_partkey", "p_brand", F.coalesce("t", F.lit(False)).alias("train"))


@query(PX + "SELECT id, count(*) AS n, round(sum(v), 5) AS s FROM px WHERE v <> 0 GROUP BY id")
def sparse_encoding(spark, d):
    s = vectors(spark, d).select("id", readers.dense_to_sparse(F.col("v")).alias("s"))
    return s.select("id", F.size("s").cast("long").alias("n"), F.round(F.aggregate(F.col("s.v"), F.lit(0.0), lambda a, x: a + x), 5).alias("s"))


def _bank() -> filters.Bank:
    return filters.Bank("gaussian", 2.0, (0.0, 1.0), (0, 1))


@query()
def composite_phases(spark, d):
    return filters.composite_features(images(spark, d), filters.Composite(filters.Bank("gaussian", 2.0, (0.0, 1.0), (1, 2)), grid=True)).select("id", F.size("vec").alias("n"), _sum().alias("s"))


@query()
def scattering_descriptors(spark, d):
    out = filters.scattering_descriptors(images(spark, d), _bank(), _bank(), 2, 4)
    return out.select("id", "point", F.size("vec").alias("n"), _sum().alias("s"))


@query()
def feature_mixtures(spark, d):
    return mixtures.feature_mixtures(vectors(spark, d).select(F.slice("v", 1, 3).alias("v")), 2, seed=1, rounds=3, vec="v")


@query()
def mppca_fisher(spark, d):
    df = vectors(spark, d).select(F.col("label").cast("long").alias("id"), F.slice("v", 1, 6).alias("v"))
    model = mixtures.train_mppca(df, 6, 2, 2, seed=1, rounds=4, vec="v")
    return mixtures.mppca_fisher(df, model, "v").select("key", F.size("vec").alias("n"))


@query()
def axes_encoding(spark, d):
    df = vectors(spark, d).select("label", F.slice("v", 1, 6).alias("v"))
    return mixtures.axes_encoding(df, ["label"], 2, "v").select("label", F.size("vec").alias("n"))


@query()
def kernel_machine(spark, d):
    df = vectors(spark, d)
    models = classifiers.train_kernel(df, most_rows=300, vec="v")
    return stats.accuracy(classifiers.kernel_predicted(df, models, "v"), "label", "predicted")


@query()
def steerable_energy(spark, d):
    def f(a: np.ndarray, _: dict) -> np.ndarray:
        return np.array([[[float((p * p).sum()) for b in geometry.steerable_pyramid(a[0], 1) for p in b]]])

    return geometry.stage(images(spark, d), f).select("id", F.transform("data", lambda x: F.round(x, 5)).alias("energy"))


@query()
def reconstruction(spark, d):
    """Images from the magnitudes of their filtered maps: how far the error falls in 20 rounds."""

    def f(a: np.ndarray, _: dict) -> np.ndarray:
        spectra = _bank().spectra(*a.shape[1:])[0]
        target = np.abs(np.fft.ifft2(np.fft.fft2(a[0])[None] * spectra))
        _, errors = filters.from_magnitudes(target, spectra, np.full(a.shape[1:], 0.1), threshold=0.0, rounds=20)
        return np.array([[[errors[-1] / errors[0]]]])

    return geometry.stage(images(spark, d), f).select("id", F.round(F.get("data", F.lit(0)), 5).alias("ratio"))
