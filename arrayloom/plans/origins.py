"""Queries: origins, keypoint features, maps by size, pyramid stability, one-dimensional transforms, layered encodings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import classifiers, encoders, filters, fourier, joins, origins
from .models import _GMM, _mixture
from .registry import EM, PX, images, query, r6, vectors
from .resampling import _GAUSS, _convolved

#: The vectors as images of 4 channels, 4 x 4.
_CH = PX + ", ch AS (SELECT id, label, i // 16 AS c, i % 16 // 4 AS y, i % 4 AS x, v FROM px), n AS (SELECT id, y, x, c, v / sqrt(sum(v * v) OVER (PARTITION BY id, y, x)) AS v FROM ch) "


def _channels(spark, d):
    v = vectors(spark, d).select("id", F.posexplode("v").alias("i", "v"))
    at = lambda e: F.floor(e).cast("int")
    return v.select("id", at(F.col("i") / 16).alias("c"), at(F.col("i") % 16 / 4).alias("y"), (F.col("i") % 4).alias("x"), "v")


@query(_CH + "SELECT id, y::INT AS y, x::INT AS x, (abs(y - 2) <= 1 AND abs(x - 2) <= 1)::INT AS target, round(sum(v * (c + 1)), 6) + 0.0 AS s FROM n WHERE (abs(y - 2) <= 1 AND abs(x - 2) <= 1) OR (y % 2 = 0 AND x % 2 = 0) GROUP BY ALL")
def origin_rows(spark, d):
    """Training rows; s weighs a row's channels by their number."""
    rows = origins.origin_rows(_channels(spark, d), 1, 2, 4, 4)
    s = F.aggregate(F.transform("vec", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return rows.select("id", "y", "x", "target", r6(s).alias("s"))


@query(_CH + "SELECT id, y::INT AS y, x::INT AS x FROM n GROUP BY ALL HAVING sum(v * [0.5, -0.25, 1.0, 0.125][c + 1]) > sum(v * [-0.5, 0.25, 0.5, 0.75][c + 1])")
def predicted_origins(spark, d):
    """By a fixed model of labels 1 and 0."""
    model = classifiers.Linear((0.0, 1.0), np.array([[-0.5, 0.25, 0.5, 0.75], [0.5, -0.25, 1.0, 0.125]]))
    return origins.predicted_origins(_channels(spark, d), model)


def _responses(spark, d):
    """Rows of images as scales (y // 2), positions and angular frequencies; reversed responses are those of the mirrored vector."""
    v = vectors(spark, d).select("id", F.posexplode("v").alias("i", "re"))
    mirrored = v.select("id", (63 - F.col("i")).alias("i"), F.col("re").alias("rre"))
    at = lambda e: F.floor(e).cast("int")
    df = v.join(mirrored, ["id", "i"])
    return df.select(at(F.col("id") / 3).alias("id"), (F.col("id") % 3).cast("int").alias("s"), at(F.col("i") / 16).alias("y"), at(F.col("i") % 16 / 4).alias("x"), (F.col("i") % 4).alias("af"), "re", F.lit(0.0).alias("im"), "rre", F.lit(0.0).alias("rim"))


_SYM = (
    PX + ", z AS (SELECT (a.id // 3)::INT AS id, (a.id % 3)::INT AS s, (a.i // 16)::INT AS y, (a.i % 16 // 4)::INT AS x, (a.i % 4)::INT AS af, CASE WHEN abs(a.v) < 1e-6 THEN 0 ELSE a.v END AS re, b.v AS rre FROM px a JOIN px b ON a.id = b.id AND b.i = 63 - a.i), "
    "r AS (SELECT id, s, y, x, n, 'rot' AS k, sum((1 - cos(af * (2 * pi() * n / 12 - pi()))) * abs(re)) AS v FROM z, range(0, 12) t(n) GROUP BY ALL UNION ALL SELECT id, s, y, x, n, 'ref', sum(sqrt(pow(re - cos(-2 * af * pi() * n / 12) * rre, 2) + pow(sin(-2 * af * pi() * n / 12) * rre, 2))) FROM z, range(0, 12) t(n) GROUP BY ALL), "
    "e AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM r WINDOW w AS (PARTITION BY id, s, y, x, k ORDER BY n)), f AS (SELECT *, CASE WHEN v > a AND v > b THEN 1 ELSE -1 END AS up FROM e WHERE (v > a AND v > b) OR (v < a AND v < b)), "
    "g AS (SELECT *, max(v) OVER (PARTITION BY id, s, y, x, k) AS t, min(v) OVER (PARTITION BY id, s, y, x, k) AS l FROM f), d AS (SELECT id, s, y, x, sum(CASE WHEN k = 'rot' AND up = -1 AND t <> 0 THEN (t - v) / t WHEN k = 'ref' AND up = 1 AND t <> l THEN (t - v + l) / (t - l) ELSE 0 END) AS v FROM g GROUP BY ALL), "
    "sum_ AS (SELECT p.id, p.s, p.y, p.x, coalesce(d.v, 0) AS v FROM (SELECT DISTINCT id, s, y, x FROM z) p LEFT JOIN d USING (id, s, y, x)) "
)


@query(_SYM + "SELECT id, s, y, x, round(v, 3) + 0.0 AS v FROM sum_")
def symmetry_sum(spark, d):
    return origins.symmetry_sum(_responses(spark, d), 12).select("id", "s", "y", "x", (F.round("v", 3) + F.lit(0.0)).alias("v"))


@query(_SYM + ", k AS (SELECT a.* FROM sum_ a WHERE a.v > 1 AND a.y BETWEEN 1 AND 2 AND a.x BETWEEN 1 AND 2 AND NOT EXISTS (SELECT 1 FROM sum_ b WHERE b.id = a.id AND abs(b.s - a.s) <= 1 AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 AND NOT (b.s = a.s AND b.y = a.y AND b.x = a.x) AND b.v >= a.v)) SELECT id, s, y, x, round(sum(abs(re) * (af + 1)), 5) AS m FROM k JOIN z USING (id, s, y, x) GROUP BY ALL")
def keypoint_features(spark, d):
    """m weighs a keypoint's magnitudes by frequency."""
    raw = origins.keypoint_features(_responses(spark, d), 12, 1.0, 4, 4)
    m = F.aggregate(F.transform("vec", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return raw.select("id", "s", "y", "x", F.round(m, 5).alias("m"))


@query(EM + "SELECT id, 4 AS channels, 4 AS rows, 4 AS cols, round(list_sum(list_transform(v[33:64] || v[17:32] || v[1:16], lambda x, i: x * i)), 4) + 0.0 AS s FROM e UNION ALL SELECT id, 1, 2, 4, round(list_sum(list_transform(v[1:8], lambda x, i: x * i)), 4) + 0.0 FROM e")
def maps_by_size(spark, d):
    """Three maps of 4 x 4, one of them with two channels, and one of 2 x 4; s weighs values by place."""
    part = lambda k, c, r, a, n: F.struct(F.lit(k).alias("map"), F.lit(c).alias("channels"), F.lit(r).alias("rows"), F.lit(4).alias("cols"), F.slice("v", a, n).alias("data"))
    maps = vectors(spark, d).select("id", "label", F.inline(F.array(part(0, 1, 4, 1, 16), part(1, 1, 4, 17, 16), part(2, 2, 4, 33, 32), part(3, 1, 2, 1, 8))))
    s = F.aggregate(F.transform("data", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return origins.maps_by_size(maps).select("id", "channels", "rows", "cols", (F.round(s, 4) + F.lit(0.0)).alias("s"))


@query(PX + ", n AS (SELECT id, y, sqrt(sum(v * v)) / 8 AS n FROM px GROUP BY 1, 2) SELECT a.id, round(sqrt(sum(pow(a.n - b.n, 2))) / 8, 6) AS s FROM n a JOIN n b ON b.id = a.id + 1 AND a.y = b.y GROUP BY 1")
def pyramid_stability(spark, d):
    """Rows of an image and of the next as bands."""
    bands = vectors(spark, d).select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("v", k * 8 + 1, F.lit(8)))).alias("band", "data")).select("*", F.lit(1).alias("rows"), F.lit(8).alias("cols"))
    both = bands.join(bands.select((F.col("id") - 1).alias("id")).distinct(), "id", "left_semi")
    later = bands.withColumn("id", F.col("id") - 1).filter("id >= 0")
    return origins.stability(both, later).select("id", r6("s").alias("s"))


@query(PX + "SELECT id, round(sqrt(pow(sum(abs(a.v) * a.v), 2) + pow(sum(abs(a.v) * b), 2)) / sum(abs(a.v)), 6) AS m FROM (SELECT *, lead(v, 1, 0) OVER (PARTITION BY id ORDER BY i) AS b FROM px) a GROUP BY id")
def weighted_magnitude(spark, d):
    """Values with their followers as imaginary parts, weighted by size."""
    v = vectors(spark, d).select("id", F.posexplode(F.arrays_zip("v", F.concat(F.slice("v", 2, 63), F.array(F.lit(0.0))).alias("b"))).alias("i", "z")).select("id", F.col("z.v").alias("re"), F.col("z.b").alias("im"))
    return v.groupBy("id").agg(r6(origins.weighted_magnitude(F.abs("re"), F.col("re"), F.col("im"))).alias("m"))


@query(PX + ", w AS (SELECT id, x AS i, v FROM px WHERE y = 0) SELECT a.id, round(sum(a.v * b.v * (a.i * 8 + b.i)), 5) + 0.0 AS q, round(sum(a.v * b.v), 5) + 0.0 AS s FROM w a JOIN w b ON a.id = b.id GROUP BY 1")
def quadratic_forms(spark, d):
    """x' W x for a fixed W, and the sum of the outer product, of the first eight values."""
    x = F.slice("v", 1, 8)
    w = F.array(*[F.array(*[F.lit(float(i * 8 + j)) for j in range(8)]) for i in range(8)])
    s = F.aggregate(F.flatten(origins.crossed(x, x)), F.lit(0.0), lambda a, v: a + v)
    return vectors(spark, d).select("id", (F.round(origins.xtwx(x, w), 5) + F.lit(0.0)).alias("q"), (F.round(s, 5) + F.lit(0.0)).alias("s"))


def _flat(spark, d):
    return vectors(spark, d).select("id", F.col("v").alias("re"), F.transform("v", lambda x: F.lit(0.0)).alias("im"))


def _cells(df, n: int = 8):
    both = df.select("id", F.posexplode(F.arrays_zip("re", "im")).alias("i", "z"))
    z = lambda c: (F.round(F.col(f"z.{c}"), 5) + F.lit(0.0)).alias(c)
    return both.select("id", F.floor(F.col("i") / n).cast("int").alias("y"), (F.col("i") % n).cast("int").alias("k"), z("re"), z("im"))


_ROW = PX + ", f AS (SELECT id, y, k::INT AS k, sum(v * cos(2 * pi() * k * x / 8)) AS re, {}sum(v * sin(2 * pi() * k * x / 8)) AS im FROM px, range(0, {}) t(k) GROUP BY ALL) SELECT id, y, k, round(re{}, 5) + 0.0 AS re, round(im{}, 5) + 0.0 AS im FROM f"


@query(_ROW.format("-", 8, "", ""))
def dft_rows(spark, d):
    """Along the trailing axis."""
    return _cells(fourier.transformed(_flat(spark, d), (8, 8), (1,)))


@query(PX + ", f AS (SELECT id, k::INT AS y, x AS k, sum(v * cos(2 * pi() * k * y / 8)) AS re, -sum(v * sin(2 * pi() * k * y / 8)) AS im FROM px, range(0, 8) t(k) GROUP BY ALL) SELECT id, y, k, round(re, 5) + 0.0 AS re, round(im, 5) + 0.0 AS im FROM f")
def dft_columns(spark, d):
    """Along the leading axis."""
    return _cells(fourier.transformed(_flat(spark, d), (8, 8), (0,)))


@query(_ROW.format("", 8, " / 8", " / 8"))
def inverse_dft_rows(spark, d):
    return _cells(fourier.transformed(_flat(spark, d), (8, 8), (1,), "ifft"))


@query(_ROW.format("", 8, "", ""))
def plain_inverse_dft_rows(spark, d):
    """Not divided by the size."""
    return _cells(fourier.transformed(_flat(spark, d), (8, 8), (1,), "ifft_plain"))


@query(_ROW.format("-", 5, "", ""))
def real_dft_rows(spark, d):
    """Of real input, the first half and one."""
    return _cells(fourier.transformed(_flat(spark, d), (8, 8), (1,), "rfft"), 5)


@query(PX + ", f AS (SELECT id, ky::INT AS y, kx::INT AS k, sum(v * cos(2 * pi() * (ky * y + kx * x) / 8)) AS re, -sum(v * sin(2 * pi() * (ky * y + kx * x) / 8)) AS im FROM px, range(0, 8) a(ky), range(0, 5) b(kx) GROUP BY ALL) SELECT id, y, k, round(re, 5) + 0.0 AS re, round(im, 5) + 0.0 AS im FROM f")
def real_dft_2d(spark, d):
    return _cells(fourier.transformed(_flat(spark, d), (8, 8), (0, 1), "rfft"), 5)


@query(_convolved(_GAUSS, "(VALUES (2), (4))", "(y - 2) // 2 * 2 + (x - 2) // 2").replace("round(sqrt(re * re + im * im), 5)", "round(sqrt(re * re + im * im) / sqrt(sum(re * re + im * im) OVER (PARTITION BY id, y, x)), 5)"))
def non_invariant_descriptors(spark, d):
    """At grid centres, magnitudes of all filters over their length."""
    out = filters.grid_descriptors(images(spark, d), filters.Bank("gaussian", 2.0, (0.0, 1.0), (0, 1)), [2, 4], [2, 4])
    return out.select("id", "point", F.posexplode("vec").alias("f", "m")).select("id", "point", "f", (F.round("m", 5) + F.lit(0.0)).alias("m"))


_FV = _GMM + ", x AS (SELECT label, k, w, a, generate_subscripts(v, 1) - 1 AS i, unnest(v) AS x, unnest(mu) AS m FROM a), n AS (SELECT label, count(*) AS n FROM e GROUP BY 1), g AS (SELECT x.label, k, i, sum(a * (x - m)) / 0.05 * sqrt(0.05 / (any_value(n) * any_value(w))) AS gm, sum(a * (pow(x - m, 2) / 0.05 - 1)) * sqrt(0.5 / (any_value(n) * any_value(w))) AS gv FROM x JOIN n ON x.label = n.label GROUP BY 1, 2, 3), f AS (SELECT label, k * 64 + i AS j, gm AS s FROM g UNION ALL SELECT label, 192 + k * 64 + i, gv FROM g), u AS (SELECT label, j, sign(s) * sqrt(abs(s)) AS s FROM f), l AS (SELECT label, j, s / sqrt(sum(s * s) OVER (PARTITION BY label)) AS s FROM u) "


@query(_FV + "SELECT label, j::INT AS j, round(s, 4) + 0.0 AS s FROM l UNION ALL SELECT label, (j + 384)::INT, round(s, 4) + 0.0 FROM l")
def layered_fisher_vectors(spark, d):
    """Two layers (here: the same) end to end, each over its length."""
    df = vectors(spark, d)
    f = encoders.layered_fisher_vectors([df, df], [_mixture(spark, d)] * 2, ["label"], "v")
    return f.select("label", F.posexplode("vec").alias("j", "s")).select("label", "j", (F.round("s", 4) + F.lit(0.0)).alias("s"))


@query("WITH p AS (SELECT p_partkey AS id, p_size::DOUBLE AS s, p_retailprice / 10 AS r, p_partkey % 2 AS c FROM part), g AS (SELECT p.*, count(*) FILTER (q.c = p.c) AS own, count(*) FILTER (q.c <> p.c) AS other FROM p JOIN p q ON pow(p.s - q.s, 2) + pow(p.r - q.r, 2) <= 9 GROUP BY ALL), t AS (SELECT *, own / greatest(sum(own) OVER (PARTITION BY c), 1) AS a, other / greatest(sum(other) OVER (PARTITION BY c), 1) AS b FROM g) SELECT round(2 / (sum(CASE WHEN a = 0 THEN 0 ELSE a * ln(a / ((a + b) / 2)) END) + 0.001), 5) AS s FROM t")
def cloud_similarity(spark, d):
    """Parts with even numbers against those with odd ones, as clouds of size and price."""
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("s"), (F.col("p_retailprice") / 10).alias("r"), (F.col("p_partkey") % 2).alias("c"))
    a, b = p.filter("c = 0"), p.filter("c = 1")
    grid = p.select(F.when(F.col("c") == 0, "a").otherwise("b").alias("cloud"), F.col("id").alias("g"), "s", "r")
    return joins.cloud_similarity(a, b, grid, ["s", "r"], 3.0).select(F.round("s", 5).alias("s"))
