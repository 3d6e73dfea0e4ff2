"""Queries: resampled images and filtered ones, value by value, each with SQL that states the rule anew."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import filters, geometry, pyramids, stats
from .registry import PX, images, query, r6, vectors


def _sql(points: str, rows: int, cols: int, lo: str = "min(v)", hi: str = "max(v)", src: str = "SELECT id, y, x, v FROM px", out: str = "v") -> str:
    """SQL of bicubic values at points (o, ty, tx) of images src: cubics through values with central slopes, cut to lo..hi; 0 outside.

    Weights of an axis are stated by pixel, as slopes are halved differences of neighbours.
    """

    def axis(t: str, n: int) -> str:
        cubic = [("a", "1 - 3 * u * u + 2 * u * u * u"), ("a + 1", "3 * u * u - 2 * u * u * u")]
        for at, w in (("a", "(u - 2 * u * u + u * u * u) / 2"), ("a + 1", "(u * u * u - u * u) / 2")):
            cubic += [(f"least({at} + 1, {n - 1})", w), (f"greatest({at} - 1, 0)", f"-({w})")]
        each = " UNION ALL ".join(f"SELECT o, {k} AS k, {w} AS w FROM u{t}" for k, w in cubic)
        start = f"u{t} AS (SELECT o, a, {t} - a AS u FROM (SELECT o, {t}, greatest(0, least(floor({t}), {n - 2})) AS a FROM inside))"
        return f"{start}, w{t} AS (SELECT o, k, sum(w) AS w FROM ({each}) GROUP BY ALL)"

    return PX + (
        f", src AS ({src}), pts AS ({points}), inside AS (SELECT * FROM pts WHERE ty BETWEEN 0 AND {rows - 1} AND tx BETWEEN 0 AND {cols - 1}), {axis('ty', rows)}, {axis('tx', cols)}, "
        f"ends AS (SELECT id, ({lo})::DOUBLE AS lo, ({hi})::DOUBLE AS hi FROM src GROUP BY id), "
        "got AS (SELECT id, b.o, sum(b.w * c.w * v) AS v FROM src JOIN wty b ON b.k = y JOIN wtx c ON c.k = x AND b.o = c.o GROUP BY ALL), "
        "full_ AS (SELECT e.id, p.o, CASE WHEN g.v IS NULL THEN 0 ELSE greatest(lo, least(hi, g.v)) END AS v FROM ends e CROSS JOIN pts p LEFT JOIN got g ON g.id = e.id AND g.o = p.o) "
        f"SELECT id, o::INT AS o, round({out}, 5) + 0.0 AS v FROM full_"
    )


def _grid(rows: int, cols: int, y: str, x: str) -> str:
    return f"SELECT (r * {cols} + q) AS o, ({y})::DOUBLE AS ty, ({x})::DOUBLE AS tx FROM range(0, {rows}) a(r), range(0, {cols}) b(q)"


def _values(df, *keys):
    """A row for each value: its place o among the image's values."""
    return df.select("id", *keys, F.posexplode("data").alias("o", "v")).select("id", *keys, "o", (F.round("v", 5) + F.lit(0.0)).alias("v"))


def _wide(spark, d):
    """The same vectors as images of 4 x 16."""
    return vectors(spark, d).select("id", "label", F.lit(1).alias("channels"), F.lit(4).alias("rows"), F.lit(16).alias("cols"), F.col("v").alias("data"))


@query(_sql(_grid(16, 16, "r * (7 / 15)", "q * (7 / 15)"), 8, 8, hi="1.0"))
def resize(spark, d):
    return _values(geometry.stage(images(spark, d), lambda a, _: geometry.resize_longest(a, 16, 1.0)))


@query(_sql(_grid(3, 12, "r * (3 / 2)", "q * (15 / 11)"), 4, 16, hi="1.0", src="SELECT id, i // 16 AS y, i % 16 AS x, v FROM px"))
def resize_wide(spark, d):
    """The longer side becomes 12, the other keeps the aspect."""
    return _values(geometry.stage(_wide(spark, d), lambda a, _: geometry.resize_longest(a, 12, 1.0)))


@query(_sql(_grid(6, 6, "r * (3 / 5)", "q * (3 / 5)"), 4, 4, lo="0.0", hi="255.0", src="SELECT id, i // 16 AS y, i % 16 - 6 AS x, v FROM px WHERE i % 16 BETWEEN 6 AND 9"))
def crop_resize(spark, d):
    return _values(geometry.stage(_wide(spark, d), lambda a, _: geometry.crop_resize(a, 6)))


def _pad_sql(n: int, y: str, x: str) -> str:
    return f"SELECT g.id, g.y, g.x, coalesce(p.v, 0.0) AS v FROM (SELECT id, r::INT AS y, q::INT AS x FROM (SELECT DISTINCT id FROM px), range(0, {n}) a(r), range(0, {n}) b(q)) g LEFT JOIN (SELECT id, ({y})::INT AS y, ({x})::INT AS x, v FROM px) p ON p.id = g.id AND p.y = g.y AND p.x = g.x"


@query(_sql(_grid(12, 12, "r * (15 / 11)", "q * (15 / 11)"), 16, 16, lo="least(0.0, min(v))", hi="255.0", src=_pad_sql(16, "i // 16 + 6", "i % 16")))
def pad_resize(spark, d):
    return _values(geometry.stage(_wide(spark, d), lambda a, _: geometry.pad_resize(a, 12)))


def _turn(n: int, step: float) -> str:
    """Points of all turns of an n x n image: where each pixel comes from; positions within 1e-9 of a whole number are that."""
    c = (n - 1) / 2
    t = f"(k * {step} * pi() / 180)"
    near = lambda e: f"(CASE WHEN abs({e} - round({e})) < 1e-9 THEN round({e}) ELSE {e} END)"
    y, x = f"((r - {c}) * cos{t} - (q - {c}) * sin{t} + {c})", f"((r - {c}) * sin{t} + (q - {c}) * cos{t} + {c})"
    return f"SELECT (k * {n * n} + r * {n} + q) AS o, ({near(y)})::DOUBLE AS ty, ({near(x)})::DOUBLE AS tx FROM range(0, {round(360 / step)}) a(k), range(0, {n}) b(r), range(0, {n}) c(q)"


def _turned(df, turn, step: float):
    """All turns of an image end to end."""
    return _values(geometry.stage(df, lambda a, _: np.concatenate([turn(a, x) for x in geometry.angles_of(step)])))


@query(_sql(_turn(8, 45), 8, 8))
def rotate(spark, d):
    return _turned(images(spark, d), geometry.rotated, 45)


@query(_sql(_turn(12, 120), 12, 12, src=_pad_sql(12, "y + 2", "x + 2")))
def rotate_whole(spark, d):
    """Padded to the diagonal first."""
    return _turned(images(spark, d), geometry.rotated_whole, 120)


def _rings(log: bool, cy: str, cx: str) -> str:
    r = "exp(q * ln(3.5) / 8)" if log else "(q * 3.5 / 8)"
    return _grid(16, 8, f"{cy} + sin(r * 2 * pi() / 16) * {r}", f"{cx} + cos(r * 2 * pi() / 16) * {r}")


@query(_sql(_rings(True, "3.5", "3.5"), 8, 8).replace("SELECT id, o::INT", "SELECT id, 0 AS point, o::INT") + " UNION ALL SELECT * FROM (" + _sql(_rings(True, "4.0", "4.0"), 8, 8).replace("SELECT id, o::INT", "SELECT id, 1 AS point, o::INT") + ")")
def log_polar(spark, d):
    return _values(geometry.log_polar_stack(images(spark, d), 16, 8, [(3.5, 3.5), (4.0, 4.0)], 3.5), "point")


@query(_sql(_rings(True, "3.0", "4.0"), 8, 8))
def log_polar_own_centre(spark, d):
    """Centres that stand in the rows."""
    df = images(spark, d).withColumns({"cy": F.lit(3.0), "cx": F.lit(4.0)})
    return _values(geometry.log_polar_stack(df, 16, 8, None, 3.5))


@query(_sql(_rings(False, "3.5", "3.5"), 8, 8, out="v * (2 * pi() * (3.5 / 8) * ((o % 8) * 3.5 / 8) / 16)"))
def polar_rings(spark, d):
    return _values(geometry.stage(images(spark, d), lambda a, _: geometry.polar(a, 16, 8, (3.5, 3.5), 3.5)))


@query(_sql(_rings(True, "3.5", "3.5"), 8, 8, out="(v - min(v) OVER (PARTITION BY id)) / (max(v) OVER (PARTITION BY id) - min(v) OVER (PARTITION BY id)) * 255"))
def log_polar_image(spark, d):
    return _values(geometry.stage(images(spark, d), lambda a, _: geometry.log_polar_image(a, 16, 8, (3.5, 3.5), 3.5)))


_BACK_R = "sqrt(pow(r - 4, 2) + pow(q - 4, 2))"
_BACK_T = "(atan2(r - 4, q - 4) - 2 * pi() * floor(atan2(r - 4, q - 4) / (2 * pi())))"


@query(_sql(_grid(9, 9, f"{_BACK_T} * 8 / (2 * pi())", f"CASE WHEN {_BACK_R} >= 1 THEN ln(greatest({_BACK_R}, 1)) * 8 / ln(4) ELSE -1 END"), 9, 8, src="SELECT id, y, x, v FROM px UNION ALL SELECT id, 8, x, v FROM px WHERE y = 0"))
def log_polar_back(spark, d):
    """Images as rings of 8 angles and 8 radii, back on a grid; the circle closes."""
    return _values(geometry.stage(images(spark, d), lambda a, _: geometry.from_log_polar(a, 9, 9, (4.0, 4.0), 4.0)))


@query(PX + f", p AS ({_pad_sql(11, 'y + 1', 'x + 1')}) SELECT id, (y * 11 + x)::INT AS o, round(v, 5) + 0.0 AS v FROM p")
def pad_image(spark, d):
    return _values(geometry.stage(images(spark, d), lambda a, _: geometry.padded(a, 11, 11)))


@query(PX + "SELECT id, ((y - 1) * 4 + x - 2)::INT AS o, round(v, 5) + 0.0 AS v FROM px WHERE y BETWEEN 1 AND 5 AND x BETWEEN 2 AND 5")
def landmark_box(spark, d):
    return _values(geometry.stage(images(spark, d), lambda a, _: geometry.box(a, 2, 1, 4, 5)))


@query(_sql(_grid(9, 9, "r * (4 / 8)", "q * (4 / 8)"), 5, 5, lo="0.0", hi="255.0", src="SELECT id, y - 1 AS y, x - 2 AS x, v FROM px WHERE y BETWEEN 1 AND 5 AND x BETWEEN 2 AND 6"))
def landmark_square(spark, d):
    """A box of 4 x 5 grown to a square about its centre, resized to 9 x 9."""
    return _values(geometry.stage(images(spark, d), lambda a, _: geometry.square_box(a, 2, 1, 4, 5, 9)))


_TAPS = "(VALUES (-2, 0.05), (-1, 0.25), (0, 0.4), (1, 0.25), (2, 0.05)) {0}(d{0}, w{0})"
_BLUR = "SELECT id, ((y - db + 8) % 8)::INT AS y, ((x - da + 8) % 8)::INT AS x, sum(wa * wb * {c} * v) AS v FROM {src}, " + _TAPS.format("a") + ", " + _TAPS.format("b") + " GROUP BY ALL"


@query(PX + f", small AS (SELECT * FROM ({_BLUR.format(c='1', src='px')}) WHERE y % 2 = 0 AND x % 2 = 0), large AS ({_BLUR.format(c='4', src='small')}) SELECT id, 0 AS level, (y * 8 + x)::INT AS o, round(px.v - large.v, 5) + 0.0 AS v FROM px JOIN large USING (id, y, x) UNION ALL SELECT id, 1, (y // 2 * 4 + x // 2)::INT, round(v, 5) + 0.0 FROM small")
def laplacian_bands(spark, d):
    df = images(spark, d)
    band = lambda k: _values(geometry.stage(df, lambda a, _: geometry.laplacian_pyramid(a[0], 1)[k][None]).withColumn("level", F.lit(k)), "level")
    return band(0).union(band(1))


_LOW = [f"({a} {s} sqrt(3)) / (4 * sqrt(2))" for a, s in ((1, "+"), (3, "+"), (3, "-"), (1, "-"))]
_WAVE = ", ".join(f"({k}, {_LOW[k]}, {'-' if k % 2 else ''}({_LOW[3 - k]}))" for k in range(4))


@query(PX + f", t AS (SELECT * FROM (VALUES {_WAVE}) t(k, lo, hi)), along AS (SELECT id, y, ((x - k + 8) % 8)::INT AS x, sum(lo * v) AS l, sum(hi * v) AS h FROM px, t GROUP BY ALL), c AS (SELECT id, ((y - k + 8) % 8)::INT AS y, x, sum(lo * l) AS ll, sum(hi * l) AS lh, sum(lo * h) AS hl, sum(hi * h) AS hh FROM along, t WHERE x % 2 = 0 GROUP BY ALL), o AS (SELECT id, (y // 2 * 4 + x // 2)::INT AS o, ll, lh, hl, hh FROM c WHERE y % 2 = 0) SELECT id, band, o, round(v, 5) + 0.0 AS v FROM (SELECT id, o, unnest(['lh', 'hl', 'hh', 'll']) AS band, unnest([lh, hl, hh, ll]) AS v FROM o)")
def wavelet_bands(spark, d):
    def f(a: np.ndarray, _: dict) -> np.ndarray:
        details, rest = geometry.wavelet_transform(a[0], 1)
        return np.stack([*details, *rest])

    names = F.array(*map(F.lit, ("lh", "hl", "hh", "ll")))
    v = _values(geometry.stage(images(spark, d), f))
    return v.select("id", F.get(names, F.floor(F.col("o") / 16).cast("int")).alias("band"), (F.col("o") % 16).alias("o"), "v")


@query(PX + "SELECT id, 1 AS n, (i)::INT AS o, round(v, 5) + 0.0 AS v FROM px")
def wavelet_round_trip(spark, d):
    back = geometry.stage(images(spark, d), lambda a, _: geometry.wavelet_inverse(geometry.wavelet_transform(a[0], 2))[None])
    return _values(back.withColumn("n", F.col("channels")), "n")


_AGAIN = PX + "SELECT id, 1 AS n, (i)::INT AS o, round(v, 5) + 0.0 AS v FROM px"


def _again(spark, d, f):
    """All pixels after f(stack), which takes images apart and puts them together."""
    back = geometry.stage(images(spark, d), lambda a, _: f(a))
    return _values(back.withColumn("n", F.col("channels")), "n")


@query(_AGAIN)
def laplacian_round_trip(spark, d):
    return _again(spark, d, lambda a: geometry.laplacian_inverse(geometry.laplacian_pyramid(a[0], 2))[None])


@query(_AGAIN)
def steerable_round_trip(spark, d):
    return _again(spark, d, lambda a: geometry.steerable_inverse(geometry.steerable_pyramid(a[0], 2, 4))[None])


@query(_AGAIN)
def pinwheel_round_trip(spark, d):
    p = pyramids.Pyramid(8, 8, 2, 4)
    return _again(spark, d, lambda a: p.inverse(*p.responses(a)))


@query(PX + "SELECT id, (y // 2 * 4 + x // 2)::INT AS point, round(sign(abs(v)), 6) + 0.0 AS s FROM px WHERE y % 2 = 0 AND x % 2 = 0")
def pixel_descriptors(spark, d):
    """Channel vectors of every second pixel over their length; of one channel, 1."""
    return filters.pixel_features(images(spark, d), 2).select("id", "point", r6(F.get("vec", F.lit(0))).alias("s"))


_OFF = "off AS (SELECT a.dy::INT AS dy, b.dx::INT AS dx, sqrt(a.dy * a.dy + b.dx * b.dx) AS r, CASE WHEN a.dy = 0 AND b.dx = 0 THEN 0 ELSE ln(sqrt(a.dy * a.dy + b.dx * b.dx)) END AS l, atan2(a.dy, b.dx) AS t FROM range(-4, 4) a(dy), range(-4, 4) b(dx))"


def _convolved(bank: str, ys: str, point: str) -> str:
    """SQL of |image * filter| at some pixels, for filters bank (f, dy, dx, re, im)."""
    return PX + f", {_OFF}, k AS ({bank}), z AS (SELECT id, p.y, p.x, f, sum(v * re) AS re, sum(v * im) AS im FROM px JOIN k ON TRUE JOIN (SELECT a.y::INT AS y, b.x::INT AS x FROM {ys} a(y), {ys} b(x)) p ON (px.y + dy - p.y) % 8 = 0 AND (px.x + dx - p.x) % 8 = 0 GROUP BY ALL) SELECT id, ({point})::INT AS point, f::INT AS f, round(sqrt(re * re + im * im), 5) + 0.0 AS m FROM z"


_GAUSS = " UNION ALL ".join(f"SELECT {rf * 2 + af} AS f, dy, dx, CASE WHEN r > 0 THEN exp(-pow(l - ln(2), 2) / 2) * cos({af} * t + {rf} * l) ELSE 0 END AS re, CASE WHEN r > 0 THEN exp(-pow(l - ln(2), 2) / 2) * sin({af} * t + {rf} * l) ELSE 0 END AS im FROM off" for rf in (0, 1) for af in (0, 1))


def _magnitudes(df):
    return df.select("id", "point", F.posexplode("vec").alias("f", "m")).select("id", "point", "f", (F.round("m", 5) + F.lit(0.0)).alias("m"))


@query(_convolved(_GAUSS, "(VALUES (2), (4))", "(y - 2) // 2 * 2 + (x - 2) // 2"))
def magnitude_points(spark, d):
    return _magnitudes(filters.magnitude_points(images(spark, d), filters.Bank("gaussian", 2.0, (0.0, 1.0), (0, 1)), border=2, step=2))


@query(_convolved(_GAUSS, "(VALUES (2), (4))", "(y - 2) // 2 * 2 + (x - 2) // 2").replace("round(sqrt(re * re + im * im), 5)", "round((sqrt(re * re + im * im) - 0.5) / 2, 5)"))
def normalised_magnitudes(spark, d):
    """Magnitudes less a mean of 0.5, over a variance of 2."""
    return _magnitudes(filters.magnitude_points(images(spark, d), filters.Bank("gaussian", 2.0, (0.0, 1.0), (0, 1)), border=2, step=2, normal=(0.5, 2.0)))


@query(_convolved(_GAUSS, "(VALUES (2), (4))", "(y - 2) // 2 * 2 + (x - 2) // 2").replace("f::INT AS f, round(sqrt(re * re + im * im), 5) + 0.0 AS m FROM z", "f::INT AS f, round(re, 5) + 0.0 AS m FROM z UNION ALL SELECT id, ((y - 2) // 2 * 2 + (x - 2) // 2)::INT, (f + 4)::INT, round(im, 5) + 0.0 FROM z"))
def complex_points(spark, d):
    """Real parts, then imaginary ones."""
    return _magnitudes(filters.magnitude_points(images(spark, d), filters.Bank("gaussian", 2.0, (0.0, 1.0), (0, 1)), border=2, step=2, parts=True))


_AT = _convolved(_GAUSS, "range(0, 8)", "y * 8 + x").split(" SELECT id, (")[0]
_AT += ", n AS (SELECT *, sqrt(re * re + im * im) AS m FROM z), c AS (SELECT id, f, round_even(sum((y + 1) * m) / sum(m), 0)::INT - 1 AS cy, round_even(sum((x + 1) * m) / sum(m), 0)::INT - 1 AS cx FROM n GROUP BY id, f)"
_AT += ", w AS (SELECT n.id, n.f, m, re / m AS c, im / m AS s FROM n JOIN c ON n.id = c.id AND n.f = c.f AND n.y = cy AND n.x = cx), p AS (SELECT a.id, least(a.m / b.m, b.m / a.m) AS q, row_number() OVER (PARTITION BY a.id ORDER BY a.f, b.f) + 11 AS o FROM w a JOIN w b ON a.id = b.id AND a.f < b.f)"
_AT += " SELECT id, o::INT AS o, round(v, 5) + 0.0 AS v FROM (SELECT id, f AS o, m AS v FROM w UNION ALL SELECT id, f + 4, c FROM w UNION ALL SELECT id, f + 8, s FROM w UNION ALL SELECT id, o, q FROM p)"


@query(_AT)
def centre_features(spark, d):
    """Magnitudes, phases and ratios of convolved images, taken at the centres of mass of the maps."""
    out = filters.centre_features(images(spark, d), filters.Bank("gaussian", 2.0, (0.0, 1.0), (0, 1)))
    return out.select("id", F.posexplode("vec").alias("o", "v")).select("id", "o", (F.round("v", 5) + F.lit(0.0)).alias("v"))


_RING = " UNION ALL ".join(
    f"SELECT {s * 2 + af} AS f, dy, dx, CASE WHEN r > 0 THEN exp(-pow(l - ln({radius}), 2) / 0.5) / r * cos({af} * t) ELSE 0 END AS re, CASE WHEN r > 0 THEN exp(-pow(l - ln({radius}), 2) / 0.5) / r * sin({af} * t) ELSE 0 END AS im FROM off" for s, radius in enumerate((1.5, 3.0)) for af in (0, 1)
)


@query(_convolved(_RING, "(VALUES (3), (4))", "(y - 3) * 2 + x - 3"))
def ring_groups(spark, d):
    ring = filters.Bank("ring", 0.5, (0.0,), (0, 1), shifts=(1.5, 3.0))
    return _magnitudes(filters.magnitude_points(images(spark, d), ring, border=3))


_E = "exp(-r * r / 8) / (8 * pi())"
_COMPOSITE = [("CASE WHEN r > 0 THEN exp(-pow(l - ln(2), 2) / 2) ELSE 0 END", f"{af} * t + {rf} * l") for rf, af in ((0, 0), (1, 0), (0, 0), (0, 1))]
_COMPOSITE += [(_E, f"0.5 * (dx * cos({a}) - dy * sin({a}))") for a in (0.0, 1.0)]
_COMPOSITE += [(_E, "CASE WHEN dx <> 0 AND dy <> 0 THEN pi() * 0.5 * sqrt(abs(dx * dy)) / 2 + 2 * pi() * 0.5 * ln(sqrt(abs(CASE WHEN dx <> 0 THEN dx ELSE 1 END / CASE WHEN dy <> 0 THEN dy ELSE 1 END))) / abs(ln(sqrt(4))) ELSE 0 END")]
_COMPOSITE_SQL = " UNION ALL ".join(f"SELECT {k} AS f, dy, dx, {e} * cos({p}) AS re, {e} * sin({p}) AS im FROM off" for k, (e, p) in enumerate(_COMPOSITE))


@query(PX + f", {_OFF}, k AS ({_COMPOSITE_SQL}), z AS (SELECT id, f, sqrt(pow(sum(v * re), 2) + pow(sum(v * im), 2)) AS m FROM px JOIN k ON dy = y - 4 AND dx = x - 4 GROUP BY ALL) SELECT id, f::INT AS f, round(m / sqrt(sum(m * m) OVER (PARTITION BY id)), 5) + 0.0 AS m FROM z")
def composite_bank(spark, d):
    """Polar filters on the axes of frequency, gratings and a hyperbolic filter: magnitudes over length."""
    bank = filters.Composite(filters.Bank("gaussian", 2.0, (0.0, 1.0), (0, 1)), ((0.5, 0.0), (0.5, 1.0)), ((0.5, 0.5),))
    out = filters.composite_features(images(spark, d), bank).select("id", F.posexplode("vec").alias("f", "m"))
    return out.select("id", "f", (F.round("m", 5) + F.lit(0.0)).alias("m"))


@query(PX + ", m AS (SELECT *, v - avg(v) OVER (PARTITION BY i) AS z FROM px), c AS (SELECT a.i, b.i AS j, avg(a.z * b.z) AS c FROM m a JOIN m b ON a.id = b.id GROUP BY 1, 2) SELECT round(sum(CASE WHEN i = j THEN c END), 6) AS trace, round(sum(c * c), 6) AS square, 0.0 AS skew, round(count(DISTINCT i), 6) + 0.0 AS n FROM c")
def pca_train(spark, d):
    """All variances by their sum and sum of squares (the covariance's trace and square), and how far components are from orthogonal."""
    _, rows, values = stats.pca(vectors(spark, d), "v", 64, 64)
    skew = float(np.abs(rows @ rows.T - np.eye(64)).max())
    return spark.createDataFrame([(round(float(values.sum()), 6), round(float((values**2).sum()), 6), round(skew, 6) + 0.0, float(len(rows)))], "trace double, square double, skew double, n double")
