"""Queries: neighbourhoods, Fourier transforms, kernels and filter banks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fourier, kernels, stencils
from .registry import EM, PX, pixels, query, r6, table, vectors

_W = "WINDOW r AS (PARTITION BY id, y ORDER BY x), c AS (PARTITION BY id, x ORDER BY y)"
_DX, _DY = (f"(coalesce(lead({{v}}) OVER {w}, {{v}}) - coalesce(lag({{v}}) OVER {w}, {{v}}))" for w in "rc")


@query(PX + f", a AS (SELECT *, {_DX.format(v='v')} / 2 AS fx, {_DY.format(v='v')} / 2 AS fy FROM px {_W}) SELECT id, y, x, round(fx, 6) AS fx, round(fy, 6) AS fy, round({_DY.format(v='fx')} / 2, 6) AS fxy FROM a WINDOW c AS (PARTITION BY id, x ORDER BY y)")
def derivatives(spark, d):
    return stencils.derivatives(pixels(spark, d)).select("id", "y", "x", r6("fx").alias("fx"), r6("fy").alias("fy"), r6("fxy").alias("fxy"))


_GRAD = PX + f", g AS (SELECT id, y, x, {_DX.format(v='v')} AS fx, {_DY.format(v='v')} AS fy FROM px {_W}), m AS (SELECT *, sqrt(fx * fx + fy * fy) AS mag, CASE WHEN fx = 0 AND fy = 0 THEN 0 WHEN fx = 0 THEN sign(fy) * pi() / 2 ELSE atan(fy / fx) END AS ori FROM g)"


@query(_GRAD + " SELECT id, y, x, round(mag, 6) AS mag, round(ori, 6) AS ori FROM m")
def gradient(spark, d):
    return stencils.gradient(pixels(spark, d)).select("id", "y", "x", r6("mag").alias("mag"), r6("ori").alias("ori"))


_GW = "exp(-(pow(y % 4 - 1.5, 2) + pow(x % 4 - 1.5, 2)) / 8) / (8 * pi())"


@query(_GRAD + f", h AS (SELECT id, (y // 4 * 4)::INT AS py, (x // 4 * 4)::INT AS px, greatest(0, least(floor(4 * ori / pi())::INT + 2, 7)) AS k, sum(mag * {_GW}) AS s FROM m GROUP BY ALL), n AS (SELECT *, sqrt(sum(s * s) OVER (PARTITION BY id, py, px)) AS l FROM h) SELECT id, py, px, k, round(s / l, 6) AS s FROM n WHERE round(s / l, 6) <> 0")
def orientation_histograms(spark, d):
    h = stencils.patch_histograms(stencils.gradient(pixels(spark, d)), 4, 4, 8, 8)
    return h.select("id", "py", "px", F.posexplode("vec").alias("k", "s")).select("id", "py", "px", "k", r6("s").alias("s")).filter("s <> 0")


@query(PX + f"SELECT id, y, x, round(v * exp(-(pow(y - 3.5, 2) + pow(x - 3.5, 2)) / 32) / (32 * pi()), 8) AS v FROM px")
def gaussian_window(spark, d):
    return pixels(spark, d).select("id", "y", "x", F.round(F.col("v") * stencils.gaussian_weight(F.col("y"), F.col("x"), 8, 8), 8).alias("v"))


_EXT = "WITH e AS (SELECT user_id, event_id, value, lag(value) OVER w AS a, lead(value) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), x AS (SELECT *, CASE WHEN value > a AND value > b THEN 1 WHEN value < a AND value < b THEN -1 END AS kind FROM e)"


@query(_EXT + " SELECT user_id, event_id, kind FROM x WHERE kind IS NOT NULL")
def local_extrema(spark, d):
    return stencils.extrema(table(spark, d, "events"), ["user_id"], "event_id", "value").select("user_id", "event_id", "kind")


@query(_EXT + ", y AS (SELECT *, max(value) OVER (PARTITION BY user_id) AS t, min(value) OVER (PARTITION BY user_id) AS l FROM x WHERE kind IS NOT NULL) SELECT user_id, round(sum(CASE WHEN kind = -1 AND t <> 0 THEN (t - value) / t ELSE 0 END), 6) AS rotation, round(sum(CASE WHEN kind = 1 AND t <> l THEN (t - value + l) / (t - l) ELSE 0 END), 5) AS reflection FROM y GROUP BY 1")
def symmetry_degrees(spark, d):
    e = stencils.extrema(table(spark, d, "events"), ["user_id"], "event_id", "value")
    return stencils.symmetry_degrees(e, ["user_id"], "value").select("user_id", r6("rotation").alias("rotation"), F.round("reflection", 5).alias("reflection"))


@query(PX + ", s AS (SELECT id // 5 AS g, id % 5 AS s, y, x, v FROM px) SELECT a.g AS id, a.s, a.y, a.x FROM s a WHERE a.v > 0.1 AND a.y BETWEEN 1 AND 6 AND a.x BETWEEN 1 AND 6 AND NOT EXISTS (SELECT 1 FROM s b WHERE b.g = a.g AND abs(b.s - a.s) <= 1 AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 AND NOT (b.s = a.s AND b.y = a.y AND b.x = a.x) AND b.v >= a.v)")
def scale_keypoints(spark, d):
    """Groups of five images stand for scales."""
    df = pixels(spark, d).select(F.floor(F.col("id") / 5).alias("id"), (F.col("id") % 5).alias("s"), "y", "x", "v")
    return stencils.keypoints(df, 0.1, 8, 8).select("id", "s", "y", "x")


@query(PX + ", m AS (SELECT id, y AS af, sum(abs(v)) AS m FROM px GROUP BY 1, 2) SELECT id, n::INT AS n, round(sum((1 - cos(af * (2 * pi() * n / 12 - pi()))) * m), 5) AS response FROM m, range(0, 12) t(n) GROUP BY 1, 2")
def rotation_symmetry(spark, d):
    df = pixels(spark, d).select("id", F.col("y").alias("af"), F.abs("v").alias("mag"))
    return stencils.rotation_response(df, 12).select("id", "n", F.round("response", 5).alias("response"))


@query(PX + ", z AS (SELECT a.id, a.y AS af, a.x, a.v AS re, b.v AS rre FROM px a JOIN px b ON a.id = b.id AND a.y = b.y AND b.x = 7 - a.x), p AS (SELECT *, n, -2 * af * pi() * n / 12 AS p FROM z, range(0, 12) t(n)) SELECT id, n::INT AS n, round(sum(sqrt(pow(re - cos(p) * rre, 2) + pow(sin(p) * rre, 2))), 5) AS response FROM p GROUP BY 1, 2")
def reflection_symmetry(spark, d):
    px = pixels(spark, d)
    back = px.select("id", "y", (7 - F.col("x")).alias("x"), F.col("v").alias("rre"))
    df = px.join(back, ["id", "y", "x"]).select("id", F.col("y").alias("af"), F.col("v").alias("re"), F.lit(0.0).alias("im"), "rre", F.lit(0.0).alias("rim"))
    return stencils.reflection_response(df, 12).select("id", "n", F.round("response", 5).alias("response"))


def _complex(spark, d):
    return pixels(spark, d).select("id", "c", "y", "x", F.col("v").alias("re"), F.lit(0.0).alias("im"))


_DFT = PX + ", f AS (SELECT id, ky::INT AS ky, kx::INT AS kx, sum(v * cos(2 * pi() * (ky * y + kx * x) / 8)) AS re, -sum(v * sin(2 * pi() * (ky * y + kx * x) / 8)) AS im FROM px, range(0, 8) a(ky), range(0, 8) b(kx) GROUP BY ALL)"


@query(_DFT + " SELECT id, ky, kx, round(re, 5) + 0.0 AS re, round(im, 5) + 0.0 AS im FROM f")
def dft_2d(spark, d):
    return fourier.dft2(_complex(spark, d), 8, 8).select("id", "ky", "kx", (F.round("re", 5) + F.lit(0.0)).alias("re"), (F.round("im", 5) + F.lit(0.0)).alias("im"))


@query(PX + "SELECT id, y, x, round(v, 5) + 0.0 AS v FROM px")
def dft_round_trip(spark, d):
    f = fourier.dft2(_complex(spark, d), 8, 8).withColumnsRenamed({"ky": "y", "kx": "x"})
    back = fourier.dft2(f, 8, 8, inverse=True)
    return back.select("id", F.col("ky").alias("y"), F.col("kx").alias("x"), (F.round("re", 5) + F.lit(0.0)).alias("v"))


@query(_DFT + " SELECT id, ky, kx, round(re, 5) + 0.0 AS re, round(im, 5) + 0.0 AS im FROM f")
def fft_2d(spark, d):
    """The same through numpy in Arrow batches."""
    df = pixels(spark, d).groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("y", "x", "v"))), lambda s: s["v"]).alias("re"))
    f = fourier.transformed(df.withColumn("im", F.transform("re", lambda x: F.lit(0.0))), (8, 8), (0, 1))
    both = f.select("id", F.posexplode(F.arrays_zip("re", "im")).alias("i", "z"))
    z = lambda c: (F.round(F.col(f"z.{c}"), 5) + F.lit(0.0)).alias(c)
    return both.select("id", F.floor(F.col("i") / 8).cast("int").alias("ky"), (F.col("i") % 8).cast("int").alias("kx"), z("re"), z("im"))


@query(PX + ", k AS (SELECT * FROM (VALUES (0, 0, 0.5), (0, 1, 0.25), (7, 0, 0.125), (1, 7, -0.3)) t(ky, kx, w)) SELECT id, ((y + ky) % 8)::INT AS y, ((x + kx) % 8)::INT AS x, round(sum(v * w), 5) + 0.0 AS v FROM px, k GROUP BY ALL")
def convolution(spark, d):
    """Circular convolution with a small kernel, through the spectrum."""
    taps = {(0, 0): 0.5, (0, 1): 0.25, (7, 0): 0.125, (1, 7): -0.3}
    k = spark.createDataFrame([(y, x, taps.get((y, x), 0.0), 0.0) for y in range(8) for x in range(8)], "y int, x int, re double, im double")
    return fourier.convolve(_complex(spark, d), k, 8, 8).select("id", "y", "x", (F.round("re", 5) + F.lit(0.0)).alias("v"))


@query(PX + "SELECT id, y, x, round(v * CASE WHEN (x + y) % 2 = 0 THEN 1 ELSE -1 END, 6) + 0.0 AS re FROM px")
def frequency_centre(spark, d):
    return fourier.centred(_complex(spark, d)).select("id", "y", "x", r6("re").alias("re"))


#: DuckDB: pixels with their offsets from the middle, as x and y, length d and angle t.
_G = PX + ", g AS (SELECT id, v, (y - 4)::DOUBLE AS y, (x - 4)::DOUBLE AS x, sqrt(pow(y - 4, 2) + pow(x - 4, 2)) AS d, CASE WHEN y = 4 AND x = 4 THEN 0 WHEN atan2(y - 4, x - 4) < 0 THEN atan2(y - 4, x - 4) + 2 * pi() ELSE atan2(y - 4, x - 4) END AS t FROM px) "


def _kernel(spark, d, k):
    """The response of every image to a kernel about its middle."""
    filters = kernels.bank(kernels.grid(spark, 8, 8), {0: k(F.col("x"), F.col("y"))})
    return kernels.apply_bank(pixels(spark, d), filters).select("id", (F.round("re", 5) + F.lit(0.0)).alias("re"), (F.round("im", 5) + F.lit(0.0)).alias("im"))


def _real(f):
    return lambda x, y: (f(x, y), F.lit(0.0))


def _sql(re: str, im: str = "0.0") -> str:
    return _G + f"SELECT id, round(sum(v * ({re})::DOUBLE), 5) + 0.0 AS re, round(sum(v * ({im})::DOUBLE), 5) + 0.0 AS im FROM g GROUP BY id"


@query(_sql("exp(-x * x / 18) / (sqrt(2 * pi()) * 3)"))
def kernel_gaussian_1d(spark, d):
    return _kernel(spark, d, _real(lambda x, y: kernels.gaussian_1d(3.0, x)))


@query(_sql("exp(-d * d / 18) / (18 * pi())"))
def kernel_gaussian_2d(spark, d):
    return _kernel(spark, d, _real(lambda x, y: kernels.gaussian_2d(3.0, x, y)))


@query(_sql("exp(-pow(d - 12 * (2 - exp(-0.3)) / pi(), 2) / 8) / (8 * pi())"))
def kernel_gaussian_ring(spark, d):
    return _kernel(spark, d, _real(lambda x, y: kernels.gaussian_ring(3, 2.0, x, y)))


@query(_sql("cos(0.5 * (x * cos(0.3) - y * sin(0.3)))", "sin(0.5 * (x * cos(0.3) - y * sin(0.3)))"))
def kernel_grating(spark, d):
    return _kernel(spark, d, lambda x, y: kernels.grating(0.5, 0.3, x, y))


@query(_sql("exp(-d * d / 18) * cos(-2 * pi() * 0.1 * (x * cos(0.7) + y * sin(0.7)))", "exp(-d * d / 18) * sin(-2 * pi() * 0.1 * (x * cos(0.7) + y * sin(0.7)))"))
def kernel_gabor(spark, d):
    return _kernel(spark, d, lambda x, y: kernels.gabor(3.0, 0.1, 0.7, x, y))


_FM = "CASE WHEN d > 0 AND d > 4 / pi() THEN pow(d, -0.5) * {f}(-1.5 * ln(CASE WHEN d > 0 THEN d ELSE 1 END) - 2 * t) ELSE 0 END"


@query(_sql(_FM.format(f="cos"), _FM.format(f="sin")))
def kernel_fourier_mellin(spark, d):
    return _kernel(spark, d, lambda x, y: kernels.fourier_mellin(1.5, 2, -0.5, x, y))


_PW = "CASE WHEN d > 0 THEN exp(-pow(ln(d) - ln(3), 2) / 2) * {f}(2 * t + 1.5 * ln(d)) ELSE 0 END"


@query(_sql(_PW.format(f="cos"), _PW.format(f="sin")).replace("ln(d)", "ln(CASE WHEN d > 0 THEN d ELSE 1 END)"))
def kernel_pinwheel(spark, d):
    return _kernel(spark, d, lambda x, y: kernels.gaussian_pinwheel(3.0, 1.5, 2, x, y))


_IG = "exp(-d * d / 32) / (32 * pi()) * (exp(-d * d / 32) / (32 * pi()) - exp(-d * d / 8) / (8 * pi()) - (1 / (32 * pi()) - 1 / (8 * pi()))) * CASE WHEN d > 0 THEN {f}(2 * t + 1.5 * ln(CASE WHEN d > 0 THEN d ELSE 1 END)) ELSE 0 END * 1"


@query(_sql(_IG.format(f="cos"), _IG.format(f="sin")))
def kernel_inverse_gaussian(spark, d):
    return _kernel(spark, d, lambda x, y: kernels.inverse_gaussian_pinwheel(4.0, 2.0, 1.5, 2, x, y))


_RING = "CASE WHEN d > 0 THEN exp(-pow(ln(CASE WHEN d > 0 THEN d ELSE 1 END) - ln(4), 2) / 0.5) / d * {f}(3 * t + 2 * (ln(CASE WHEN d > 0 THEN d ELSE 1 END) - ln(4))) ELSE 0 END"


@query(_sql(_RING.format(f="cos"), _RING.format(f="sin")))
def kernel_ring(spark, d):
    return _kernel(spark, d, lambda x, y: kernels.pinwheel_ring(0.5, 4.0, 2.0, 3, x, y))


_FAN = "CASE WHEN d > 0 THEN exp(-pow((t - 1 - 2 * pi() * floor((t - 1 + pi()) / (2 * pi()))) / 0.6, 2) / 2) * {f}(3 * (t - 1 - 2 * pi() * floor((t - 1 + pi()) / (2 * pi()))) + 2 * ln(CASE WHEN d > 0 THEN d ELSE 1 END)) ELSE 0 END"


@query(_sql(_FAN.format(f="cos"), _FAN.format(f="sin")))
def kernel_fan(spark, d):
    return _kernel(spark, d, lambda x, y: kernels.pinwheel_fan(0.6, 1.0, 2.0, 3, x, y))


_P, _Q = "(x * cos(0.4) - y * sin(0.4))", "(x * sin(0.4) + y * cos(0.4))"
_HY = f"CASE WHEN d = 0 THEN {{at0}} ELSE exp(-d * d / 18) / (18 * pi()) * {{f}}(pi() * 0.5 * sqrt(abs({_P} * {_Q})) / 3 + 2 * pi() * 0.7 * ln(sqrt(abs({_P} / {_Q}))) / abs(ln(sqrt(6)))) END"


@query(_sql(_HY.format(f="cos", at0="1 / (18 * pi())"), _HY.format(f="sin", at0="0")))
def kernel_hyperbolic(spark, d):
    return _kernel(spark, d, lambda x, y: kernels.hyperbolic(3.0, 0.7, 0.5, 0.4, x, y))


@query(_sql("CASE WHEN d > 0 THEN exp(-0.5 * pow((log2(CASE WHEN d > 0 THEN d ELSE 1 END) - 2) / (0.996 * sqrt(2 / 3)), 2)) ELSE 0 END"))
def kernel_log_gabor(spark, d):
    return _kernel(spark, d, _real(lambda x, y: kernels.log_gabor(F.sqrt((x * x + y * y).cast("double")), 2.0)))


_WIN = EM + "SELECT id, i, round(CASE WHEN x <= pi() / 4 THEN 0 WHEN x >= pi() / 2 THEN 1 ELSE cos(pi() / 2 * log2(2 * x / pi())) END, 6) + 0.0 AS h1, round(CASE WHEN x <= pi() / 4 THEN 2 WHEN x >= pi() / 2 THEN 0 ELSE 2 * cos(pi() / 2 * log2(4 * x / pi())) END, 6) + 0.0 AS l1, round(CASE WHEN abs(x - pi() / 4) <= pi() / 2 THEN 48 / sqrt(4 * 720) * pow(cos(x - pi() / 4), 3) ELSE 0 END, 6) + 0.0 AS g1 FROM (SELECT id, (generate_subscripts(v, 1) - 1)::INT AS i, abs(unnest(v)) * 6 AS x FROM e)"


@query(_WIN)
def pyramid_windows(spark, d):
    """The windows at frequencies that the vectors' values name."""
    x = F.col("x")
    w = vectors(spark, d).select("id", F.posexplode("v").alias("i", "x")).withColumn("x", F.abs("x") * 6)
    return w.select("id", "i", r6(kernels.band_pass(x)).alias("h1"), r6(kernels.low_pass(x)).alias("l1"), r6(kernels.angular_window(1, 4, x)).alias("g1"))


@query(EM + "SELECT id, round(sum(x * 2 * pi() * CASE WHEN i > 32 THEN i - 64 ELSE i END / 64), 5) + 0.0 AS w, round(sum(x * abs(2 * pi() * CASE WHEN i > 32 THEN i - 64 ELSE i END / 64)), 5) + 0.0 AS a FROM (SELECT id, (generate_subscripts(v, 1) - 1)::INT AS i, unnest(v) AS x FROM e) GROUP BY id")
def frequency_map(spark, d):
    """Vectors weighted by the frequencies that their elements stand for, with sign and without."""
    i = F.col("i")
    x = vectors(spark, d).select("id", F.posexplode("v").alias("i", "x"))
    total = lambda signed: F.round(F.sum(F.col("x") * kernels.folded_frequency(i, 64, signed)), 5) + F.lit(0.0)
    return x.groupBy("id").agg(total(True).alias("w"), total(False).alias("a"))


_GB = "exp(-(pow(y - 4, 2) + pow(x - 4, 2)) / 8)"
_BANK = ", ".join(f"sum(v * {_GB} * cos(-2 * pi() * {f} * ((x - 4) * cos({t}) + (y - 4) * sin({t})))) AS re{k}, sum(v * {_GB} * sin(-2 * pi() * {f} * ((x - 4) * cos({t}) + (y - 4) * sin({t})))) AS im{k}" for k, (f, t) in enumerate(((0.1, 0.0), (0.2, 0.5))))


@query(PX + f", b AS (SELECT id, {_BANK} FROM px GROUP BY id) SELECT id, 0 AS f, round(re0, 5) + 0.0 AS re, round(im0, 5) + 0.0 AS im FROM b UNION ALL SELECT id, 1, round(re1, 5) + 0.0, round(im1, 5) + 0.0 FROM b")
def bank_inner_product(spark, d):
    x, y = F.col("x"), F.col("y")
    filters = kernels.bank(kernels.grid(spark, 8, 8), {0: kernels.gabor(2.0, 0.1, 0.0, x, y), 1: kernels.gabor(2.0, 0.2, 0.5, x, y)})
    out = kernels.apply_bank(pixels(spark, d), filters)
    return out.select("id", "f", (F.round("re", 5) + F.lit(0.0)).alias("re"), (F.round("im", 5) + F.lit(0.0)).alias("im"))
