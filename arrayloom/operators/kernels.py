"""Filter kernels as Column expressions of integer offsets, and their application.

A kernel takes the offsets x and y of a grid table and gives (re, im). Grids are
bounded by the filters' extents, so a bank is a small table that is broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import angle, cis, times

Complex = tuple[Column, Column]
NONE = lambda: F.lit(0.0)


def grid(spark: SparkSession, rows: int, cols: int, order: str = "centred") -> DataFrame:
    """r, q (indices) and y, x (offsets): from the centre; periodic, the least in size; or in FFT order."""
    axis = lambda name, n: spark.range(n).select(F.col("id").cast("int").alias(name))
    table = axis("r", rows).join(axis("q", cols), F.lit(True))  # bounded by the filter's extent

    def offset(i: Column, n: int) -> Column:
        if order == "centred":
            return i - n // 2
        if order == "fft":
            return F.when(i >= n // 2, i - n).otherwise(i) if n % 2 == 0 else F.when(i > n // 2, i - n).otherwise(i)
        o = i - n // 2
        return F.when(F.abs(o - n) < F.abs(o), o - n).when(F.abs(o + n) < F.abs(o), o + n).otherwise(o)

    if order not in ("centred", "fft", "periodic"):
        raise ValueError(order)
    return table.withColumns({"y": offset(F.col("r"), rows), "x": offset(F.col("q"), cols)})


def _r2(x: Column, y: Column) -> Column:
    return (x * x + y * y).cast("double")


def gaussian_1d(s: float, i: Column) -> Column:
    return F.exp(-(i * i) / (2 * s * s)) / (math.sqrt(2 * math.pi) * s)


def gaussian_2d(s: float, x: Column, y: Column) -> Column:
    return F.exp(-_r2(x, y) / (2 * s * s)) / (2 * math.pi * s * s)


def gaussian_ring(af: int, s: float, x: Column, y: Column) -> Column:
    """A Gaussian on the distance from a circle that grows with the angular frequency; the plain one at 0."""
    if af == 0:
        return gaussian_2d(s, x, y)
    r0 = 6 * s * (2 - math.exp(-af / 10)) / math.pi
    d = F.sqrt(_r2(x, y)) - r0
    return F.exp(-(d * d) / (2 * s * s)) / (2 * math.pi * s * s)


def grating(f: float, theta: float, x: Column, y: Column) -> Complex:
    return cis(f * (x * math.cos(theta) - y * math.sin(theta)))


def gabor(s: float, f: float, theta: float, x: Column, y: Column) -> Complex:
    u = x * math.cos(theta) + y * math.sin(theta)
    e = F.exp(-_r2(x, y) / (2 * s * s))
    c = cis(-2 * math.pi * f * u)
    return e * c[0], e * c[1]


def fourier_mellin(rf: float, af: int, alpha: float, x: Column, y: Column) -> Complex:
    """r^(alpha - i rf) e^(-i af theta); 0 within 2 |af| / pi of the origin."""
    r = F.sqrt(_r2(x, y))
    some = (r > 0) & (r > 2 / math.pi * abs(af))
    c = cis(-rf * F.log(F.when(r > 0, r)) - af * angle(x, y))
    size = F.pow(r, F.lit(float(alpha)))
    return F.when(some, size * c[0]).otherwise(0.0), F.when(some, size * c[1]).otherwise(0.0)


def gaussian_pinwheel(s: float, rf: float, af: int, x: Column, y: Column) -> Complex:
    """A log-Gaussian of the radius about s, with angular and log-radial waves; 0 at the origin."""
    r = F.sqrt(_r2(x, y))
    ln = F.log(F.when(r > 0, r))
    e = F.exp(-F.pow(ln - math.log(s), F.lit(2)) / 2)
    c = cis(af * angle(x, y) + rf * ln)
    return F.coalesce(e * c[0], NONE()), F.coalesce(e * c[1], NONE())


def inverse_gaussian_pinwheel(outer: float, inner: float, rf: float, af: int, x: Column, y: Column) -> Complex:
    """A Gaussian without its middle, with angular and log-radial waves. inner 0 keeps the middle."""
    if outer < inner:
        raise ValueError("the outer scale is less than the inner")
    r = F.sqrt(_r2(x, y))
    e = gaussian_2d(outer, x, y)
    if inner:
        at0 = 1 / (2 * math.pi * outer * outer) - 1 / (2 * math.pi * inner * inner)
        e = e * (gaussian_2d(outer, x, y) - gaussian_2d(inner, x, y) - at0)
    wave = cis(af * angle(x, y) + rf * F.log(F.when(r > 0, r)))
    alone = 1.0 if af == 0 and rf == 0 else 0.0
    return e * F.coalesce(wave[0], F.lit(alone)), e * F.coalesce(wave[1], NONE())


def pinwheel_ring(s: float, r0: float, rf: float, af: int, x: Column, y: Column) -> Complex:
    """A Gaussian of log radius about r0, over the radius, with waves."""
    r = F.sqrt(_r2(x, y))
    ln = F.log(F.when(r > 0, r))
    d = ln - math.log(r0)
    e = F.exp(-(d * d) / (2 * s * s)) / F.when(r > 0, r)
    c = cis(af * angle(x, y) + rf * d)
    return F.coalesce(e * c[0], NONE()), F.coalesce(e * c[1], NONE())


def pinwheel_fan(s: float, shift: float, rf: float, af: int, x: Column, y: Column) -> Complex:
    """A Gaussian of the angle about shift, wrapped to -pi..pi, with waves."""
    r = F.sqrt(_r2(x, y))
    d = angle(x, y) - shift
    d = d - 2 * math.pi * F.floor((d + math.pi) / (2 * math.pi))
    e = F.exp(-F.pow(d / s, F.lit(2)) / 2)
    c = times(cis(af * d), cis(rf * F.log(F.when(r > 0, r))))
    return F.coalesce(e * c[0], NONE()), F.coalesce(e * c[1], NONE())


def hyperbolic(s: float, uf: float, vf: float, theta: float, x: Column, y: Column) -> Complex:
    """A Gaussian with waves in hyperbolic coordinates u = ln root |x'/y'|, v = root |x'y'|; plain on the axes."""
    p = x * math.cos(theta) - y * math.sin(theta)
    q = x * math.sin(theta) + y * math.cos(theta)
    off = (F.abs(p) > 1e-9) & (F.abs(q) > 1e-9)
    u = F.log(F.sqrt(F.abs(F.when(off, p) / F.when(off, q))))
    v = F.sqrt(F.abs(p * q))
    e = F.exp(-_r2(x, y) / (2 * s * s)) / (2 * math.pi * s * s)
    c = cis(math.pi * vf * v / s + 2 * math.pi * uf * u / abs(math.log(math.sqrt(2 * s))))
    return F.when(off, e * c[0]).otherwise(e), F.when(off, e * c[1]).otherwise(0.0)


def log_gabor(r: Column, center: float) -> Column:
    """exp(-((log2 r - center) / sigma)^2 / 2), sigma = .996 root(2/3); 0 at r = 0."""
    s = 0.996 * math.sqrt(2 / 3)
    return F.when(r > 0, F.exp(-0.5 * F.pow((F.log2(F.when(r > 0, r)) - center) / s, F.lit(2)))).otherwise(0.0)


def band_pass(x: Column) -> Column:
    """The radial window h1: 0 below pi/4, 1 above pi/2, a cosine of the logarithm between."""
    return F.when(x <= math.pi / 4, 0.0).when(x >= math.pi / 2, 1.0).otherwise(F.cos(math.pi / 2 * F.log2(2 * F.when(x > 0, x) / math.pi)))


def low_pass(x: Column, as_written: bool = False) -> Column:
    """The radial window l1: 2 below pi/4, 0 above pi/2, a cosine between; as_written keeps the literal precedence 2 cos(.5) pi log."""
    lg = F.log2(4 * F.when(x > 0, x) / math.pi)
    ramp = 2 * math.cos(0.5) * math.pi * lg if as_written else 2 * F.cos(math.pi / 2 * lg)
    return F.when(x <= math.pi / 4, 2.0).when(x >= math.pi / 2, 0.0).otherwise(ramp)


def angular_window(k: int, n: int, theta: Column) -> Column:
    """alpha cos^(n-1)(theta - pi k / n) within a right angle of its middle, else 0."""
    alpha = 2 ** (n - 1) * math.factorial(n - 1) / math.sqrt(n * math.factorial(2 * (n - 1)))
    d = theta - math.pi * k / n
    d = d - 2 * math.pi * F.floor((d + math.pi) / (2 * math.pi))
    return F.when(F.abs(d) <= math.pi / 2, alpha * F.pow(F.cos(d), F.lit(float(n - 1)))).otherwise(0.0)


def folded_frequency(i: Column, n: int, signed: bool = False) -> Column:
    """2 pi i / n, folded into -pi..pi; its size unless signed."""
    w = 2 * math.pi * F.when(i > n // 2, i - n).otherwise(i) / n
    return w if signed else F.abs(w)


def bank(table: DataFrame, kernels: dict[int, Complex]) -> DataFrame:
    """(f, r, q, re, im): the kernels of a grid as rows."""
    each = F.array(*[F.struct(F.lit(f).alias("f"), k[0].cast("double").alias("re"), k[1].cast("double").alias("im")) for f, k in kernels.items()])
    return table.select("r", "q", F.inline(each))


def apply_bank(df: DataFrame, filters: DataFrame) -> DataFrame:
    """(id, c, f, re, im): inner products of (id, c, y, x, v) with each filter of a broadcast bank."""
    return df.join(F.broadcast(filters), (F.col("y") == F.col("r")) & (F.col("x") == F.col("q"))).groupBy("id", "c", "f").agg(F.sum(F.col("v") * F.col("re")).alias("re"), F.sum(F.col("v") * F.col("im")).alias("im"))
