"""Operators on neighbourhoods of pixels and of sequences, in long form."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _rows():
    return W.partitionBy("id", "c", "y").orderBy("x")


def _cols():
    return W.partitionBy("id", "c", "x").orderBy("y")


def difference(v: Column, w) -> Column:
    """The next value less the one before, the border repeated."""
    return F.coalesce(F.lead(v).over(w), v) - F.coalesce(F.lag(v).over(w), v)


def derivatives(df: DataFrame) -> DataFrame:
    """With fx, fy and fxy: central differences over two, for bicubic interpolation."""
    out = df.withColumn("fx", difference(F.col("v"), _rows()) / 2).withColumn("fy", difference(F.col("v"), _cols()) / 2)
    return out.withColumn("fxy", difference(F.col("fx"), _cols()) / 2)


def gradient(df: DataFrame) -> DataFrame:
    """With magnitude and orientation of differences (not halved). The orientation is atan(fy / fx), 0 where both are 0."""
    out = df.withColumn("fx", difference(F.col("v"), _rows())).withColumn("fy", difference(F.col("v"), _cols()))
    up = F.signum("fy") * (math.pi / 2)
    ori = F.when((F.col("fx") == 0) & (F.col("fy") == 0), 0.0).when(F.col("fx") == 0, up).otherwise(F.atan(F.col("fy") / F.when(F.col("fx") != 0, F.col("fx"))))
    return out.withColumn("mag", F.sqrt(F.col("fx") * F.col("fx") + F.col("fy") * F.col("fy"))).withColumn("ori", ori)


def gaussian_weight(y: Column, x: Column, rows: int, cols: int) -> Column:
    """A window about the middle of a patch, of deviation half its longer side."""
    s = 0.5 * max(rows, cols)
    r2 = F.pow(y - (rows - 1) / 2, F.lit(2)) + F.pow(x - (cols - 1) / 2, F.lit(2))
    return F.exp(-r2 / (2 * s * s)) / (2 * math.pi * s * s)


def patches(df: DataFrame, size: int, stride: int, cols: int, rows: int) -> DataFrame:
    """Sliding patches that fit: py, px (their starts) and each pixel's place dy, dx within."""
    margin = lambda n: (n - stride * (n // stride)) // 2
    starts = lambda n: [a for a in range(margin(n), n, stride) if a + size <= n]
    at = lambda n: F.array(*map(F.lit, starts(n)))
    out = df.withColumn("py", F.explode(at(rows))).filter(F.col("y").between(F.col("py"), F.col("py") + size - 1))
    out = out.withColumn("px", F.explode(at(cols))).filter(F.col("x").between(F.col("px"), F.col("px") + size - 1))
    return out.withColumns({"dy": F.col("y") - F.col("py"), "dx": F.col("x") - F.col("px")})


def orientation_bin(ori: Column, bins: int = 8) -> Column:
    """The bin of an orientation, its range being moved to start at 0; capped at the last."""
    return F.greatest(F.lit(0), F.least(F.floor(bins * ori / (2 * math.pi)) + bins // 4, F.lit(bins - 1))).cast("int")


def patch_histograms(grad: DataFrame, size: int, stride: int, cols: int, rows: int, cell: int = 4, bins: int = 8) -> DataFrame:
    """id, c, py, px, vec: histograms of orientation by cell, weighted by magnitude and the window, over length."""
    p = patches(grad, size, stride, cols, rows)
    w = F.col("mag") * gaussian_weight(F.col("dy"), F.col("dx"), size, size)
    k = (F.floor(F.col("dy") / cell) * (size // cell) + F.floor(F.col("dx") / cell)) * bins + orientation_bin(F.col("ori"), bins)
    h = p.groupBy("id", "c", "py", "px", k.cast("int").alias("k")).agg(F.sum(w).alias("s"))
    total = (size // cell) ** 2 * bins
    some = h.groupBy("id", "c", "py", "px").agg(F.map_from_entries(F.collect_list(F.struct("k", "s"))).alias("m"), F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("length"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(total - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return some.select("id", "c", "py", "px", F.transform(filled, lambda s: F.when(F.col("length") == 0, s).otherwise(s / F.col("length"))).alias("vec"))


def clipped_unit(vec: Column, most: float = 0.2) -> Column:
    """A descriptor of unit length with values cut at `most`, and over its length again."""
    cut = F.transform(vec, lambda x: F.least(x, F.lit(most)))
    length = F.sqrt(F.aggregate(cut, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(length == 0, cut).otherwise(F.transform(cut, lambda x: x / length))


def extrema(df: DataFrame, keys: list[str], order: str, v: str) -> DataFrame:
    """Strict local maxima (kind 1) and minima (kind -1) of a sequence; plateaus and ends are none."""
    w = W.partitionBy(*keys).orderBy(order)
    a, b, x = F.lag(v).over(w), F.lead(v).over(w), F.col(v)
    return df.withColumn("kind", F.when((x > a) & (x > b), 1).when((x < a) & (x < b), -1)).filter("kind is not null")


def symmetry_degrees(ext: DataFrame, keys: list[str], v: str) -> DataFrame:
    """From extrema: rotation = sum((max - min_i) / max), reflection = sum((max - y + min) / (max - min)); 0 where undefined."""
    top, low, x = F.col("top"), F.col("low"), F.col(v)
    e = ext.withColumns({"top": F.max(v).over(W.partitionBy(*keys)), "low": F.min(v).over(W.partitionBy(*keys))})
    rotation = F.sum(F.when(F.col("kind") == -1, F.when(top != 0, (top - x) / F.when(top != 0, top)).otherwise(0.0)).otherwise(0.0))
    reflection = F.sum(F.when(F.col("kind") == 1, F.when(top != low, (top - x + low) / F.when(top != low, top - low)).otherwise(0.0)).otherwise(0.0))
    return e.groupBy(*keys).agg(rotation.alias("rotation"), reflection.alias("reflection"))


def keypoints(df: DataFrame, threshold: float, cols: int, rows: int) -> DataFrame:
    """Strict maxima of (id, s, y, x, v) in their 3 x 3 x 3 neighbourhood, over a threshold and off the border.

    Only candidates (over the threshold) are held against their up to 26
    neighbours: an anti-join on exact positions.
    """
    offsets = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0)]
    inner = (F.col("v") > threshold) & F.col("y").between(1, rows - 2) & F.col("x").between(1, cols - 2)
    near = F.array(*[F.struct(*[F.lit(o).alias(n) for o, n in zip(t, ("ds", "dy", "dx"), strict=True)]) for t in offsets])
    cand = df.filter(inner).select("id", "s", "y", "x", "v")
    around = cand.select("*", F.inline(near)).select("id", (F.col("s") + F.col("ds")).alias("s2"), (F.col("y") + F.col("dy")).alias("y2"), (F.col("x") + F.col("dx")).alias("x2"), "s", "y", "x", "v")
    other = df.select("id", F.col("s").alias("s2"), F.col("y").alias("y2"), F.col("x").alias("x2"), F.col("v").alias("v2"))
    beaten = around.join(other, ["id", "s2", "y2", "x2"]).filter("v2 >= v").select("id", "s", "y", "x").distinct()
    return cand.join(beaten, ["id", "s", "y", "x"], "left_anti")


def rotation_response(df: DataFrame, steps: int) -> DataFrame:
    """From (id, af, mag): by id and step n, the sum over af of (1 - cos(af (2 pi n / steps - pi))) times summed magnitude."""
    m = df.groupBy("id", "af").agg(F.sum("mag").alias("m"))
    at = m.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    return at.groupBy("id", "n").agg(F.sum((1 - F.cos(F.col("af") * (2 * math.pi * F.col("n") / steps - math.pi))) * F.col("m")).alias("response"))


def reflection_response(df: DataFrame, steps: int) -> DataFrame:
    """From (id, af, re, im, rre, rim): the sum of |z - exp(-2i af pi n / steps) times the reversed response|."""
    at = df.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    p = -2 * F.col("af") * math.pi * F.col("n") / steps
    re = F.col("re") - (F.cos(p) * F.col("rre") - F.sin(p) * F.col("rim"))
    im = F.col("im") - (F.cos(p) * F.col("rim") + F.sin(p) * F.col("rre"))
    return at.groupBy("id", "n").agg(F.sum(F.sqrt(re * re + im * im)).alias("response"))
