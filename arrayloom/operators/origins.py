"""Where objects begin: origin training rows and prediction; keypoint features; maps grouped by extents; stability of pyramids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import cells, classifiers, stencils


def pixel_vectors(px: DataFrame) -> DataFrame:
    """id, y, x, vec: each pixel's channels over their length (zeros stay), of pixels in long form."""
    p = cells.point_features(px).withColumn("n_", V.norm(F.col("vec")))
    return p.select("id", "y", "x", V.scaled(F.col("vec"), F.col("n_")).alias("vec"))


def origin_rows(px: DataFrame, half: int, stride: int, cols: int, rows: int) -> DataFrame:
    """Training rows for origins: pixels of the centre box with target 1, and beyond it every stride-th with target 0."""
    inside = cells.center_box(F.col("y"), F.col("x"), half, cols, rows)
    taken = px.filter(inside | ((F.col("y") % stride == 0) & (F.col("x") % stride == 0)))
    return pixel_vectors(taken).select("id", "y", "x", inside.cast("int").alias("target"), "vec")


def predicted_origins(px: DataFrame, model: classifiers.Linear) -> DataFrame:
    """id, y, x of the pixels whose predicted label rounds to 1."""
    return classifiers.predicted(pixel_vectors(px), model).filter(F.round("predicted") == 1).select("id", "y", "x")


def symmetry_sum(responses: DataFrame, steps: int) -> DataFrame:
    """id, s, y, x, v: rotation and reflection degrees added, of responses (id, s, y, x, af, re, im, rre, rim) by angular frequency. Responses under 1e-6 count as 0."""
    small = F.hypot("re", "im") < 1e-6
    z = responses.select(F.struct("id", "s", "y", "x").alias("id"), "af", *[F.when(small, 0.0).otherwise(F.col(c)).alias(c) for c in ("re", "im")], "rre", "rim").withColumn("mag", F.hypot("re", "im"))
    degree = lambda r, kind: stencils.symmetry_degrees(stencils.extrema(r, ["id"], "n", "response"), ["id"], "response").select("id", F.col(kind).alias(kind))
    both = degree(stencils.rotation_response(z, steps), "rotation").join(degree(stencils.reflection_response(z, steps), "reflection"), "id", "full")
    every = z.select("id").distinct().join(both, "id", "left")
    return every.select("id.id", "id.s", "id.y", "id.x", (F.coalesce("rotation", F.lit(0.0)) + F.coalesce("reflection", F.lit(0.0))).alias("v"))


def keypoint_features(responses: DataFrame, steps: int, threshold: float, cols: int, rows: int) -> DataFrame:
    """id, s, y, x, vec: magnitudes by angular frequency at the keypoints of the symmetry sum over positions and scales."""
    points = stencils.keypoints(symmetry_sum(responses, steps), threshold, cols, rows).select("id", "s", "y", "x")
    m = responses.join(points, ["id", "s", "y", "x"]).select("id", "s", "y", "x", F.struct("af", F.hypot("re", "im").alias("m")).alias("z"))
    return m.groupBy("id", "s", "y", "x").agg(F.transform(F.sort_array(F.collect_list("z")), lambda z: z["m"]).alias("vec"))


def maps_by_size(maps: DataFrame) -> DataFrame:
    """id, label, channels, rows, cols, data: maps (id, label, map, channels, rows, cols, data) of equal extents joined by channel.

    Those with more channels come first, and of these the later.
    """
    order = F.struct(-F.col("channels"), -F.col("map"), "data")
    joined = F.flatten(F.transform(F.sort_array(F.collect_list(order)), lambda s: s["data"]))
    return maps.groupBy("id", "label", "rows", "cols").agg(F.sum("channels").cast("int").alias("channels"), joined.alias("data")).select("id", "label", "channels", "rows", "cols", "data")


def stability(bands: DataFrame, shifted: DataFrame) -> DataFrame:
    """id, s: how far two pyramids' bands (id, band, rows, cols, data) differ: the root of summed squared differences of their lengths (over pixels), over the number of bands."""
    length = V.norm(F.col("data")) / (F.col("rows") * F.col("cols"))
    both = bands.select("id", "band", length.alias("a")).join(shifted.select("id", "band", length.alias("b")), ["id", "band"], "full")
    gap = F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("the pyramids have different bands"))).otherwise(F.pow(F.col("a") - F.col("b"), F.lit(2)))
    return both.groupBy("id").agg((F.sqrt(F.sum(gap)) / F.count(F.lit(1))).alias("s"))


def weighted_magnitude(w: Column, re: Column, im: Column) -> Column:
    """The magnitude of a group's weighted mean response; 0 where weights are."""
    total = F.sum(w)
    return F.when(total == 0, 0.0).otherwise(F.hypot(F.sum(w * re), F.sum(w * im)) / F.when(total != 0, total))


def xtwx(x: Column, w: Column) -> Column:
    """The quadratic form x' W x of a vector and a matrix (array of rows)."""
    return V.dot(x, F.transform(w, lambda r: V.dot(r, x)))


def crossed(a: Column, b: Column) -> Column:
    """The outer product of two vectors, as rows."""
    return F.transform(a, lambda p: F.transform(b, lambda q: p * q))
