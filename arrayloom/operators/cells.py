"""Labelled dense arrays: a row each (data: array<double>), or a row a value (long form)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.storage import staged


def to_long(df: DataFrame, cols: int, rows: int, data: str = "data", keep: tuple[str, ...] = ("id", "label")) -> DataFrame:
    """One row per value: keep, c, y, x, v, in row-major order of channel, row and column."""
    i = F.col("pos")
    out = df.select(*keep, F.posexplode(F.col(data).cast("array<double>")).alias("pos", "v"))
    size = rows * cols
    return out.select(*keep, F.floor(i / size).cast("int").alias("c"), F.floor(i % size / cols).cast("int").alias("y"), (i % cols).cast("int").alias("x"), "v")


def to_dense(df: DataFrame, keep: tuple[str, ...] = ("id", "label")) -> DataFrame:
    """The inverse of to_long: values in order of channel, row and column, and the extents."""
    cell = F.sort_array(F.collect_list(F.struct("c", "y", "x", "v")))
    extent = [(F.max(a) + 1).alias(n) for a, n in (("c", "channels"), ("y", "rows"), ("x", "cols"))]
    return df.groupBy(*keep).agg(*extent, F.transform(cell, lambda s: s["v"]).alias("data"))


def point_features(df: DataFrame) -> DataFrame:
    """The channel vector at each pixel: id, y, x, vec."""
    return df.groupBy("id", "y", "x").agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "v"))), lambda s: s["v"]).alias("vec"))


def channel_vectors(df: DataFrame) -> DataFrame:
    """One flat pixel vector per channel: id, c, vec."""
    return df.groupBy("id", "c").agg(F.transform(F.sort_array(F.collect_list(F.struct("y", "x", "v"))), lambda s: s["v"]).alias("vec"))


def foreground(df: DataFrame) -> DataFrame:
    """Pixels whose channel sum is positive: a semi-join on their positions."""
    at = df.groupBy("id", "y", "x").agg(F.sum("v").alias("s")).filter("s > 0").select("id", "y", "x")
    return df.join(at, ["id", "y", "x"], "left_semi")


def crop(df: DataFrame, x0: int, y0: int, width: int, height: int, cols: int, rows: int) -> DataFrame:
    """The window that starts at (x0, y0), moved to the origin; an error if it leaves the array."""
    if min(x0, y0) < 0 or x0 + width > cols or y0 + height > rows:
        raise ValueError(f"crop {(x0, y0, width, height)} leaves an array of {cols} x {rows}")
    inside = df.filter(F.col("x").between(x0, x0 + width - 1) & F.col("y").between(y0, y0 + height - 1))
    return inside.withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})


def downsample(df: DataFrame, factor: int, cols: int, rows: int) -> DataFrame:
    """Every factor-th row and column; extents are divided, rounding down."""
    if factor < 1 or cols // factor < 1 or rows // factor < 1:
        raise ValueError("a downsampled array has no pixels")
    x, y = F.col("x"), F.col("y")
    keep = (x % factor == 0) & (y % factor == 0) & (x < cols // factor * factor) & (y < rows // factor * factor)
    return df.filter(keep).withColumns({"x": F.floor(x / factor).cast("int"), "y": F.floor(y / factor).cast("int")})


def pad_offset(have: int, want: int) -> int:
    """Half of what is missing, rounded down; but one, if one is missing. Arrays never shrink."""
    d = max(0, want - have)
    return 1 if d == 1 else d // 2


def grid(df: DataFrame, cols: int, rows: int, keys: list[str]) -> DataFrame:
    """Every pixel position for each distinct key."""
    return df.select(*keys).distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("y")).select("*", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("x"))


def pad(df: DataFrame, width: int, height: int, cols: int, rows: int, value: float = 0.0) -> DataFrame:
    """Centred in at least width x height, the rest being value."""
    w, h = max(width, cols), max(height, rows)
    dx, dy = pad_offset(cols, width), pad_offset(rows, height)
    moved = df.select("id", "label", "c", (F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), "v").filter((F.col("x") < w) & (F.col("y") < h))
    return grid(df, w, h, ["id", "label", "c"]).join(moved, ["id", "label", "c", "y", "x"], "left").withColumn("v", F.coalesce("v", F.lit(value)))


def shift(df: DataFrame, dx: int, dy: int, cols: int, rows: int, value: float = 0.0) -> DataFrame:
    """Moved by (dx, dy) in the same extents; an error if nothing would be left."""
    if abs(dx) >= cols or abs(dy) >= rows:
        raise ValueError("the shift is as large as the array")
    moved = df.select("id", "label", "c", (F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), "v")
    return grid(df, cols, rows, ["id", "label", "c"]).join(moved, ["id", "label", "c", "y", "x"], "left").withColumn("v", F.coalesce("v", F.lit(value)))


def insert_patches(df: DataFrame, patches: DataFrame) -> DataFrame:
    """df with the nonzero pixels of patches (id, c, patch, y, x, v) over it; the last patch wins."""
    last = patches.filter("v <> 0").groupBy("id", "c", "y", "x").agg(F.max_by("v", "patch").alias("p"))
    return df.join(last, ["id", "c", "y", "x"], "left").withColumn("v", F.coalesce("p", "v")).drop("p")


def bounding_box(df: DataFrame) -> DataFrame:
    """The box of nonzero pixels over all channels: id, y0, y1, x0, x1."""
    return df.filter("v <> 0").groupBy("id").agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))


def center_of_mass(df: DataFrame) -> DataFrame:
    """By id: the weighted mean of 1-based positions, rounded half to even; null where weights sum to 0."""
    s = F.sum("v")
    at = lambda a: F.when(s != 0, F.bround(F.sum((F.col(a) + 1) * F.col("v")) / s, 0).cast("int"))
    return df.groupBy("id").agg(at("y").alias("y"), at("x").alias("x"))


def brightest(df: DataFrame) -> DataFrame:
    """By id: the position of the largest channel sum, the first in row-major order on ties."""
    s = df.groupBy("id", "y", "x").agg(F.sum("v").alias("s"))
    return s.groupBy("id").agg(F.min_by(F.struct("y", "x"), F.struct(-F.col("s"), F.col("y"), F.col("x"))).alias("p")).select("id", "p.y", "p.x")


def center_box(y: Column, x: Column, half: int, cols: int, rows: int) -> Column:
    """Whether a position lies within half of the centre."""
    return (F.abs(y - rows // 2) <= half) & (F.abs(x - cols // 2) <= half)


def center_grid(length: int, n: int) -> list[int]:
    """n centres, four apart, about the middle; all positions if n is the length. n must be odd otherwise."""
    if n == length:
        return list(range(n))
    if n % 2 == 0:
        raise ValueError("an even number of centres has no middle")
    return [length // 2 + 4 * k for k in range(-(n // 2), n // 2 + 1)]


def without_outliers(df: DataFrame, keys: list[str]) -> DataFrame:
    """Points (keys, y, x) within three "deviations" of their group's centroid.

    The deviation is the root of summed distances (not squared) over n - 1, as
    the pipelines that use this expect. Groups of one point pass.
    """
    w = W.partitionBy(*keys)
    d = F.sqrt(F.pow(F.col("y") - F.col("my"), F.lit(2)) + F.pow(F.col("x") - F.col("mx"), F.lit(2)))
    out = df.withColumns({"my": F.avg("y").over(w), "mx": F.avg("x").over(w), "n": F.count(F.lit(1)).over(w)}).withColumn("d", d)
    out = out.withColumn("cut", 3 * F.sqrt(F.sum("d").over(w) / F.greatest(F.col("n") - 1, F.lit(1))))
    return out.filter((F.col("n") < 2) | (F.col("d") <= F.col("cut"))).drop("my", "mx", "n", "d", "cut")


def every_nth(df: DataFrame, n: int, order: str, keys: list[str]) -> DataFrame:
    """Rows n, 2n, ... of each group in order."""
    return df.withColumn("rn_", F.row_number().over(W.partitionBy(*keys).orderBy(order))).filter(F.col("rn_") % n == 0).drop("rn_")


def top_k(df: DataFrame, k: int, by: str, tie: str, keys: list[str]) -> DataFrame:
    """The k largest of each group; ties by the smaller tie."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(by), tie))).filter(F.col("rank") <= k)


def after(df: DataFrame, n: int, order: str) -> DataFrame:
    """Rows but the first n in order. The n-th value is found by a top-n of each task, and rows up to it are left out where they stand.

    Rows of equal order are told apart by their hash, as a full sort would by
    chance. Of rows that are equal throughout, as many go as stand within the
    first n: copies of the n-th row are counted, not ranked. Null orders come first.
    """
    key = F.struct(F.col(order).alias("o"), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("h"))
    first = df.select(key.alias("k")).orderBy("k").limit(n)
    last = first.groupBy("k").agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("n", "k").alias("copies"), F.max("k").alias("k"), F.sum("n").alias("n")).first()
    if n <= 0 or not last["n"]:
        return df
    if last["n"] < n:
        return df.filter("false")
    o, h = last["k"]["o"], F.lit(last["k"]["h"])
    bound = F.struct(F.lit(o).cast(df.schema[order].dataType).alias("o"), h.alias("h"))
    here = F.struct(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("h"))
    same = df.filter(F.col(order).eqNullSafe(bound["o"])).select(here.alias("x")).filter(F.col("x.h") == h)
    # Copies beyond those within the first n come out of their count.
    left = same.groupBy("x.h").agg(F.first("x.row").alias("row"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > last["copies"])
    again = left.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") - last["copies"])).alias("i")).select("row.*")
    return df.filter(key > bound).union(again)


def joined_by(df: DataFrame, key: str, order: str, vec: str = "vec") -> DataFrame:
    """key, at, v: the vectors of a key end to end in order, a row for each value.

    A vector's place is the summed lengths of those before it: of earlier ranges
    of the order, then of its own range. So no task holds all of a key.
    """
    rows = df.select(F.col(key).alias("key"), F.col(order).alias("o"), F.col(vec).cast("array<double>").alias("x"))
    ranged = staged(rows.repartitionByRange("key", "o").withColumn("part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("key", "part").agg(F.sum(F.size("x")).alias("n"))
    earlier = F.coalesce(F.sum("n").over(W.partitionBy("key").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col("key").alias("key_"), F.col("part").alias("part_"), earlier.alias("before"))
    within = F.coalesce(F.sum(F.size("x")).over(W.partitionBy("key", "part").orderBy("o").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.withColumn("within", within).join(sizes, F.col("key").eqNullSafe(F.col("key_")) & (F.col("part") == F.col("part_")))
    return placed.select(F.col("key").alias(key), (F.col("before") + F.col("within")).alias("start"), F.posexplode("x").alias("i", "v")).select(key, (F.col("start") + F.col("i")).alias("at"), "v")
