"""Queries: scans, projections, geometry and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import cells
from .registry import EM, PX, pixels, query, r6, table, vectors


@query(PX + "SELECT id, label, 0 AS c, y, x, round(v, 6) AS v FROM px")
def scan_long(spark, d):
    return pixels(spark, d).withColumn("v", r6("v"))


@query(EM + "SELECT id, label, 1 AS channels, 8 AS rows, 8 AS cols, round(list_sum(v), 5) AS s, round(v[9], 6) AS v9 FROM e")
def dense_round_trip(spark, d):
    dense = cells.to_dense(pixels(spark, d))
    return dense.select("id", "label", "channels", "rows", "cols", F.round(V.total(F.col("data")), 5).alias("s"), r6(F.get("data", F.lit(8))).alias("v9"))


@query(PX + "SELECT id, (x - 2)::INT AS x, (y - 1)::INT AS y, round(v, 6) AS v FROM px WHERE x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 6")
def crop(spark, d):
    return cells.crop(pixels(spark, d), 2, 1, 4, 6, 8, 8).select("id", "x", "y", r6("v").alias("v"))


@query(PX + "SELECT id, (x // 3)::INT AS x, (y // 3)::INT AS y, round(v, 6) AS v FROM px WHERE x % 3 = 0 AND y % 3 = 0 AND x // 3 < 2 AND y // 3 < 2")
def downsample(spark, d):
    return cells.downsample(pixels(spark, d), 3, 8, 8).select("id", "x", "y", r6("v").alias("v"))


@query(PX + ", g AS (SELECT id, gx::INT AS x, gy::INT AS y FROM (SELECT DISTINCT id FROM px), range(0, 13) a(gx), range(0, 9) b(gy)) SELECT g.id, g.x, g.y, round(coalesce(v, 0), 6) AS v FROM g LEFT JOIN px ON g.id = px.id AND g.x = px.x + 2 AND g.y = px.y + 1")
def pad(spark, d):
    return cells.pad(pixels(spark, d), 13, 9, 8, 8).filter("x < 13 and y < 9").select("id", "x", "y", r6("v").alias("v"))


@query(PX + "SELECT a.id, a.x, a.y, round(coalesce(b.v, 9), 6) AS v FROM px a LEFT JOIN px b ON a.id = b.id AND a.x = b.x + 2 AND a.y = b.y - 3")
def shift(spark, d):
    return cells.shift(pixels(spark, d), 2, -3, 8, 8, 9.0).select("id", "x", "y", r6("v").alias("v"))


@query(PX + "SELECT id, x, y, round(CASE WHEN x BETWEEN 2 AND 3 AND y BETWEEN 4 AND 5 AND NOT (x = 2 AND y = 4) THEN CASE WHEN x = 3 AND y = 5 THEN 0.5 ELSE x * 10.0 + y END ELSE v END, 6) AS v FROM px")
def insert_patches(spark, d):
    px = pixels(spark, d)
    two = px.filter("x between 2 and 3 and y between 4 and 5").select("id", "c", F.lit(0).alias("patch"), "y", "x", F.when((F.col("x") == 2) & (F.col("y") == 4), 0.0).otherwise(F.col("x") * 10.0 + F.col("y")).alias("v"))
    last = px.filter("x = 3 and y = 5").select("id", "c", F.lit(1).alias("patch"), "y", "x", F.lit(0.5).alias("v"))
    return cells.insert_patches(px, two.union(last)).select("id", "x", "y", r6("v").alias("v"))


@query(PX + "SELECT id, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM px WHERE v > 0.15 GROUP BY id")
def bounding_box(spark, d):
    return cells.bounding_box(pixels(spark, d).withColumn("v", F.when(F.col("v") > 0.15, F.col("v")).otherwise(0.0)))


@query(PX + "SELECT id, round_even(sum((y + 1) * abs(v)) / sum(abs(v)), 0)::INT AS y, round_even(sum((x + 1) * abs(v)) / sum(abs(v)), 0)::INT AS x FROM px GROUP BY id")
def center_of_mass(spark, d):
    return cells.center_of_mass(pixels(spark, d).withColumn("v", F.abs("v")))


@query(PX + "SELECT id, y, x FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v DESC, y, x) AS r FROM px) WHERE r = 1")
def image_center(spark, d):
    return cells.brightest(pixels(spark, d))


@query(PX + "SELECT id, y, x, round(v, 6) AS v FROM px WHERE v > 0")
def foreground(spark, d):
    return cells.foreground(pixels(spark, d)).select("id", "y", "x", r6("v").alias("v"))


@query(PX + "SELECT id, y, round(sum(v), 5) AS s, count(*) AS n FROM px GROUP BY id, y")
def point_features(spark, d):
    """Rows as channels: the channel vector of each point."""
    as_channels = pixels(spark, d).select("id", F.col("x").alias("c"), "y", F.lit(0).alias("x"), "v")
    return cells.point_features(as_channels).select("id", "y", F.round(V.total(F.col("vec")), 5).alias("s"), F.size("vec").cast("long").alias("n"))


@query(PX + "SELECT id, y AS c, round(max(v), 6) AS top, count(*) AS n FROM px GROUP BY id, y")
def channel_vectors(spark, d):
    as_channels = pixels(spark, d).select("id", F.col("y").alias("c"), F.lit(0).alias("y"), "x", "v")
    return cells.channel_vectors(as_channels).select("id", "c", r6(F.array_max("vec")).alias("top"), F.size("vec").cast("long").alias("n"))


@query(PX + "SELECT id, y, x, (abs(y - 4) <= 2 AND abs(x - 4) <= 2) AS inside FROM px WHERE (abs(y - 4) <= 2 AND abs(x - 4) <= 2) OR (y % 3 = 0 AND x % 3 = 0)")
def origins(spark, d):
    """The centre box, and beyond it every third position."""
    inside = cells.center_box(F.col("y"), F.col("x"), 2, 8, 8)
    return pixels(spark, d).withColumn("inside", inside).filter(F.col("inside") | ((F.col("y") % 3 == 0) & (F.col("x") % 3 == 0))).select("id", "y", "x", "inside")


@query(PX + """, p AS (SELECT id, y, x FROM px WHERE v > 0.12), m AS (SELECT *, avg(y) OVER w AS my, avg(x) OVER w AS mx, count(*) OVER w AS n FROM p WINDOW w AS (PARTITION BY id)),
q AS (SELECT *, sqrt(pow(y - my, 2) + pow(x - mx, 2)) AS d FROM m), s AS (SELECT *, 3 * sqrt(sum(d) OVER (PARTITION BY id) / greatest(n - 1, 1)) AS cut FROM q) SELECT id, y, x FROM s WHERE n < 2 OR d <= cut""")
def without_outliers(spark, d):
    return cells.without_outliers(pixels(spark, d).filter("v > 0.12").select("id", "y", "x"), ["id"])


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r % 3 = 0")
def every_third(spark, d):
    return cells.every_nth(table(spark, d, "orders"), 3, "o_orderkey", ["o_custkey"]).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_orderpriority, round(o_totalprice, 2) AS price, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 5")
def top_orders(spark, d):
    return cells.top_k(table(spark, d, "orders"), 5, "o_totalprice", "o_orderkey", ["o_orderpriority"]).select("o_orderkey", "o_orderpriority", F.round("o_totalprice", 2).alias("price"), "rank")


@query("SELECT vec_id AS id, label FROM embeddings WHERE label BETWEEN 2 AND 5")
def label_range(spark, d):
    return vectors(spark, d).filter(F.col("label").between(2, 5)).select("id", "label")


@query("SELECT vec_id AS id, label FROM embeddings WHERE label <> 9")
def without_nine(spark, d):
    return vectors(spark, d).filter("label <> 9").select("id", "label")


@query("SELECT vec_id AS id, label FROM embeddings ORDER BY vec_id LIMIT 100")
def take(spark, d):
    return vectors(spark, d).select("id", "label").orderBy("id").limit(100)


@query("SELECT vec_id AS id, label FROM embeddings ORDER BY vec_id OFFSET 400")
def skip(spark, d):
    return cells.after(vectors(spark, d).select("id", "label"), 400, "id")


@query(EM + "SELECT id, round(list_max(v), 6) AS top, (list_position(v, list_max(v)) - 1)::INT AS at, round(list_min(v), 6) AS low, (list_position(v, list_min(v)) - 1)::INT AS low_at FROM e")
def arg_extremes(spark, d):
    v = F.col("v")
    at = lambda x: (F.array_position(v, x) - 1).cast("int")
    return vectors(spark, d).select("id", r6(F.array_max(v)).alias("top"), at(F.array_max(v)).alias("at"), r6(F.array_min(v)).alias("low"), at(F.array_min(v)).alias("low_at"))


@query(EM + "SELECT id, round(list_sort(v)[32], 6) AS median FROM e")
def median_value(spark, d):
    return vectors(spark, d).select("id", r6(F.element_at(F.sort_array("v"), 32)).alias("median"))


@query("SELECT vec_id AS id, vec_id < 400 AS train FROM embeddings")
def train_split(spark, d):
    return vectors(spark, d).select("id", (F.col("id") < 400).alias("train"))


@query(PX + "SELECT label, (row_number() OVER (PARTITION BY label ORDER BY id, i) - 1)::BIGINT AS at, round(v, 6) AS v FROM px")
def label_concat(spark, d):
    """Vectors of a label joined in order of id, as rows of position and value: no label's vectors stand in one row."""
    df = vectors(spark, d).select("id", "label", F.col("v").alias("vec"))
    return cells.joined_by(df, "label", "id").select("label", "at", r6("v").alias("v"))


@query(EM + "SELECT id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first FROM e")
def l2_norm(spark, d):
    df = vectors(spark, d).withColumn("n", V.norm(F.col("v")))
    return df.select("id", r6("n").alias("norm"), r6(F.get(V.scaled(F.col("v"), F.col("n")), F.lit(0))).alias("first"))


@query(EM + "SELECT id, round((v[5] - list_min(v)) / (list_max(v) - list_min(v)) * 255, 4) AS image, round(((v[5] - list_min(v)) / (list_max(v) - list_min(v)) - 0.5) * 2, 6) AS unit FROM e")
def min_max(spark, d):
    v = F.col("v")
    at = lambda a, b: F.get(V.min_max(v, a, b, F.array_min(v), F.array_max(v)), F.lit(4))
    return vectors(spark, d).select("id", F.round(at(0.0, 255.0), 4).alias("image"), r6(at(-1.0, 1.0)).alias("unit"))


@query(EM + ", m AS (SELECT min(list_min(v)) AS lo, max(list_max(v)) AS hi FROM e) SELECT id, round((v[7] - lo) / (hi - lo) * 255, 4) AS v7 FROM e, m")
def min_max_all(spark, d):
    """Over all vectors at once: their least and greatest are one row."""
    df = vectors(spark, d)
    m = df.agg(F.min(F.array_min("v")).alias("lo"), F.max(F.array_max("v")).alias("hi"))
    lo, hi = m.select("lo").scalar(), m.select("hi").scalar()
    df = df.select("id", "v", lo.alias("lo"), hi.alias("hi"))
    return df.select("id", F.round(F.get(V.min_max(F.col("v"), 0.0, 255.0, F.col("lo"), F.col("hi")), F.lit(6)), 4).alias("v7"))


@query(EM + "SELECT id, round(sign(v[3]) * sqrt(abs(v[3])), 6) AS v3 FROM e")
def signed_power(spark, d):
    return vectors(spark, d).select("id", r6(F.get(V.signed_root(F.col("v")), F.lit(2))).alias("v3"))


def _rgb():
    return [F.abs(F.get("v", F.lit(k))) * 255 for k in range(3)]


_DEC = "CASE WHEN {c} <= 0.04045 THEN {c} / 12.92 ELSE pow(({c} + 0.055) / 1.055, 2.4) END"


@query(EM + ", y AS (SELECT id, 0.2126 * (" + _DEC.format(c="abs(v[1])") + ") + 0.7152 * (" + _DEC.format(c="abs(v[2])") + ") + 0.0722 * (" + _DEC.format(c="abs(v[3])") + ") AS y FROM e) SELECT id, round((CASE WHEN y <= 0.0031308 THEN 12.92 * y ELSE 1.055 * pow(y, 1 / 2.4) - 0.055 END) * 255, 4) AS grey FROM y")
def luminance(spark, d):
    return vectors(spark, d).select("id", F.round(V.luminance(*_rgb(), 255.0), 4).alias("grey"))


@query(EM + ", c AS (SELECT id, abs(v[1]) * 255 AS r, abs(v[2]) * 255 AS g, abs(v[3]) * 255 AS b FROM e) SELECT id, round((r - g) / (r + g), 6) AS rg, round((b - (r + g) / 2) / (b + (r + g) / 2), 6) AS by, round(r + g + b, 4) AS s FROM c")
def color_opponency(spark, d):
    rg, by, s = V.opponency(*_rgb())
    return vectors(spark, d).select("id", r6(rg).alias("rg"), r6(by).alias("by"), F.round(s, 4).alias("s"))


@query(EM + ", a AS (SELECT id, v[1] AS x, v[2] AS y, atan2(v[2], v[1]) AS a FROM e) SELECT id, round(sqrt(x * x + y * y), 6) AS r, round(CASE WHEN a < 0 THEN a + 2 * pi() ELSE a END, 6) AS rad, round(degrees(CASE WHEN a < 0 THEN a + 2 * pi() ELSE a END), 4) AS deg FROM a")
def polar_angles(spark, d):
    x, y = F.get("v", F.lit(0)), F.get("v", F.lit(1))
    a = V.angle(x, y)
    return vectors(spark, d).select("id", r6(F.sqrt(x * x + y * y)).alias("r"), r6(a).alias("rad"), F.round(F.degrees(a), 4).alias("deg"))


@query(EM + "SELECT id, round(sqrt(v[1] * v[1] + v[2] * v[2]), 6) AS mag, round(atan2(v[2], v[1]), 6) AS phase, round(least(abs(v[1]) / abs(v[2]), abs(v[2]) / abs(v[1])), 6) AS ratio, round(sqrt(abs(v[1] * v[2])), 6) AS pair FROM e")
def complex_features(spark, d):
    """Magnitude and phase, magnitude ratio, and contrast-invariant pair of the first two values."""
    a, b = F.get("v", F.lit(0)), F.get("v", F.lit(1))
    return vectors(spark, d).select("id", r6(F.sqrt(a * a + b * b)).alias("mag"), r6(F.atan2(b, a)).alias("phase"), r6(V.smaller_ratio(F.abs(a), F.abs(b))).alias("ratio"), r6(F.sqrt(F.abs(a * b))).alias("pair"))


@query(EM + "SELECT id, round(list_sum(list_transform(v, (lambda x, i: abs(x) * i))) / list_sum(list_transform(v, lambda x: abs(x))), 5) AS w FROM e")
def weighted_position(spark, d):
    v = F.col("v")
    return vectors(spark, d).select("id", F.round(V.weighted_mean(F.transform(v, F.abs), F.transform(v, lambda x, i: (i + 1).cast("double"))), 5).alias("w"))


@query(EM + ", p AS (SELECT id, list_transform(v[1:32], lambda x: abs(x)) AS a, list_transform(v[33:64], lambda x: abs(x)) AS b FROM e) SELECT id, round(list_sum(list_transform(range(1, 33), lambda i: CASE WHEN a[i] = 0 THEN 0 ELSE a[i] * ln(a[i] / ((a[i] + b[i]) / 2)) END)), 6) AS kl FROM p")
def kl_divergence(spark, d):
    half = lambda s: F.transform(F.slice("v", s, 32), F.abs)
    return vectors(spark, d).select("id", r6(V.kl_to_middle(half(1), half(33))).alias("kl"))


@query("SELECT p_partkey, string_split(p_name, ' ')[1] AS first, len(string_split(p_name, ' '))::INT AS n FROM part")
def split_space(spark, d):
    return table(spark, d, "part").select("p_partkey", F.get(F.split("p_name", " "), F.lit(0)).alias("first"), F.size(F.split("p_name", " ")).alias("n"))


@query("SELECT vec_id AS id, 'a' AS part FROM embeddings WHERE label < 3 UNION ALL SELECT vec_id, 'b' FROM embeddings WHERE label < 2")
def bag_union(spark, d):
    df = vectors(spark, d)
    return df.filter("label < 3").select("id", F.lit("a").alias("part")).unionByName(df.filter("label < 2").select("id", F.lit("b").alias("part")))


@query("SELECT vec_id AS id FROM embeddings EXCEPT ALL SELECT vec_id FROM embeddings WHERE label < 5")
def list_difference(spark, d):
    df = vectors(spark, d)
    return df.select("id").exceptAll(df.filter("label < 5").select("id"))
