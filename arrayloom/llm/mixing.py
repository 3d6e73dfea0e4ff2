"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Rows of a source are put in a fixed pseudo-random order and cut into blocks. A
frame of Q slots gives source s a quota a_s, with Q the sum of quotas. Block j
of source s is released at floor(j Q / a_s), due at ceil((j+1) Q / a_s), and the
earliest deadline among released blocks takes each slot. After Q slots every
source has had just its quota, so the schedule repeats: one frame is folded, and
every block finds its slot from its number alone. Within every prefix of slots,
a source is less than one block from its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import packed, staged

BUCKETS = 4096


def quotas(sizes: DataFrame, weights: dict[str, float] | None, alpha: float, frame: int) -> DataFrame:
    """sizes (source, n_rows) with the quota of each source, at least 1.

    Weights are given by source (others weigh 1), or n_rows ** alpha. A quota is
    the weight's share of `frame`, rounded: that is the weight's resolution. A
    weight that isn't positive is an error, as its rows would have no place.
    """
    if weights and min(weights.values()) <= 0:
        raise ValueError("weights are positive")
    if weights is None:
        weight = F.pow(F.col("n_rows").cast("double"), F.lit(float(alpha)))
    else:
        weight = F.lit(1.0)
        for name, w in weights.items():
            weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    df = sizes.withColumn("weight", weight)
    total = df.agg(F.sum("weight")).scalar()
    return df.withColumn("quota", F.greatest(F.lit(1), F.round(F.col("weight") / total * frame)).cast("long"))


def frame_slots(shares: DataFrame) -> DataFrame:
    """One frame: slot, source, j, quota, frame, and by source, the arrays before, quotas, sizes.

    It has a row per slot, so its size is bounded by the frame and the number of
    sources, never by rows.
    """
    listed = F.array_sort(F.collect_list(F.struct("source", "quota", "n_rows")))
    one = shares.agg(listed.alias("s")).select(
        F.col("s.source").alias("sources"), F.col("s.quota").alias("q"), F.col("s.n_rows").alias("sizes"), F.aggregate("s", F.lit(0).cast("long"), lambda n, x: n + x["quota"]).alias("frame")
    )
    q, frame = F.col("q"), F.col("frame")
    late = F.lit(1 << 62)

    def deadline(c: Column, t: Column) -> Column:
        """By source: the deadline of its next block, if that is released."""
        # Whole-number floor and ceiling of j * frame / quota.
        released = lambda j, a: F.call_function("div", j * frame, a)
        due = lambda j, a: F.call_function("div", (j + 1) * frame + a - 1, a)
        return F.transform(q, lambda a, i: F.struct(F.when(released(F.get(c, i), a) <= t, due(F.get(c, i), a)).otherwise(late).alias("d"), i.alias("i")))

    def step(s: Column, t: Column) -> Column:
        pick = F.array_min(deadline(s["c"], t))["i"]
        chosen = F.struct(pick.alias("i"), s["c"].alias("before"))
        return F.struct(F.transform(s["c"], lambda x, i: x + F.when(i == pick, 1).otherwise(0)).alias("c"), F.concat(s["slots"], F.array(chosen)).alias("slots"))

    start = F.struct(F.transform(q, lambda a: F.lit(0).cast("long")).alias("c"), F.lit(None).cast("array<struct<i:int,before:array<bigint>>>").alias("slots"))
    start = F.struct(start["c"].alias("c"), F.coalesce(start["slots"], F.array().cast("array<struct<i:int,before:array<bigint>>>")).alias("slots"))
    folded = one.filter("frame > 0").withColumn("slots", F.aggregate(F.sequence(F.lit(0).cast("long"), frame - 1), start, step, lambda s: s["slots"]))
    slots = folded.select("sources", "q", "sizes", "frame", F.posexplode("slots").alias("slot", "x"))
    i = F.col("x.i")
    return slots.select("slot", F.get("sources", i).alias("source"), F.get("x.before", i).alias("j"), F.get("q", i).alias("quota"), "frame", "x.before", F.col("q").alias("quotas"), "sizes")


def mixed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", weights: dict[str, float] | None = None, alpha: float = 0.5, frame: int = 1024, block_rows: int = 32, seed: str = "mix") -> DataFrame:
    """Every row of docs as the struct `row`, with its place in the mix.

    Adds source, quota, frame, block_no, release, deadline, slot and position (0
    to rows - 1). A source that has run out leaves its slots empty; the others
    go on in the same proportions, and positions close the gaps. No row is
    dropped or repeated. Order within a source is by the MD5 of id and seed; rows
    with equal ids follow their contents' hash, and equal rows are alike. A null
    source is a source; a null id is ordered as an empty one. An empty table
    gives no rows. Sources are few: the frame is one row per slot, folded at once.
    """
    rows = packed(docs, source=docs[f"`{source}`"].cast("string"), id_=docs[f"`{doc_id}`"])
    rows = rows.withColumn("key_", F.md5(F.concat_ws(":", F.coalesce(F.col("id_").cast("string"), F.lit("")), F.lit(seed)).cast("binary")))
    rows = rows.withColumn("bucket_", F.conv(F.substring("key_", 1, 3), 16, 10).cast("int"))
    # A source as two plain columns, so that joins and windows on it share one exchange.
    rows = rows.withColumns({"none_": F.col("source").isNull(), "name_": F.coalesce("source", F.lit(""))})
    counts = staged(rows.groupBy("none_", "name_", "source", "bucket_").agg(F.count(F.lit(1)).alias("n_")), "counts")
    # At most BUCKETS rows a source stand in this window.
    before = F.coalesce(F.sum("n_").over(W.partitionBy("none_", "name_").orderBy("bucket_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = staged(counts.select("none_", "name_", "bucket_", before.alias("before_")), "offsets")
    sizes = counts.groupBy("source").agg(F.sum("n_").alias("n_rows"))
    slots = staged(frame_slots(quotas(sizes, weights, alpha, frame)), "frame").withColumnRenamed("source", "f_").withColumnRenamed("j", "j_")
    at = F.row_number().over(W.partitionBy("none_", "name_", "bucket_").orderBy("key_", "id_", F.xxhash64("row")))
    placed = rows.withColumn("at_", at).join(offsets, ["none_", "name_", "bucket_"])
    placed = placed.withColumn("index_", F.col("before_") + F.col("at_") - 1).withColumn("block_no", F.floor(F.col("index_") / block_rows))
    share = staged(slots.select(F.col("f_").alias("g_"), "quota", "frame").distinct(), "quotas")
    placed = placed.join(share, placed["source"].eqNullSafe(share["g_"])).drop("g_")
    found = placed.join(slots.drop("quota", "frame"), placed["source"].eqNullSafe(F.col("f_")) & (F.col("block_no") % F.col("quota") == F.col("j_")))
    turn = F.floor(F.col("block_no") / F.col("quota"))
    each = F.transform("quotas", lambda a, i: F.least(F.get("sizes", i), (turn * a + F.get("before", i)) * block_rows))
    div = lambda a, b: F.call_function("div", a, b)
    return found.select(
        "row", "source", "quota", "frame", "block_no",
        div(F.col("block_no") * F.col("frame"), F.col("quota")).alias("release"),
        div((F.col("block_no") + 1) * F.col("frame") + F.col("quota") - 1, F.col("quota")).alias("deadline"),
        (turn * F.col("frame") + F.col("slot")).alias("slot"),
        (F.aggregate(each, F.lit(0).cast("long"), lambda n, x: n + x) + F.col("index_") % block_rows).alias("position"),
    )


def in_order(docs: DataFrame, position: str | None = None, **how) -> DataFrame:
    """docs' rows and columns in the order of the mix: partitions, and files written from them, hold it in turn.

    Readers may take files in another order; a column named by `position` keeps
    the place, and replaces one of that name. What odd rows give is as in mixed():
    every row is there, repeats and nulls as well; an empty table gives no rows.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = max(1, -(-docs.count() // parts))
    out = mixed(docs, **how).withColumn("part_", F.floor(F.col("position") / each).cast("int"))
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c != position]
    return out.repartitionById(parts, "part_").sortWithinPartitions("position").select(*kept, *[F.col("position").alias(c) for c in [position] if c])
