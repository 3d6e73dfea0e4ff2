"""Connected components of a graph by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


#: Rows of a graph for each task: a small graph's rounds are a few tasks, however many partitions shuffles have.
EACH = 50_000


def stars(edges: DataFrame, large: bool, parts: int) -> DataFrame:
    """One round over edges(u, v), each once with u > v, in `parts` tasks.

    large: each node links its larger neighbours to the least of its neighbours
    and itself. small: each node links its smaller neighbours, and itself, to
    the least of these.
    """
    if large:
        ways = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        ways = edges.select("u", "v")
    least = staged(ways.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts), "least").withColumn("m", F.least("u", "m"))
    joined = ways.join(least, "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return staged(out.filter(F.col("u") != F.col("v")).distinct().coalesce(parts), "stars")


def mark(edges: DataFrame) -> tuple:
    """A count and an order-free checksum of the edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(u, v): root is the least node reachable.

    Each round is written to the shared folder, by a task for each EACH edges.
    Rounds grow with the logarithm of the nodes; a hub's edges are split by
    Spark's skewed join.
    """
    e = staged(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = mark(e)
    while before[0]:
        parts = 1 + 2 * before[0] // EACH
        e = stars(stars(e, True, parts), False, parts)
        now = mark(e)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v"), F.col("v")).distinct())
