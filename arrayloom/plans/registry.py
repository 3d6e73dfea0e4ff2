"""Named queries over the sample tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: DuckDB: embeddings as pixels of 8 x 8 images.
PX = "WITH px AS (SELECT vec_id AS id, label, (i - 1)::INT AS i, ((i - 1) // 8)::INT AS y, ((i - 1) % 8)::INT AS x, v FROM (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)) "
#: DuckDB: embeddings as lists of double.
EM = "WITH e AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings) "


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with the DuckDB SQL of its rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, v: embeddings as vectors of double."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, channels, rows, cols, data: embeddings as 8 x 8 images."""
    return vectors(spark, sf_dir).select("id", "label", F.lit(1).alias("channels"), F.lit(8).alias("rows"), F.lit(8).alias("cols"), F.col("v").alias("data"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, c, y, x, v: the images in long form."""
    from ..operators.cells import to_long

    return to_long(images(spark, sf_dir), 8, 8)


def r6(c: Column | str) -> Column:
    """Rounded for comparison across engines."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


def r6s(v: Column) -> Column:
    return F.transform(v, lambda x: F.round(x, 6) + F.lit(0.0))
