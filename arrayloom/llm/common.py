"""Small things the text operators share: words, shared storage, row packing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words everywhere in this subpackage.
SPACE = "[\\x20\\x09-\\x0D]"


def words(text: Column) -> Column:
    """Words of a text: maximal runs without white space. Null gives no words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where the session names none (a local session), a temporary folder is made
    and set once, and removed when Python ends.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="arrayloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back.

    This cuts lineage (a lost executor costs no recomputation), and gives Spark
    the table's true size, so that it broadcasts it only below its threshold and
    otherwise may split a skewed join, which it can't do below an aggregate.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes the files of staged tables that nothing reads any more; others are left alone."""
    for df in tables:
        path = df.__dict__.pop("staged_path", None)
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fitted(df: DataFrame, rows: int, each: int = 100_000) -> DataFrame:
    """df, which holds some `rows` rows or fewer, in a task (and so a file) for each `each` of them, but never in more than it has."""
    return df.coalesce(1 + rows // each)


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """df's whole row as the struct `row`, beside the named columns.

    Operators that return their input's rows work on this form, so input columns
    of any name can't clash with theirs.
    """
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), *[c.alias(k) for k, c in columns.items()])


def unpacked(df: DataFrame) -> DataFrame:
    """The rows that packed() held."""
    return df.select("row.*")
