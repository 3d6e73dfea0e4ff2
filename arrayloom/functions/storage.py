"""Tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where a (local) session has none, a temporary folder for its lifetime."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="arrayloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: its lineage is cut, its size known."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def opened(path: str, mode: str):
    """A stream of any file system that pyarrow knows by the path's scheme; Hadoop's names for object stores are translated.

    mode: "w" writes, "r" reads from the start, "at" reads anywhere.
    """
    from pyarrow import fs

    for theirs, ours in (("s3a://", "s3://"), ("s3n://", "s3://"), ("gs://", "gcs://"), ("abfss://", "abfs://")):
        if path.startswith(theirs):
            path = ours + path[len(theirs) :]
    if path.startswith("file:") or "://" not in path:
        system, inner = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    else:
        system, inner = fs.FileSystem.from_uri(path)
    return {"w": system.open_output_stream, "r": system.open_input_stream, "at": system.open_input_file}[mode](inner)
