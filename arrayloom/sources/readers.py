"""Readers and writers of labelled-array formats: Spark reads the files, helpers decode records.

Labelled arrays and records of one size are read by spans: a first pass lists the
spans of each file (by hopping from size to size, or from the file's length
alone), and tasks each read a span's bytes, so one file may be of any length and
is read by many tasks. Files of the other formats are one task's work each; many
files spread. All writers keep Spark's committer: a table of encoded files (name,
content) or Parquet.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.storage import opened, staged

#: Bytes of a file that a task takes at once.
SPAN = 32 << 20
#: STL images that a task holds decoded, of 221 kB each.
HELD = 64
IMAGE = "path string, pos long, label int, channels int, rows int, cols int, data array<double>"


def decoded(spark: SparkSession, paths: str | list[str], decode, schema: str) -> DataFrame:
    """Whole binary files through decode(content), a generator of rows without path and pos."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                held = []
                for pos, row in enumerate(decode(content)):
                    held.append((path, pos, *row))
                    if len(held) == 1000:
                        yield pd.DataFrame(held, columns=names)
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=names)

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, schema)


def files_of(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, length of files; contents aren't read."""
    return spark.read.format("binaryFile").load(paths).select("path", "length")


def labelled_records(content: bytes) -> Iterator[tuple]:
    """Big-endian records: size, then label (8 bytes), extents (count, then 8 bytes each, the innermost first), values (count, then bytes)."""
    at = 0
    while at < len(content):
        label, dims = struct.unpack_from(">qq", content, at + 4)
        extents = struct.unpack_from(f">{dims}q", content, at + 20)
        values = struct.unpack_from(">q", content, at + 20 + 8 * dims)[0]
        data = np.frombuffer(content, np.uint8, values, at + 28 + 8 * dims).astype(float)
        cols, rows, channels = (*extents, 1, 1, 1)[:3]
        yield label, channels, rows, cols, data
        at += 4 + struct.unpack_from(">I", content, at)[0]


def labelled_spans(spark: SparkSession, paths: str | list[str], first: int | None = None, checked: bool = True, span: int = SPAN) -> DataFrame:
    """path, pos, start, stop: runs of whole records of at least `span` bytes (the last of a file has fewer), and the number of their first record.

    A file is a big-endian count and its records. Only sizes of records are read,
    and with `first`, only those of the first records. Where the walk reaches the
    end, a count that isn't that of the records is an error if `checked`.
    """

    def walk(path: str, length: int) -> Iterator[tuple]:
        with opened(path, "at") as raw, io.BufferedReader(raw, 1 << 16) as f:
            head = f.read(4)
            if len(head) < 4:
                raise ValueError(f"{path} has no header")
            count, at, n, start, began = struct.unpack(">I", head)[0], 4, 0, 4, 0
            while at < length and (first is None or n < first):
                f.seek(at)
                at, n = at + 4 + struct.unpack(">I", f.read(4))[0], n + 1
                if at > length:
                    raise ValueError(f"record {n} of {path} is cut off")
                if at - start >= span:
                    yield path, began, start, at
                    start, began = at, n
            if at > start:
                yield path, began, start, at
            if checked and at == length and n != count:
                raise ValueError(f"the header of {path} says {count} records, the file has {n}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, length in zip(b["path"], b["length"], strict=True):
                yield from framed(walk(path, int(length)), ["path", "pos", "start", "stop"])

    return files_of(spark, paths).repartition("path").mapInPandas(run, "path string, pos long, start long, stop long")


def framed(rows: Iterator[tuple], names: list[str], each: int = 1000) -> Iterator[pd.DataFrame]:
    """rows as frames of at most `each`."""
    while held := list(islice(rows, each)):
        yield pd.DataFrame(held, columns=names)


def read_spans(spans: DataFrame, decode, schema: str, parts: int | None = None) -> DataFrame:
    """spans (path, pos, start, stop), dealt among tasks and read, through decode(bytes): path, pos, and what it yields by record."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in b.itertuples():
                with opened(s.path, "at") as f:
                    f.seek(int(s.start))
                    content = f.read(int(s.stop - s.start))
                yield from framed(((s.path, s.pos + k, *row) for k, row in enumerate(decode(content))), names)

    parts = parts or int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spans.repartition(parts, "path", "start").mapInPandas(run, schema)


def read_labelled_arrays(spark: SparkSession, paths: str | list[str], first: int | None = None, checked: bool = True, span: int = SPAN) -> DataFrame:
    """path, pos, label, channels, rows, cols, data. first: only that many records of each file, and no byte behind them.

    A file without records gives no rows; one without a header, or cut off within
    a record, is an error.
    """
    return read_spans(labelled_spans(spark, paths, first, checked, span), labelled_records, IMAGE)


def record_counts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, records: from the four bytes at the head of each file; nothing else is read."""

    def head(path: str) -> int:
        with opened(path, "at") as f:
            return struct.unpack(">I", f.read(4))[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "records": [head(p) for p in b["path"]]})

    return files_of(spark, paths).select("path").mapInPandas(run, "path string, records long")


def encode_labelled(rows: list[tuple]) -> bytes:
    """(label, image) pairs in the labelled-array format; values go to 0..255, rounded half to even."""
    out = io.BytesIO()
    out.write(struct.pack(">I", len(rows)))
    for label, image in rows:
        low, high = image.min(), image.max()
        data = np.round(image if low == high else (image - low) / (high - low) * 255).astype(np.uint8).tobytes()
        extents = image.shape[::-1]
        record = struct.pack(f">qq{len(extents)}qq", label, len(extents), *extents, len(data)) + data
        out.write(struct.pack(">I", len(record)) + record)
    return out.getvalue()


def encoded_files(df: DataFrame, encode, per_file: int = 1000, order: str = "id") -> DataFrame:
    """file, content: rows dealt by number, per_file to a file, through encode(rows of a pandas frame in order). A file is one small group."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(order)
        return pd.DataFrame({"file": [f"part-{int(b['file_'].iloc[0]):09d}"], "content": [encode(b)]})

    return df.withColumn("file_", F.floor(F.col(order) / per_file)).groupBy("file_").applyInPandas(run, "file string, content binary")


def labelled_files(df: DataFrame, per_file: int = 1000) -> DataFrame:
    """file, content: images in the labelled-array format."""
    image = lambda r: np.asarray(r.data, dtype=float).reshape(r.channels, r.rows, r.cols)
    return encoded_files(df.select("id", "label", "channels", "rows", "cols", "data"), lambda b: encode_labelled([(int(r.label), image(r)) for r in b.itertuples()]), per_file)


def save_files(files: DataFrame, folder: str, suffix: str = "") -> DataFrame:
    """Writes each row (file, content) as a file of folder, from its task; returns path and bytes. A task that runs again writes the same file.

    Rows reach Python by the hundred, as a batch of Arrow's may have 10,000 contents.
    """

    @F.udf("long", useArrow=False)
    def written(path: str, content: bytes) -> int:
        with opened(path, "w") as f:
            f.write(content)
        return len(content)

    files.sparkSession.createDataFrame([], "x int").write.mode("append").parquet(f"{folder}/made")  # makes the folder through Spark
    path = F.concat(F.lit(f"{folder}/"), "file", F.lit(suffix))
    return staged(files.select(path.alias("path"), written.asNondeterministic()(path, "content").alias("bytes")), "files")


def stl_images(content: bytes) -> Iterator[tuple]:
    """27,648-byte records: three 96 x 96 channels, stored by column."""
    for at in range(0, len(content) - 27647, 27648):
        a = np.frombuffer(content, np.uint8, 27648, at).reshape(3, 96, 96).transpose(0, 2, 1)
        yield 0, 3, 96, 96, a.astype(float).ravel()


def fixed_spans(spark: SparkSession, paths: str | list[str], size: int, span: int) -> DataFrame:
    """path, pos, start, stop, before: spans of files of records of one size, the number of their first record, and that of the records in files before.

    Files are in the order of their paths. Bytes that make no whole record are left out.
    """
    each = max(1, span // size)
    # A row a file stands in this window.
    n = F.expr(f"length div {size}")
    before = F.coalesce(F.sum("n").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = staged(files_of(spark, paths).select("path", n.alias("n")).select("path", "n", before.alias("before")), "files")
    spans = files.filter("n > 0").select("path", "n", "before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(each).cast("long"))).alias("pos"))
    return spans.select("path", "pos", (F.col("pos") * size).alias("start"), (F.least("n", F.col("pos") + each) * size).alias("stop"), "before")


def fixed_records(spark: SparkSession, paths: str | list[str], size: int, span: int = SPAN) -> DataFrame:
    """path, pos, number, record: files of records of one size, split by their lengths, so they may be of any.

    pos counts within a file, number through all files in the order of their
    paths. Bytes that make no whole record are left out.
    """
    spans = fixed_spans(spark, paths, size, span)
    rows = read_spans(spans, lambda c: ((c[k : k + size],) for k in range(0, len(c), size)), "path string, pos long, record binary")
    return rows.join(spans.select("path", "before").distinct(), "path").select("path", "pos", (F.col("before") + F.col("pos")).alias("number"), "record")


def read_stl(spark: SparkSession, images: str, labels: str, span: int = SPAN) -> DataFrame:
    """Images joined to their one-byte labels by number, with path and pos of the image. Both kinds of file are split.

    Labels go to the spans of images, so that these are read where they are
    decoded and never shuffled, HELD of them at a time.
    """
    size = 27648
    spans = fixed_spans(spark, images, size, span)
    y = fixed_records(spark, labels, 1, span).select("number", F.conv(F.hex("record"), 16, 10).cast("int").alias("label"))
    count = F.expr(f"(stop - start) div {size}")
    rows = spans.select("*", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("k")).withColumn("number", F.col("before") + F.col("pos") + F.col("k"))
    told = rows.join(y, "number").groupBy("path", "pos", "start").agg(F.sort_array(F.collect_list(F.struct("k", "label"))).alias("told"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    told = told.select("path", "pos", "start", F.col("told.k").alias("k"), F.col("told.label").alias("label")).repartition(parts, "path", "start")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in b.itertuples():
                with opened(s.path, "at") as f:
                    for at in range(0, len(s.k), HELD):
                        ks, out = s.k[at : at + HELD], []
                        for k in ks:
                            f.seek(int(s.start) + int(k) * size)
                            out.append(next(stl_images(f.read(size)))[4])
                        yield pd.DataFrame({"path": s.path, "pos": s.pos + ks, "label": s.label[at : at + HELD], "data": out})

    x = told.mapInPandas(run, "path string, pos long, label int, data array<double>")
    extents = [F.lit(v).alias(n) for n, v in (("channels", 3), ("rows", 96), ("cols", 96))]
    return x.select("path", "pos", "label", *extents, "data")


def read_digits(spark: SparkSession, path: str, side: int = 28) -> DataFrame:
    """Lines of side * side values and a label; images are transposed on reading."""
    v = F.transform(F.split(F.trim("value"), " +"), lambda s: s.cast("double"))
    rows = spark.read.text(path).filter(F.trim("value") != "").select(v.alias("v"))
    n = side * side
    data = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get("v", (i % side) * side + F.floor(i / side).cast("int")))
    return rows.select(F.get("v", F.lit(n)).cast("int").alias("label"), F.lit(1).alias("channels"), F.lit(side).alias("rows"), F.lit(side).alias("cols"), data.alias("data"))


def characters(content: bytes) -> Iterator[tuple]:
    """Little-endian: size, tag (2 bytes), width, height (2 each), then bytes, inverted."""
    at = 0
    while at + 10 <= len(content):
        size, tag, width, height = struct.unpack_from("<IHHH", content, at)
        data = 255 - np.frombuffer(content, np.uint8, width * height, at + 10)
        yield tag, width, height, data.tobytes()
        at += size


def encode_characters(rows: list[tuple[int, np.ndarray]]) -> bytes:
    """(tag, image of 0..255 as rows x columns) in the format of characters()."""
    return b"".join(struct.pack("<IHHH", 10 + a.size, tag, a.shape[1], a.shape[0]) + (255 - a).astype(np.uint8).tobytes() for tag, a in rows)


def read_characters(spark: SparkSession, paths: str | list[str], tags: DataFrame | None = None) -> DataFrame:
    """path, pos, tag, width, height, data; tags (tag, label) maps tags to labels by a join."""
    df = decoded(spark, paths, characters, "path string, pos long, tag int, width int, height int, data binary")
    return df if tags is None else df.join(tags, "tag")


def sparse_rows(content: bytes) -> Iterator[tuple]:
    """Little-endian: a count; per row its length, a label (float), and (index from 1, value) pairs."""
    count, at = struct.unpack_from("<I", content)[0], 4
    for _ in range(count):
        n, label = struct.unpack_from("<If", content, at)
        pairs = np.frombuffer(content, np.dtype([("i", "<u4"), ("v", "<f4")]), n, at + 8)
        at += 8 + 8 * n
        yield float(label), (pairs["i"].astype(int) - 1).tolist(), pairs["v"].astype(float).tolist()


def encode_sparse(rows: list[tuple[float, dict[int, float]]]) -> bytes:
    out = struct.pack("<I", len(rows))
    for label, values in rows:
        out += struct.pack("<If", len(values), label) + b"".join(struct.pack("<If", i + 1, v) for i, v in sorted(values.items()))
    return out


def read_sparse(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, pos, label, i, v: sparse feature rows, indices from 0. Text rows: spark.read.format("libsvm")."""
    return decoded(spark, paths, sparse_rows, "path string, pos long, label double, i array<int>, v array<double>")


def sparse_to_dense(i: F.Column, v: F.Column, n: int) -> F.Column:
    """A dense vector of n values; equal indices add up."""
    pairs = F.arrays_zip(i.alias("i"), v.alias("v"))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.aggregate(F.filter(pairs, lambda p: p["i"] == k), F.lit(0.0), lambda s, p: s + p["v"]))


def dense_to_sparse(vec: F.Column) -> F.Column:
    """The nonzero values: array of (i, v)."""
    return F.filter(F.transform(vec, lambda x, i: F.struct(i.alias("i"), x.alias("v"))), lambda s: s["v"] != 0)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """One number a line."""
    return spark.read.text(path).filter(F.trim("value") != "").select(F.trim("value").cast("double").alias("label"))


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    """One path a line."""
    return spark.read.text(path).withColumnRenamed("value", "path")


def read_landmarks(spark: SparkSession, path: str) -> DataFrame:
    """Lines (path, label, ((x, y), (w, h))) as columns."""
    pattern = r'^\(?"?([^",]+)"?,\s*(-?\d+),\s*\(\((\d+),\s*(\d+)\),\s*\((\d+),\s*(\d+)\)\)\)?$'
    g = lambda k, t: F.regexp_extract("value", pattern, k).cast(t)
    return spark.read.text(path).filter(F.col("value").rlike(pattern)).select(g(1, "string").alias("path"), *[g(k, "int").alias(n) for k, n in zip(range(2, 7), ("label", "x", "y", "w", "h"), strict=True)])


def netpbm(content: bytes) -> Iterator[tuple]:
    """Binary PGM and PPM, of 8 or 16 bits: label 0, channels, rows, cols, data."""
    fields, at = [], 0
    while len(fields) < 4:
        while content[at : at + 1].isspace():
            at += 1
        if content[at : at + 1] == b"#":
            at = content.index(b"\n", at)
            continue
        end = at
        while not content[end : end + 1].isspace():
            end += 1
        fields.append(content[at:end])
        at = end
    kind, cols, rows, most = fields[0], *map(int, fields[1:])
    channels = {b"P5": 1, b"P6": 3}[kind]
    a = np.frombuffer(content, ">u2" if most > 255 else np.uint8, rows * cols * channels, at + 1).reshape(rows, cols, channels)
    yield 0, channels, rows, cols, a.transpose(2, 0, 1).astype(float).ravel()


def encode_netpbm(image: np.ndarray) -> bytes:
    """1 or 3 channels of 0..255 as PGM or PPM."""
    if image.shape[0] not in (1, 3):
        raise ValueError("an image has 1 or 3 channels")
    head = f"P{5 if len(image) == 1 else 6}\n{image.shape[2]} {image.shape[1]}\n255\n".encode()
    return head + np.clip(np.round(image.transpose(1, 2, 0)), 0, 255).astype(np.uint8).tobytes()


def read_images(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """PGM and PPM files. Spark's own `image` source reads JPEG and PNG."""
    return decoded(spark, paths, netpbm, IMAGE)


def class_folders(spark: SparkSession, glob: str) -> DataFrame:
    """path and label of files in folders that stand for classes."""
    return labelled_by_folder(spark.read.format("binaryFile").load(glob).select("path"))


def labelled_by_folder(paths: DataFrame) -> DataFrame:
    """paths (a column path) with label: the name of the folder that the file is in."""
    return paths.withColumn("label", F.element_at(F.split("path", "/"), -2))


def half_split(df: DataFrame, index: str, half: int) -> DataFrame:
    """df with train: the first half of the indices."""
    return df.withColumn("train", F.col(index) <= half)


def first_per_class(df: DataFrame, n: int, seed: int, label: str = "label", key: str = "path") -> DataFrame:
    """df with train: the first n of each class in a shuffled order that depends on seed and key."""
    at = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key))
    return df.withColumn("train", at <= n)


def write_layers(df: DataFrame, path: str, layer: str = "layer", seed: int | None = None, scale: float | None = 255.0) -> None:
    """Arrays to one folder a layer; scaled to 0..scale by row if asked, and shuffled if there is a seed."""
    if scale is not None:
        low, high = F.array_min("data"), F.array_max("data")
        df = df.withColumn("data", F.when(low == high, F.col("data")).otherwise(F.transform("data", lambda x: (x - low) / (high - low) * scale)))
    if seed is not None:
        df = df.withColumn("k_", F.xxhash64(F.lit(seed), "id")).sortWithinPartitions("k_").drop("k_")
    df.write.partitionBy(layer).parquet(path)


def sparse_characters(content: bytes) -> Iterator[tuple]:
    """Little-endian records: size, tag, width, height (2 bytes each), then (index 2, value 1) pairs to its end."""
    at = 0
    while at + 10 <= len(content):
        size, tag, width, height = struct.unpack_from("<IHHH", content, at)
        pairs = np.frombuffer(content, np.dtype([("i", "<u2"), ("v", "u1")]), (size - 10) // 3, at + 10)
        yield tag, width, height, pairs["i"].astype(int).tolist(), pairs["v"].astype(float).tolist()
        at += size


def encode_sparse_characters(rows: list[tuple[int, np.ndarray]]) -> bytes:
    """(tag, image of 0..255) in the format of sparse_characters(): the nonzero pixels."""
    out = []
    for tag, a in rows:
        pairs = np.zeros(np.count_nonzero(a), np.dtype([("i", "<u2"), ("v", "u1")]))
        pairs["i"] = np.flatnonzero(a)
        pairs["v"] = a.ravel()[pairs["i"]]
        out.append(struct.pack("<IHHH", 10 + pairs.nbytes, tag, a.shape[1], a.shape[0]) + pairs.tobytes())
    return b"".join(out)


def read_sparse_characters(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, pos, tag, width, height, i, v."""
    return decoded(spark, paths, sparse_characters, "path string, pos long, tag int, width int, height int, i array<int>, v array<double>")
