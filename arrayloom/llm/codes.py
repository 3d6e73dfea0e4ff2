"""Product codes of vectors: Lloyd's rounds over the distinct integer parts at each position.

Vectors become integers and are cut into parts. Equal parts at a position are
one row with a weight, so a round costs as much as there are distinct parts, and
its sums are exact. What reaches the driver is a round's sums, parts * entries *
width numbers, whatever the table's size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Integers from here on aren't coded: squared distances of eight would leave 64 bits soon after.
LIMIT = 1 << 27
#: Parts of a batch whose distances are held at once.
AT_ONCE = 20_000


def integers(vectors: DataFrame, vec_id: str, vector: str, label: str, scale: int) -> DataFrame:
    """(vec_id, label, v) with v's components floor(scale * x); rows of null vectors, or with null or non-finite components, go."""
    x = vectors[f"`{vector}`"].cast("array<double>")
    fine = F.forall(x, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    return vectors.filter(fine).select(vectors[f"`{vec_id}`"].alias("vec_id"), vectors[f"`{label}`"].alias("label"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def cut(rows: DataFrame, parts: int, width: int) -> DataFrame:
    """rows without v, once for each of its parts: part, value."""
    pieces = F.array(*[F.struct(F.lit(p).alias("part"), F.slice("v", p * width + 1, width).cast("array<int>").alias("value")) for p in range(parts)])
    return rows.select(*[c for c in rows.columns if c != "v"], F.inline(pieces))


def nearest(part: np.ndarray, value: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each value, the nearest entry of its part's codebook (ties: the lower index), and the squared distance."""
    code, error = np.empty(len(part), np.int64), np.empty(len(part), np.int64)
    for i in range(0, len(part), AT_ONCE):
        far = value[i : i + AT_ONCE, None, :] - book[part[i : i + AT_ONCE]]
        far = np.einsum("nkw,nkw->nk", far, far)
        code[i : i + AT_ONCE] = far.argmin(1)
        error[i : i + AT_ONCE] = far.min(1)
    return code, error


def arrays(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    part = batch.column("part").to_numpy().astype(np.int64)
    return part, batch.column("value").flatten().to_numpy().astype(np.int64).reshape(len(part), width)


def summing(book: np.ndarray):
    """mapInArrow: for each part and entry that a task's values are nearest to, their weight and weighted sums."""
    parts, entries, width = book.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for batch in batches:
            part, value = arrays(batch, width)
            weight = batch.column("weight").to_numpy()
            at = part * entries + nearest(part, value, book)[0]
            np.add.at(n, at, weight)
            np.add.at(sums, at, value * weight[:, None])
        used = np.flatnonzero(n)
        if len(used):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * width, pa.int32()), pa.array(sums[used].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), lists], names=["at", "n", "sums"])

    return run


def coding(book: np.ndarray):
    """mapInArrow: distinct parts with their code and error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = nearest(*arrays(batch, book.shape[2]), book)
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("value"), pa.array(code), pa.array(error)], names=["part", "value", "code", "error"])

    return run


def trained(distinct: DataFrame, book: np.ndarray, rounds: int) -> np.ndarray:
    """The codebooks after that many rounds over distinct(part, value, weight); unused entries stay.

    Each round reads the staged table anew and sends one row a task, part and
    entry to be added up.
    """
    parts, entries, width = book.shape
    for _ in range(rounds):
        partial = distinct.mapInArrow(summing(book), "at long, n long, sums array<long>")
        whole = partial.groupBy("at").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])
        book = book.reshape(-1, width).copy()
        for at, n, *sums in whole.collect():  # at most parts * entries rows
            book[at] = [s // n for s in sums]
        book = book.reshape(parts, entries, width)
    return book


def digest_of(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """Each vector's code: vec_id, code, error, label_error, codebooks_sha256.

    Components become floor(scale * x). Each part's codebook starts as that part
    of the `entries` smallest ids (ties by the vector, null ids last); with
    fewer vectors it has fewer entries. code has two hex digits a part; error
    sums squared distances over parts; label_error sums errors over equal
    labels, nulls together.

    Vectors that are null or hold null or non-finite components go. Repeated
    rows are coded alike, and each counts. The length is that of the vector with
    the smallest id; vectors of another length, and any whose integers reach
    2^27 in size, take no part in training and have a null code and error. An
    empty table gives no rows; a length that parts doesn't divide is an error.
    """
    if not 1 <= parts <= 8 or not 1 <= entries <= 256:
        raise ValueError("parts are 1 to 8 and entries 1 to 256, so that a code fits 64 bits")
    rows = integers(vectors, vec_id, vector, label, scale).withColumn("small", F.forall("v", lambda c: F.abs(c) < LIMIT))
    order = [F.col("vec_id").asc_nulls_last(), "v"]
    first = rows.filter("small").orderBy(*order).limit(1).select(F.size("v")).first()
    length = first[0] if first else 0
    if length % parts:
        raise ValueError(f"vectors of {length} components can't be cut into {parts} equal parts")
    width = length // parts
    fit = F.col("small") & (F.size("v") == length)
    start = [r.v for r in rows.filter(fit).orderBy(*order).limit(entries).select("v").collect()] if width else []
    if not start:
        none = F.lit(None)
        return rows.select("vec_id", none.cast("string").alias("code"), none.cast("long").alias("error"), none.cast("long").alias("label_error"), F.lit(digest_of(np.empty(0))).alias("codebooks_sha256"))
    book = np.array(start, np.int64).reshape(len(start), parts, width).transpose(1, 0, 2)
    cuts = lambda df: cut(df, parts, width)
    distinct = cuts(rows.filter(fit).select("v")).groupBy("part", "value").agg(F.count(F.lit(1)).alias("weight"))
    distinct = staged(distinct, "distinct")
    book = trained(distinct, book, rounds)
    coded = staged(distinct.mapInArrow(coding(book), "part int, value array<int>, code long, error long"), "coded")
    # The number of a row within its task tells it apart; codes come back as one number of 8 bits a part.
    wide = cuts(rows.filter(fit).withColumn("row_", F.monotonically_increasing_id()).select("row_", "vec_id", "label", "v")).join(coded, ["part", "value"])
    shift = F.call_function("shiftleft", F.col("code"), ((parts - 1) - F.col("part")) * 8)
    whole = wide.groupBy("row_", "vec_id", "label").agg(F.bit_or(shift).alias("code"), F.sum("error").alias("error"))
    whole = whole.select("vec_id", "label", F.lpad(F.lower(F.hex("code")), 2 * parts, "0").alias("code"), "error")
    odd = rows.filter(~fit).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    whole = staged(whole.union(odd), "codes")
    sums = staged(whole.groupBy(F.col("label").alias("label_")).agg(F.sum("error").alias("label_error")), "labels")
    out = whole.join(sums, whole["label"].eqNullSafe(sums["label_"]))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest_of(book)).alias("codebooks_sha256"))
