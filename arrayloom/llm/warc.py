"""WARC archives, and a chunked table of their records.

Tasks write one archive each, record by record, into a shared folder; the
manifest of archives is committed by Spark's own writer, so archives of failed
or repeated attempts are never read. The reader streams archives as rows of
record identifier and chunk number. A row carries the digest and length of the
payload so far, so no step ever holds a payload longer than a chunk, and a
record's last row has its whole digest.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, staged

DATE = "2024-01-01T00:00:00Z"
CHUNK = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records long, bytes long"
CHUNKS = "record_id string, chunk_no long, page_id long, record_type string, refers_to long, url string, payload binary, payload_bytes long, payload_digest string, last boolean, digest_ok boolean"


def base32_sha1(content: Column) -> Column:
    """The bare upper-case base32 of the SHA-1: five hex digits make four of base32."""
    digest = F.sha1(content)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """pages as records: page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    Of equal payloads (by SHA-256, as SHA-1 has known collisions) of at least least_bytes, the record
    with the smallest page_id is the response and the others revisit it. Rows
    that repeat that id are responses too; so are rows without an id where none
    of the group has one. A null html is an empty payload.
    """
    c = lambda name: pages[f"`{name}`"]
    rows = pages.select(c(page_id).cast("long").alias("page_id"), c(url).cast("string").alias("url"), F.encode(F.coalesce(c(html), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", base32_sha1(F.col("payload"))).withColumn("sha_", F.sha2("payload", 256))
    groups = rows.filter(F.col("payload_bytes") >= least_bytes).groupBy("sha_").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = staged(groups.select(F.col("sha_").alias("d_"), "first"), "payloads")
    out = rows.join(groups, F.col("sha_") == F.col("d_"), "left").drop("d_", "sha_")
    revisit = F.col("first").isNotNull() & (F.col("payload_bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first"))
    return out.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("first"))).drop("first")


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def write_record(out: BinaryIO, row: dict) -> int:
    """One record as a gzip member; the payload goes through in chunks. Returns the bytes written."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    revisit = row["record_type"] == "revisit"
    length = len(http) + (0 if revisit else row["payload_bytes"])
    head = {"WARC-Type": row["record_type"], "WARC-Record-ID": record_id(row["page_id"]), "WARC-Date": DATE}
    if row["page_id"] is not None:
        head["X-Page-Id"] = row["page_id"]
    if row["url"] is not None:
        head["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["url"])
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(row["refers_to"]), "X-Refers-To-Page": row["refers_to"]}
    head |= {"WARC-Payload-Digest": f"sha1:{row['payload_digest']}", "Content-Type": "application/http;msgtype=response", "Content-Length": length}
    pack = zlib.compressobj(1, wbits=31)
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    n = out.write(pack.compress(text.encode() + http))
    if not revisit:
        payload = memoryview(row["payload"])
        for at in range(0, len(payload), CHUNK):
            n += out.write(pack.compress(payload[at : at + CHUNK]))
    return n + out.write(pack.compress(b"\r\n\r\n") + pack.flush())


def opened(path: str, mode: str) -> BinaryIO:
    """A stream of any file system that pyarrow knows by the path's scheme; Hadoop's names for object stores are translated."""
    from pyarrow import fs

    scheme, mark, rest = path.partition("://")
    system, inner = fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3", "gs": "gcs", "abfss": "abfs"}.get(scheme, scheme) + mark + rest)
    return system.open_output_stream(inner) if mode == "w" else system.open_input_stream(inner)


def writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, n, size, out = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0, None
        try:
            for batch in batches:
                for at in range(batch.num_rows):
                    row = {c: batch.column(c)[at].as_py() for c in batch.schema.names if c != "payload"}
                    row["payload"] = batch.column("payload")[at].as_buffer()  # no copy
                    out = out or opened(path, "w")
                    size += write_record(out, row)
                    n += 1
        finally:
            if out:
                out.close()
        if n:
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [n], "bytes": [size]})

    return run


def write_archives(rows: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes records() as archives below the shared folder and returns their manifest: path, records, bytes."""
    spark = rows.sparkSession
    folder = folder or fresh_path(spark, "warc")
    spark.createDataFrame([], "x int").write.mode("append").parquet(f"{folder}/made")  # makes the folder through Spark
    return staged(rows.mapInArrow(writer(folder), MANIFEST), "manifest")


def headers(f: BinaryIO) -> dict[str, str]:
    """Header lines up to an empty one, by name in lower case."""
    out = {}
    while (line := f.readline()) not in (b"\r\n", b""):
        name, _, value = line.decode(errors="replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def chunks_of(f: BinaryIO, size: int = CHUNK) -> Iterator[dict]:
    """Rows of one archive's records."""
    while line := f.readline():
        if not line.startswith(b"WARC/"):
            continue
        head = headers(f)
        left = int(head["content-length"])
        kind = head.get("warc-type", "")
        number = lambda name: int(head[name]) if name in head else None  # noqa: B023, E731
        row = {"record_id": head.get("warc-record-id"), "page_id": number("x-page-id"), "record_type": kind, "refers_to": number("x-refers-to-page"), "url": head.get("warc-target-uri")}
        declared = head.get("warc-payload-digest", "").removeprefix("sha1:")
        full = None
        if head.get("content-type", "").startswith("application/http"):
            status = f.readline()
            before = len(status)
            http = {}
            while (line := f.readline()) not in (b"\r\n", b""):
                before += len(line)
                name, _, value = line.decode(errors="replace").partition(":")
                http[name.strip().lower()] = value.strip()
            left -= before + 2
            full = int(http["content-length"]) if "content-length" in http else None
        if kind == "revisit":
            yield row | {"chunk_no": 0, "payload": b"", "payload_bytes": full, "payload_digest": declared, "last": True, "digest_ok": None}
            f.read(left)
            continue
        sha, done, k = hashlib.sha1(), 0, 0
        while True:
            data = f.read(min(size, left))
            if not data and left:
                raise EOFError(f"record {row['record_id']} ends {left} bytes early")
            left -= len(data)
            done += len(data)
            sha.update(data)
            digest = base64.b32encode(sha.digest()).decode()
            yield row | {"chunk_no": k, "payload": data, "payload_bytes": done, "payload_digest": digest, "last": not left, "digest_ok": None if left else not declared or digest == declared}
            k += 1
            if not left:
                break


def reader(chunk: int, payloads: bool):
    kinds = [("record_id", pa.string()), ("chunk_no", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("last", pa.bool_()), ("digest_ok", pa.bool_())]
    schema = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                held: list[dict] = []
                size = 0
                with gzip.GzipFile(fileobj=opened(path, "r")) as f:
                    for row in chunks_of(f, chunk):
                        if not payloads:
                            row["payload"] = None
                        held.append(row)
                        size += len(row["payload"] or b"") + 200
                        if size >= 4 * CHUNK:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return run


def read_archives(manifest: DataFrame, chunk: int = CHUNK, payloads: bool = True) -> DataFrame:
    """The chunk rows of the archives in manifest (a column path). A record's result is its row with last.

    An empty payload has one empty chunk. payloads=False leaves the bytes out,
    with digests and lengths still taken over all of them. digest_ok says, on a
    record's last row, whether the bytes have the digest that the record states;
    of a revisit, whether a response with the page_id it names has.
    """
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = manifest.select("path").repartition(parts, "path")
    light = staged(dealt.mapInArrow(reader(chunk, False), CHUNKS), "records")
    rows = dealt.mapInArrow(reader(chunk, True), CHUNKS) if payloads else light
    there = light.filter("last and record_type = 'response' and digest_ok").select(F.col("page_id").alias("p_"), F.col("payload_digest").alias("d_"), F.lit(True).alias("ok_")).distinct()
    revisit = F.col("record_type") == "revisit"
    found = rows.join(there, revisit & (F.col("refers_to") == F.col("p_")) & (F.col("payload_digest") == F.col("d_")), "left")
    return found.withColumn("digest_ok", F.when(revisit, F.coalesce("ok_", F.lit(False))).otherwise(F.col("digest_ok"))).drop("p_", "d_", "ok_")
