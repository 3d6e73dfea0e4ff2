"""Token counts by distinct pre-token, without token ids.

Scanning tasks turn a batch of documents into postings: for each pre-token, the
documents that have it and how often. Postings are dealt by pre-token; each
distinct pre-token's pieces are counted once, joined to its postings, and
products are summed by document. Long postings are dealt by a salt too, so a
frequent pre-token spreads over tasks (it is counted once for each salt).
"""

from __future__ import annotations

import ctypes
import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Unicode white space.
BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters below which lower case, composition and classes don't differ between versions of Unicode.
PLAIN = re.compile(r"[\x00-\u024f]*")
#: Postings of more documents than this are dealt by salt.
LONG, SALTS = 256, 64

POSTINGS = "token string, salt int, docs binary, counts binary"


@functools.cache
def library(spec: str):
    """The tokenizer, loaded once in a worker, whatever tasks it runs."""
    from tokenizers import Tokenizer

    out = Tokenizer.from_str(spec)
    out.no_truncation()
    out.no_padding()
    return out


# The only normaliser and pre-tokenizer that Splitter follows, as a tokenizer file states them.
NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def checked(spec: str) -> dict:
    """A tokenizer file's content; an error if its texts aren't split as Splitter does it, as counts would be wrong in silence."""
    file = json.loads(spec)
    if file.get("normalizer") != NORMALISER or file.get("pre_tokenizer") != PRE_TOKENIZER or file["model"]["type"] != "BPE":
        raise ValueError("a tokenizer file with another normaliser, pre-tokenizer or model is not supported")
    if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in file["added_tokens"]):
        raise ValueError("added tokens that are normalised, stripped or whole words are not supported")
    return file


class Splitter:
    """Texts to pre-tokens as a tokenizer file's own normaliser and pre-tokenizer give them."""

    def __init__(self, spec: str) -> None:
        self.spec = spec
        special = [t["content"] for t in checked(spec)["added_tokens"]]
        self.special = set(special)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.pattern = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{BLANK}\p{{L}}\p{{N}}]+")

    def __call__(self, text: str) -> list[str]:
        if not self.cut:
            return self.plain(text)
        out: list[str] = []
        for piece in self.cut.split(text):
            out += [piece] if piece in self.special else self.plain(piece)
        return out

    def plain(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text):
            return self.pattern.findall(text.lower())
        normal = library(self.spec).normalizer.normalize_str(text)  # few texts need it
        return [normal[a:b] for _, (a, b) in library(self.spec).pre_tokenizer.pre_tokenize_str(normal)]


def varints(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Rows of `lengths` values each as LEB128 bytes."""
    values = values.astype(np.uint64)
    n = np.ones(len(values), np.int64)
    for k in range(1, 10):
        n += values >= np.uint64(1 << (7 * k))
    ends = np.cumsum(n)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(10):
        some = n > k
        if not some.any():
            break
        byte = (values[some] >> np.uint64(7 * k)) & np.uint64(127)
        more = (n[some] > k + 1).astype(np.uint64) << np.uint64(7)
        out[ends[some] - n[some] + k] = byte | more
    rows = np.concatenate([[0], np.cumsum(lengths)])
    offsets = np.concatenate([[0], ends])[rows]
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])


def unvarints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a varints() column, and each row's number of values."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(column) and column.buffers()[2] is not None else np.empty(0, np.uint8)
    final = data < 128
    ends = np.flatnonzero(final) + 1
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else np.empty(0, np.int64)
    values = np.zeros(len(ends), np.uint64)
    for k in range(int((ends - starts).max(initial=0))):
        some = ends - starts > k
        values[some] |= (data[starts[some] + k].astype(np.uint64) & np.uint64(127)) << np.uint64(7 * k)
    totals = np.concatenate([[0], np.cumsum(final)])
    return values, np.diff(totals[offsets - offsets[0]])


def zigzag(x: np.ndarray) -> np.ndarray:
    return ((x << 1) ^ (x >> 63)).astype(np.uint64)


def unzigzag(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(1)).astype(np.int64) ^ -(x & np.uint64(1)).astype(np.int64)


#: Pre-tokens that are held at once, or those of one document if it has more.
HELD = 2_000_000


def poster(spec: str):
    """Batches of (key, text) to postings. The first document of a posting stands whole, later ones as differences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter(spec)
        for batch in batches:
            ids: dict[str, int] = {}
            keys: list[int] = []
            parts: list[np.ndarray] = []
            held = 0
            for key, text in zip(batch.column("key"), batch.column("text"), strict=True):
                found = split(text.as_py())
                if held and held + len(found) > HELD:
                    yield postings(ids, keys, parts)
                    ids, keys, parts, held = {}, [], [], 0
                if found:
                    keys.append(key.as_py())
                    parts.append(np.fromiter((ids.setdefault(t, len(ids)) for t in found), np.int32, len(found)))
                    held += len(found)
            if held:
                yield postings(ids, keys, parts)
        give_back()

    return run


def give_back() -> None:
    """Freed memory to the system (where the C library can): a task's later stages share the executor's limit."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def postings(ids: dict[str, int], keys: list[int], parts: list[np.ndarray]) -> pa.RecordBatch:
    """By pre-token, in order of its number in ids: keys of documents that have it, and how often."""
    n, doc_ids = len(keys), np.array(keys, np.int64)
    order = np.argsort(doc_ids, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    both = np.concatenate(parts).astype(np.int64)
    both *= n
    both += np.repeat(place, [len(p) for p in parts])
    parts.clear()
    both.sort()
    start = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    counts = np.diff(np.concatenate([start, [len(both)]]))
    both = both[start]
    token, doc = both // n, doc_ids[order[both % n]]
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    lengths = np.diff(np.concatenate([first, [len(token)]]))
    deltas = np.concatenate([[0], np.diff(doc)])
    deltas[first] = doc[first]
    salt = zlib.crc32(doc_ids[order[0]].tobytes()) % SALTS
    columns = [pa.array(list(ids)), pa.array(np.where(lengths > LONG, salt, 0), pa.int32()), varints(zigzag(deltas), lengths), varints(counts, lengths)]
    return pa.RecordBatch.from_arrays(columns, names=["token", "salt", "docs", "counts"])


def counter(spec: str):
    """A pandas UDF from pre-tokens to their numbers of pieces."""

    @F.pandas_udf("long")
    def pieces(tokens: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = library(spec).encode_batch_fast
        for t in tokens:
            yield pd.Series([len(e.ids) for at in range(0, len(t), 500) for e in encode(t.iloc[at : at + 500].tolist(), add_special_tokens=False)], dtype="int64")
        give_back()

    return pieces


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings with pieces to sums by document, one row per document and batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        deltas, lengths = unvarints(batch.column("docs"))
        counts = unvarints(batch.column("counts"))[0]
        steps = unzigzag(deltas)
        # Running sums that start again at each posting.
        first = np.cumsum(lengths) - lengths
        total = np.cumsum(steps)
        docs = total - np.repeat(total[first] - steps[first], lengths)
        tokens = np.repeat(batch.column("pieces").to_numpy(zero_copy_only=False), lengths) * counts.astype(np.int64)
        ids, at = np.unique(docs, return_inverse=True)
        sums = np.zeros(len(ids), np.int64)
        np.add.at(sums, at, tokens)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sums)], names=["key", "n"])
    give_back()


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """docs as doc_id, text and a key: the id, or a hash where an id has several texts or is null."""
    rows = docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), F.coalesce(docs[f"`{text}`"], F.lit("")).alias("text"))
    content = F.xxhash64("text")
    several = staged(rows.groupBy("doc_id").agg(F.min(content).alias("a"), F.max(content).alias("b")).filter("a <> b").select(F.col("doc_id").alias("several")), "several")
    marked = rows.join(several, rows["doc_id"] == several["several"], "left")
    own = F.col("several").isNull() & F.col("doc_id").isNotNull()
    return marked.select("doc_id", "text", F.when(own, F.col("doc_id")).otherwise(F.xxhash64("doc_id", "text")).alias("key"))


def token_counts(docs: DataFrame, spec: str, doc_id: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """Every row of docs: doc_id, n_bytes, n_tokens, over_limit (more than limit tokens).

    spec is a tokenizer file's JSON: BPE of words split by the pattern that
    Splitter states. Counts are those of the library without added special
    tokens; special strings inside a text are one token each. Null and empty
    texts have none. Rows that repeat an id keep their own texts' counts. An
    empty table gives no rows.
    """
    checked(spec)
    rows = keyed(docs, doc_id, text)
    postings = rows.select("key", "text").mapInArrow(poster(spec), POSTINGS).repartition("token", "salt")
    # The longest posting is carried so that both sides read one exchange.
    once = postings.groupBy("token", "salt").agg(F.max(F.octet_length("docs") + F.octet_length("counts")).alias("longest"))
    once = once.select(F.col("token").alias("t_"), F.col("salt").alias("s_"), "longest", counter(spec)("token").alias("pieces"))
    joined = postings.join(once, (F.col("token") == F.col("t_")) & (F.col("salt") == F.col("s_"))).filter("longest > 0")
    sums = joined.select("docs", "counts", "pieces").mapInArrow(summed, "key long, n long").withColumn("c", F.lit(0).cast("long"))
    rows = rows.select("key", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"))
    # Equal rows have one key, and their sum holds each of them.
    totals = sums.union(rows.select("key", F.lit(0).cast("long").alias("n"), F.lit(1).cast("long").alias("c"))).groupBy("key").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    n = F.call_function("div", F.col("n"), F.col("c"))
    return rows.join(totals, "key").select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
