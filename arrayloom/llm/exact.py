"""Exact deduplication by owners in compressed radix (Patricia) tries.

Texts are dealt by byte length and content hash. Each task inserts whole byte
strings into a trie below that prefix; a terminal node holds the group's owner
and size. A first trie in each scanning task merges copies before the shuffle,
so a hot text costs one row per batch. Rows arrive sorted by length and hash,
so a subtree is complete, and leaves memory, once its prefix has passed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, staged, unpacked


class Trie:
    """A compressed radix trie from byte strings to [owner, copies, digest]."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]  # label, children by first byte, value

    def insert(self, key: bytes) -> list:
        """The value of key's terminal node, made if there is none."""
        node, at = self.root, 0
        while at < len(key):
            child = node[1].get(key[at])
            if child is None:
                child = node[1][key[at]] = [key[at:], {}, None]
                node, at = child, len(key)
                break
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            n = common_prefix(label, key, at)
            middle = node[1][key[at]] = [label[:n], {label[n]: child}, None]
            child[0] = label[n:]
            node, at = middle, at + n
        if node[2] is None:
            node[2] = [None, 0, None]
        return node[2]

    def items(self) -> Iterator[tuple[bytes, list]]:
        """Every key with its value."""
        todo = [(b"", self.root)]
        while todo:
            before, node = todo.pop()
            key = before + node[0]
            if node[2] is not None:
                yield key, node[2]
            todo.extend((key, child) for child in node[1].values())


def common_prefix(label: bytes, key: bytes, at: int) -> int:
    """Bytes that label shares with key from at; found by halving."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if label[low:mid] == key[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


def merge(value: list, sha: str, owner: int | None, copies: int, largest: bool) -> None:
    """Add copies with their owner to a terminal node. A null id never owns if another can."""
    value[1] += copies
    value[2] = sha
    if owner is not None and (value[0] is None or (owner > value[0] if largest else owner < value[0])):
        value[0] = owner


LOCAL = "n_bytes long, sha string, content binary, owner long, copies long"
OWNERS = "n_bytes long, sha string, keep_id long, group_size long"


def combine(largest: bool):
    """For scanning tasks: one row for each distinct text of an Arrow batch."""
    schema = pa.schema([("n_bytes", pa.int64()), ("sha", pa.string()), ("content", pa.binary()), ("owner", pa.int64()), ("copies", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tries: dict[int, Trie] = {}
            for content, doc, n, sha in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                merge(tries.setdefault(n, Trie()).insert(content), sha, doc, 1, largest)
            rows = [(n, sha, key, owner, copies) for n, trie in tries.items() for key, (owner, copies, sha) in trie.items()]
            if rows:
                yield table(rows, schema)

    return run


def own(largest: bool):
    """For tasks that hold whole prefixes, in order: one row for each text.

    A subtree holds the texts of one length whose digests share two digits.
    """
    schema = pa.schema([("n_bytes", pa.int64()), ("sha", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix, trie = None, Trie()
        done: list[tuple] = []

        def spill() -> None:
            values = [value for _, value in trie.items()]
            if len({sha for *_, sha in values}) < len(values):
                raise RuntimeError(f"different texts of {prefix[0]} bytes share a SHA-256 digest")
            done.extend((prefix[0], sha, owner, copies) for owner, copies, sha in values)

        for batch in batches:
            for n, sha, content, owner, copies in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if (n, sha[:2]) != prefix:
                    if prefix is not None:
                        spill()
                    prefix, trie = (n, sha[:2]), Trie()
                merge(trie.insert(content), sha, owner, copies, largest)
            if len(done) > 10_000:
                yield table(done, schema)
                done.clear()
        if prefix is not None:
            spill()
        if done:
            yield table(done, schema)

    return run


def table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def text_owners(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "smallest") -> DataFrame:
    """A row for each distinct text: n_bytes, sha, keep_id, group_size."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    content = F.encode(F.coalesce(docs[f"`{text}`"], F.lit("")), "UTF-8")
    rows = docs.select(content.alias("content"), docs[f"`{doc_id}`"].cast("long").alias("doc_id")).withColumns({"n_bytes": F.octet_length("content").cast("long"), "sha": F.sha2("content", 256)})
    local = rows.mapInArrow(combine(keep == "largest"), LOCAL)
    dealt = local.repartition("n_bytes", "sha").sortWithinPartitions("n_bytes", "sha")
    return staged(dealt.mapInArrow(own(keep == "largest"), OWNERS), "owners")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "smallest") -> DataFrame:
    """Every row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when all bytes are; null counts as empty. The row with the
    smallest (or largest) id of a group stays; rows that repeat that id with the
    same text can't be told apart and all stay. A null id stays only in a group
    of nulls. group_size counts rows. An empty table gives no rows.
    """
    owners = text_owners(docs, doc_id, text, keep)
    content = F.encode(F.coalesce(docs[f"`{text}`"], F.lit("")), "UTF-8")
    rows = docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), F.sha2(content, 256).alias("text_sha256"), F.octet_length(content).cast("long").alias("bytes_"))
    found = rows.join(owners, (rows["text_sha256"] == owners["sha"]) & (rows["bytes_"] == owners["n_bytes"]))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of docs that stay, with docs' columns."""
    owners = text_owners(docs, doc_id, text, keep)
    content = F.encode(F.coalesce(docs[f"`{text}`"], F.lit("")), "UTF-8")
    rows = packed(docs, id_=docs[f"`{doc_id}`"].cast("long"), sha_=F.sha2(content, 256), bytes_=F.octet_length(content).cast("long"))
    same = (rows["sha_"] == owners["sha"]) & (rows["bytes_"] == owners["n_bytes"]) & rows["id_"].eqNullSafe(owners["keep_id"])
    return unpacked(rows.join(owners, same, "left_semi"))
