"""Chat formatting by columnar byte assembly.

Rows are dealt by conversation and range of turns, sorted, and formatted an
Arrow batch at a time: numpy takes the lengths of all segments, their cumulative
offsets and scatter indices, and copies headers and contents into one buffer
made in advance, which becomes the Arrow column. A conversation is a sequence of
parts, so none is ever held whole; read_back() streams over its parts.

The template: <|im_start|>ROLE\\nTEXT<|im_end|>\\n. Inside roles and texts, "<|"
with any backslashes between gets one backslash more, so control strings occur
only as marks. In roles, backslashes and line ends are escaped first.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, MIDDLE = b"<|im_start|>", b"<|im_end|>\n", b"\n"
#: The role whose texts are under the loss mask.
LEARNT = "assistant"
#: Turns of one conversation that are dealt to a task together.
TURNS = 256

PARTS = "conv_id long, range long, part long, n_turns long, formatted binary, masks array<struct<at:int,n:int>>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: bytes) -> bytes:
    return re.sub(rb"<\\(\\*)\|", rb"<\1|", text)


def escaped_role(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: bytes) -> bytes:
    return re.sub(rb"\\(\\|n)", lambda m: b"\\" if m[1] == b"\\" else b"\n", unescape(role))


def lengths_and_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of a binary column without nulls: each value's length, and all bytes in turn."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return np.diff(offsets).astype(np.int64), whole[offsets[0] : offsets[-1]]


def scatter(out: np.ndarray, starts: np.ndarray, lengths: np.ndarray, data: np.ndarray) -> None:
    """Copy values, which stand in turn in data, to their starts in out."""
    before = np.cumsum(lengths) - lengths
    out[np.arange(len(data)) + np.repeat(starts - before, lengths)] = data


def assembled(role: pa.Array, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The formatted bytes of a batch, each row's offsets, and each text's start."""
    fixed = [np.frombuffer(x, np.uint8) for x in (START, MIDDLE, END)]
    role_n, role_bytes = lengths_and_bytes(role)
    text_n, text_bytes = lengths_and_bytes(text)
    n = len(role_n)
    segments = np.empty((n, 5), np.int64)
    segments[:, 0], segments[:, 1], segments[:, 2], segments[:, 3], segments[:, 4] = len(START), role_n, len(MIDDLE), text_n, len(END)
    ends = np.cumsum(segments).reshape(n, 5)
    starts = ends - segments
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for k, header in ((0, fixed[0]), (2, fixed[1]), (4, fixed[2])):
        out[(starts[:, k, None] + np.arange(len(header))).ravel()] = np.tile(header, n)
    scatter(out, starts[:, 1], role_n, role_bytes)
    scatter(out, starts[:, 3], text_n, text_bytes)
    return out, np.concatenate([starts[:, 0], ends[-1:, 4]]), starts[:, 3]


def format_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to parts: one for each run of a conversation's range in a batch."""
    part = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        role, text = batch.column("role"), batch.column("text")
        out, offsets, text_at = assembled(role, text)
        conv, rng, learnt = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("conv_key", "range", "learnt"))
        first = np.flatnonzero(np.concatenate([[True], (conv[1:] != conv[:-1]) | (rng[1:] != rng[:-1])]))
        last = np.concatenate([first[1:], [batch.num_rows]])
        text_n = lengths_and_bytes(text)[0]
        run_of = np.repeat(np.arange(len(first)), last - first)
        at = (text_at - offsets[first][run_of])[learnt]
        masks = pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(text_n[learnt], pa.int32())], ["at", "n"])
        counts = np.bincount(run_of[learnt], minlength=len(first))
        formatted = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(np.concatenate([offsets[first], offsets[-1:]]).astype(np.int32)), pa.py_buffer(out)])
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id").take(pa.array(first)), pa.array(rng[first], pa.int64()), pa.array(part + np.arange(len(first)), pa.int64()), pa.array(last - first, pa.int64()), formatted, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), masks)],
            names=["conv_id", "range", "part", "n_turns", "formatted", "masks"],
        )
        part += len(first)


def formatted(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The conversations of rows as parts: conv_id, range, part, n_turns, formatted (UTF-8), masks.

    A conversation's formatted text is its parts' in order of range and part.
    masks are the byte spans of the assistant's (escaped) texts. Turns of equal
    number are ordered by role, then text; a null turn comes first; null roles
    and texts are empty; rows with a null conv_id are one conversation. Repeated
    rows are turns like any other. An empty table gives no parts.
    """
    c = lambda name: rows[f"`{name}`"]
    df = rows.select(
        c(conv_id).cast("long").alias("conv_id"), F.coalesce(F.floor(c(turn).cast("long") / TURNS), F.lit(-(1 << 62))).cast("long").alias("range"), c(turn).cast("long").alias("turn"),
        F.coalesce(c(role), F.lit("")).alias("role"), F.coalesce(c(text), F.lit("")).alias("text"),
    )
    df = df.repartition("conv_id", "range").sortWithinPartitions("conv_id", "range", "turn", "role", "text")
    # A null conversation's key is told from all others' by xxhash64 of both columns.
    out = df.select("conv_id", F.xxhash64(F.col("conv_id").isNull(), "conv_id").alias("conv_key"), "range", F.encode(escaped_role(F.col("role")), "UTF-8").alias("role"), F.encode(escaped(F.col("text")), "UTF-8").alias("text"), (F.col("role") == LEARNT).alias("learnt"))
    return out.mapInArrow(format_batches, PARTS)


def turns_of(part: bytes) -> Iterator[tuple[bytes, bytes]]:
    """The roles and texts in formatted bytes."""
    for turn in part.split(START)[1:]:
        role, text = turn.removesuffix(END).split(MIDDLE, 1)
        yield unescape_role(role), unescape(text)


def digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts, whole conversations in turn, to a row for each conversation."""
    key: tuple | None = None
    state: list = []

    def closed() -> list:
        n, turns, loss_chars, loss, chars = state
        return [key[0], n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars]

    for batch in batches:
        done = []
        for conv, n, part, masks in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "n_turns", "formatted", "masks")], strict=True):
            if key != (conv,):
                if key is not None:
                    done.append(closed())
                key, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[0] += n
            state[4] += len(part.decode())
            for role, text in turns_of(part):
                state[1].update(role + b"\n" + text + b"\n")
            for m in masks:
                learnt = unescape(part[m["at"] : m["at"] + m["n"]])
                state[2] += len(learnt.decode())
                state[3].update(learnt)
        if done:
            yield digest_rows(done)
    if key is not None:
        yield digest_rows([closed()])


def digest_rows(rows: list[list]) -> pa.RecordBatch:
    kinds = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])


def read_back(parts: DataFrame) -> DataFrame:
    """A row for each conversation, read from its parts: DIGESTS' columns.

    Digests are taken over a stream of parts in order, so memory holds a batch.
    """
    df = parts.select("conv_id", "range", "part", "n_turns", "formatted", "masks")
    return df.repartition("conv_id").sortWithinPartitions("conv_id", "range", "part").mapInArrow(digest_batches, DIGESTS)
