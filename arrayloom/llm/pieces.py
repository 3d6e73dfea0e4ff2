"""SentencePiece encoding and decoding.

Texts are cut into words that no piece can straddle, and each distinct word is
encoded once: for a unigram model by a relational lattice, for a BPE model by
its merges.

The lattice: within a block of documents, the words' substrings are exploded,
joined to the piece table, grouped by word as edges, and folded by Viterbi's
rule with a higher-order aggregate.

Viterbi can't give a BPE model's result, as merges follow ranks, not sums of
scores. So BPE words are merged in the scanning tasks, many distinct words at
once in numpy, with no shuffle.
"""

from __future__ import annotations

import codecs
import functools
import heapq
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE_MARK = "▁"
#: Longest word of the native fold, whose state is the bits of one long.
LONGEST = 62
UNKNOWN_PENALTY = 10.0
#: Bytes of text that a unigram model's task is to hold.
BLOCK_BYTES = 32 << 20
UNKNOWN_SURFACE = " ⁇ "


@dataclass
class Model:
    """What encoding needs of a model file."""

    unigram: bool
    pieces: dict[str, tuple[int, float]]  # normal pieces: id, score
    names: list[str]
    kinds: list[int]
    unk: int
    byte_ids: list[int] = field(default_factory=list)  # empty without byte fallback
    prefix: bool = True

    @classmethod
    def load(cls, path: str) -> Model:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        return cls.of(proto)

    @classmethod
    def of(cls, proto) -> Model:
        spec, kind = proto.normalizer_spec, proto.trainer_spec.model_type
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that normalise by marking spaces are supported")
        if kind not in (1, 2):
            raise ValueError("only unigram and BPE models are supported")
        if any(p.type == 4 for p in proto.pieces):
            raise ValueError("user-defined symbols are not supported")
        normal = {p.piece: (i, p.score) for i, p in enumerate(proto.pieces) if p.type == 1}
        if any(not re.fullmatch(f"{SPACE_MARK}*[^{SPACE_MARK}]*", p) for p in normal):
            raise ValueError("a piece spans words")
        byte_ids = [i for i, p in enumerate(proto.pieces) if p.type == 6]
        unk = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        return cls(kind == 1, normal, [p.piece for p in proto.pieces], [p.type for p in proto.pieces], unk, byte_ids if proto.trainer_spec.byte_fallback else [], spec.add_dummy_prefix)

    @functools.cached_property
    def scores(self) -> dict[str, float]:
        return {p: s for p, (_, s) in self.pieces.items()}

    @functools.cached_property
    def longest(self) -> int:
        return max(map(len, self.pieces))

    @property
    def pattern(self) -> str:
        """Words: space marks and what follows. Line ends and tabs that are in no piece stand alone."""
        alone = "".join(c for c in "\t\n\r" if not any(c in p for p in self.pieces))
        return f"{SPACE_MARK}+[^{SPACE_MARK}{alone}]*|[^{SPACE_MARK}{alone}]+" + (f"|[{alone}]" if alone else "")

    def rows(self, spark: SparkSession) -> DataFrame:
        """The piece table. Its size is the vocabulary's."""
        return spark.createDataFrame([(p, i, float(s)) for p, (i, s) in self.pieces.items()], "piece string, id long, score double")

    def fallback(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode()] if self.byte_ids else [self.unk]

    def whole(self, word: str) -> list[int]:
        """The ids of any one word."""
        parts = best_path(word, self.pieces, self.longest) if self.unigram else merged(word, self.scores)
        return [i for p in parts for i in ([self.pieces[p][0]] if p in self.pieces else self.fallback(p))]


def merged(word: str, scores: dict[str, float]) -> list[str]:
    """BPE: the best pair of neighbours first, the leftmost on ties."""
    if len(word) > 64:
        return merged_long(word, scores)
    get, none = scores.get, -np.inf
    parts = list(word)
    pairs = [get(a + b, none) for a, b in zip(parts, parts[1:])]
    while pairs and (best := max(pairs)) > none:
        i = pairs.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], none)
    return parts


def merged_long(word: str, scores: dict[str, float]) -> list[str]:
    """The same by a heap, in time n log n."""
    parts, after, before = list(word), list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    heap: list[tuple] = []

    def offer(i: int) -> None:
        if 0 <= i and after[i] < len(word):
            p = parts[i] + parts[after[i]]
            if p in scores:
                heapq.heappush(heap, (-scores[p], i, p))

    for i in range(len(word) - 1):
        offer(i)
    while heap:
        _, i, p = heapq.heappop(heap)
        j = after[i]
        if not parts[i] or j >= len(word) or parts[i] + parts[j] != p:
            continue
        parts[i], parts[j], after[i] = p, "", after[j]
        if after[j] < len(word):
            before[after[j]] = i
        offer(before[i])
        offer(i)
    return [p for p in parts if p]


def best_path(word: str, pieces: dict[str, tuple[int, float]], longest: int) -> list[str]:
    """Unigram: the path of highest score. A character without a piece costs the penalty."""
    unknown = min(s for _, s in pieces.values()) - UNKNOWN_PENALTY
    best, back = [0.0] + [-np.inf] * len(word), [0] * (len(word) + 1)
    for e in range(1, len(word) + 1):
        for s in range(max(0, e - longest), e):
            p = pieces.get(word[s:e])
            score = p[1] if p else unknown if e - s == 1 else None
            if score is not None and best[s] + score > best[e]:
                best[e], back[e] = best[s] + score, s
    out, e = [], len(word)
    while e:
        out.append(word[back[e] : e])
        e = back[e]
    return out[::-1]


def packed_edge(s: Column, e: Column, i: Column) -> Column:
    """Start and end (6 bits each) and id (24) in one long."""
    return F.shiftleft(s.cast("long"), 30).bitwiseOR(F.shiftleft(e.cast("long"), 24)).bitwiseOR(i)


START = lambda x: F.shiftright(x, 30).bitwiseAND(F.lit(63)).cast("int")
END = lambda x: F.shiftright(x, 24).bitwiseAND(F.lit(63)).cast("int")
NO_ID = (1 << 24) - 1
ID = lambda x: x.bitwiseAND(F.lit(NO_ID)).cast("int")


def shift(x: Column, n: Column) -> Column:
    return F.call_function("shiftleft", x, n)


def inside(x: Column, bounds: Column) -> Column:
    """The boundaries strictly inside an edge."""
    one = F.lit(1).cast("long")
    span = shift(one, END(x)) - shift(one, START(x) + 1)
    return span.bitwiseAND(bounds)


def on(x: Column, bounds: Column) -> Column:
    """Whether both ends of an edge are boundaries."""
    return (F.getbit(bounds, START(x)) == 1) & (F.getbit(bounds, END(x)) == 1)


def symbol_ids(edges: Column, bounds: Column) -> Column:
    """The ids of the symbols between boundaries; null if one is in no piece (an unknown character)."""
    used = F.filter(edges, lambda x: on(x, bounds) & (inside(x, bounds) == 0) & (ID(x) < NO_ID))
    symbols = F.array_sort(F.transform(used, lambda x: F.struct(START(x).alias("s"), ID(x).alias("id"))))
    return F.when(F.size(used) == F.bit_count(bounds) - 1, F.transform(symbols, lambda x: x["id"]))


def viterbi_fold(edges: Column, scores: Column, n: Column) -> Column:
    """The ids of a word's best path. edges in order of end, scores beside them.

    The state has, by position, the best score so far and the boundaries of its
    path. A position between edges that no piece reaches is reached by an
    unknown character; those are edges too, so every position is reached.
    """
    one = F.lit(1).cast("long")
    cell = lambda score, bounds: F.struct(score.alias("score"), bounds.alias("bounds"))
    start = F.transform(F.sequence(F.lit(0), n), lambda p: cell(F.when(p == 0, F.lit(0.0)).otherwise(F.lit(float("-inf"))), F.when(p == 0, one).otherwise(F.lit(0).cast("long"))))

    def step(cells: Column, x: Column) -> Column:
        e = END(x["edge"])
        here, there = F.get(cells, e), F.get(cells, START(x["edge"]))
        score = there["score"] + x["score"]
        new = cell(score, there["bounds"].bitwiseOR(shift(one, e)))
        return F.when(score > here["score"], F.transform(cells, lambda c, p: F.when(p == e, new).otherwise(c))).otherwise(cells)

    return F.aggregate(F.arrays_zip(edges.alias("edge"), scores.alias("score")), start, step, lambda cells: symbol_ids(edges, F.get(cells, n)["bounds"]))


def lattice(words: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """words (keys, word, any_id) with ids; null for those with a symbol in no piece, which Model.whole encodes.

    keys and word must already be grouped together (words partitioned by keys),
    so no step here shuffles: the piece table is bounded by the vocabulary and
    broadcast.
    """
    spark = words.sparkSession
    short = words.filter(F.length("word") <= LONGEST)
    at = short.select(*keys, "word", "any_id", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("s"))
    cut = at.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(model.longest), F.length("word") - F.col("s")))).alias("n"))
    cut = cut.withColumn("piece", F.substring(F.col("word"), F.col("s") + 1, F.col("n")))
    unknown = min(s for _, s in model.pieces.values()) - UNKNOWN_PENALTY
    joined = cut.join(F.broadcast(model.rows(spark)), "piece", "left").filter(F.col("id").isNotNull() | (F.col("n") == 1))
    end = F.col("s") + F.col("n")
    edge = F.struct(end.alias("e"), packed_edge(F.col("s"), end, F.coalesce("id", F.lit(NO_ID))).alias("edge"), F.coalesce("score", F.lit(unknown)).alias("score"))
    grouped = joined.groupBy(*keys, "word").agg(F.first("any_id").alias("any_id"), F.sort_array(F.collect_list(edge)).alias("edges"))
    ids = viterbi_fold(F.col("edges.edge"), F.col("edges.score"), F.length("word"))
    return grouped.select(*keys, "word", "any_id", ids.alias("ids"))


class Merges:
    """BPE over many words at once: a row of symbols each, and in every round the best pair of each row is merged."""

    WIDEST = 64
    NONE = np.iinfo(np.int32).max

    def __init__(self, model: Model) -> None:
        self.model, size = model, len(model.names)
        alone = sorted({c for p in model.pieces for c in p} - model.pieces.keys())
        symbol = {p: i for p, (i, _) in model.pieces.items()} | {c: size + k for k, c in enumerate(alone)}
        self.size = size
        self.char = np.full(0x110000, -1, np.int32)
        for x, i in symbol.items():
            if len(x) == 1:
                self.char[ord(x)] = i
        rank = {s: k for k, s in enumerate(sorted({s for _, s in model.pieces.values()}, reverse=True))}
        pairs = [(symbol[p[:k]], symbol[p[k:]], rank[s], i) for p, (i, s) in model.pieces.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        left, right, ranks, made = np.array(pairs, np.int64).reshape(-1, 4).T
        order = np.argsort(self.key(left, right))
        self.keys, self.ranks, self.made = self.key(left, right)[order], ranks[order].astype(np.int32), made[order].astype(np.int32)

    @staticmethod
    def key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.int64) << 32) + right

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank (the least is best; NONE where no piece is made) and piece of neighbours."""
        key = self.key(left, right)
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        hit = self.keys[at] == key if len(self.keys) else np.zeros(key.shape, bool)
        return np.where(hit, self.ranks[at], self.NONE), self.made[at]

    def same_width(self, words: list[str]) -> list[bytes | None]:
        """Ids of words of WIDEST characters at most; None where a symbol is in no piece."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        wide = int(n.max())
        here = np.arange(wide) < n[:, None]
        grid = np.full((len(words), wide), -1, np.int32)
        grid[here] = self.char[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        rank, made = self.pairs(grid[:, :-1], grid[:, 1:])
        rank[grid[:, :-1] < 0] = self.NONE
        after, before = np.tile(np.arange(1, wide + 1), (len(words), 1)), np.tile(np.arange(-1, wide - 1), (len(words), 1))
        row = np.arange(len(words)) if wide > 1 else np.arange(0)
        while len(row):
            i = rank[row].argmin(axis=1)
            some = rank[row, i] < self.NONE
            row, i = row[some], i[some]
            j = after[row, i]
            k = after[row, j]
            grid[row, i], grid[row, j] = made[row, i], -1
            here[row, j] = False
            after[row, i] = k
            rank[row, i] = self.NONE
            right = k < n[row]
            rank[row[~right & (j < wide - 1)], j[~right & (j < wide - 1)]] = self.NONE
            r, x, y = row[right], i[right], k[right]
            before[r, y] = x
            rank[r, j[right]] = self.NONE
            rank[r, x], made[r, x] = self.pairs(grid[r, x], grid[r, y])
            left = before[row, i] >= 0
            r, y = row[left], i[left]
            x = before[r, y]
            rank[r, x], made[r, x] = self.pairs(grid[r, x], grid[r, y])
        known = ~(here & ((grid < 0) | (grid >= self.size))).any(axis=1)
        ends = np.cumsum(here.sum(axis=1)) * 4
        ids = grid[here].tobytes()
        return [ids[a:b] if ok else None for a, b, ok in zip([0, *ends.tolist()], ends.tolist(), known.tolist())]

    def __call__(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as 32-bit integers."""
        out: list[bytes | None] = [None] * len(words)
        for low, high in ((0, 12), (12, 24), (24, self.WIDEST)):
            some = [k for k, w in enumerate(words) if low < len(w) <= high]
            for at in range(0, len(some), 20_000):
                part = some[at : at + 20_000]
                for k, ids in zip(part, self.same_width([words[k] for k in part]), strict=True):
                    out[k] = ids
        return [array("i", self.model.whole(w)).tobytes() if ids is None else ids for w, ids in zip(words, out, strict=True)]


class Encoder:
    """Texts to ids by known words, in a task: new words of a few texts are encoded together, and known from then on, up to a bound."""

    def __init__(self, model: Model, at_most: int = 500_000) -> None:
        self.model, self.at_most = model, at_most
        self.word_of = re.compile(model.pattern)
        self.words: dict[str, bytes] = {}  # ids as 32-bit integers
        self.many = (lambda words: [array("i", model.whole(w)).tobytes() for w in words]) if model.unigram else Merges(model)

    def cut(self, text: str | None) -> list[str]:
        """A text's words, marked."""
        return self.word_of.findall((SPACE_MARK if self.model.prefix else "") + text.replace(" ", SPACE_MARK)) if text else []

    def __call__(self, texts: list[str | None]) -> pa.ListArray:
        if len(self.words) > self.at_most:
            self.words.clear()
        cut = [self.cut(t) for t in texts]
        known = self.words
        new = list({w for words in cut for w in words if w not in known})
        known.update(zip(new, self.many(new), strict=True))
        out = []
        for words in cut:
            ids = b"".join(map(known.__getitem__, words))
            if ids and not self.model.byte_ids:  # neighbouring unknown characters are one piece
                x = np.frombuffer(ids, dtype="<i4")
                ids = x[~((x == self.model.unk) & np.concatenate([[False], x[:-1] == self.model.unk]))].tobytes()
            out.append(ids)
        ends = np.cumsum([0, *map(len, out)]) // 4
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(out))]))


class Decoder:
    """Lists of ids to texts: all surfaces stand in one buffer, and a batch is one gather from it."""

    def __init__(self, model: Model) -> None:
        surface = []
        for name, kind in zip(model.names, model.kinds, strict=True):
            if kind == 6:
                surface.append(bytes([int(name[3:5], 16)]))
            else:
                surface.append({2: UNKNOWN_SURFACE, 3: ""}.get(kind, name.replace(SPACE_MARK, " ")).encode())
        self.prefix = model.prefix
        self.length = np.array([len(x) for x in surface], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(surface), np.uint8)

    def __call__(self, ids: pa.ListArray) -> pa.StringArray:
        """By the library's rules. A null list gives null."""
        offsets = ids.offsets.to_numpy().astype(np.int64)
        flat = np.asarray(ids.values)[offsets[0] : offsets[-1]]
        n = self.length[flat]
        ends = np.cumsum(n)
        out = self.bytes[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[flat] - (ends - n), n)]
        at = np.concatenate([[0], ends])[offsets - offsets[0]]
        if self.prefix:
            some = at[:-1][at[1:] > at[:-1]]
            dropped = some[out[some] == 32]
            out = np.delete(out, dropped)
            at = at - np.searchsorted(dropped, at)
        nulls = ids.is_null()
        if valid(out, at):
            mask = pa.array(np.packbits(~nulls.to_numpy(zero_copy_only=False), bitorder="little")).buffers()[1] if ids.null_count else None
            return pa.StringArray.from_buffers(len(ids), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(out), mask)
        codecs.register_error("each_byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))
        return pa.array([None if x else out[a:b].tobytes().decode(errors="each_byte") for a, b, x in zip(at[:-1], at[1:], nulls.to_pylist(), strict=True)], pa.string())


def valid(out: np.ndarray, at: np.ndarray) -> bool:
    """Whether every slice of out between neighbours in at is UTF-8: all of it is, and none begins within a character."""
    first = at[:-1][at[1:] > at[:-1]]
    if (out[first] & 0xC0 == 0x80).any():
        return False
    try:
        codecs.decode(memoryview(out), "utf-8")
    except UnicodeDecodeError:
        return False
    return True


def result(docs: pa.Table | pa.RecordBatch, encode: Encoder, decode: Decoder | None) -> pa.RecordBatch:
    """ids (and decoded) beside all columns of docs but its text."""
    ids = encode(docs.column("text").to_pylist())
    names = [c for c in docs.schema.names if c not in ("text", "block")]
    plain = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in map(docs.column, names)]
    made = {"ids": ids} | ({"decoded": decode(ids)} if decode else {})
    return pa.RecordBatch.from_arrays([*plain, *made.values()], names=[*names, *made])


def in_batches(model: Model, decode: bool):
    """For scanning tasks. Words stay known from batch to batch, up to a bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(model), Decoder(model) if decode else None
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                yield result(batch.slice(at, 200), encoder, decoder)

    return run


def in_block(model: Model, decode: bool):
    """For one block: its documents, and its words with their ids."""

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        lists = words.column("ids").combine_chunks()
        offsets, raw = lists.offsets.to_numpy() * 4, np.asarray(lists.values, dtype="<i4").tobytes()
        valid = lists.is_valid().to_pylist()
        encode = Encoder(model, at_most=1 << 62)
        encode.words = {w: raw[offsets[k] : offsets[k + 1]] for k, w in enumerate(words.column("word").to_pylist()) if valid[k]}
        return pa.Table.from_batches([result(docs, encode, Decoder(model) if decode else None)])

    return run


def encoded(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", blocks: int | None = None, carry: tuple[str, ...] = (), decode: bool = False) -> DataFrame:
    """Every row of docs: doc_id, text_sha256, the columns in carry, ids (array of int, as the library gives them), and with decode, the text that they decode to.

    For unigram models, a block is a share of the documents by hash, of some
    BLOCK_BYTES of text unless `blocks` gives their number; it is what one task
    holds. Their text is shuffled once: words and documents read the same exchange.
    Null or empty texts have no ids; repeated rows each have their own; a null id
    stays null. A doc_id that isn't a number of 64 bits raises an error.
    """
    plain = F.coalesce(docs[f"`{text}`"], F.lit(""))
    rows = docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), F.sha2(plain, 256).alias("text_sha256"), *[docs[f"`{c}`"] for c in carry], plain.alias("text"))
    kept = [f for f in rows.schema.fields if f.name != "text"]
    out = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "ids array<int>", *["decoded string" for _ in [decode] if decode]])
    if not model.unigram:
        return rows.mapInArrow(in_batches(model, decode), out)
    if blocks is None:
        blocks = 1 + (rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0) // BLOCK_BYTES
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).repartition(blocks, "block")
    marked = F.concat(F.lit(SPACE_MARK if model.prefix else ""), F.replace("text", F.lit(" "), F.lit(SPACE_MARK)))
    each = rows.select(F.col("block").alias("part"), *[f"`{f.name}`" for f in kept], F.explode(F.array_distinct(F.regexp_extract_all(marked, F.lit(f"({model.pattern})"), F.lit(1)))).alias("word"))
    # any_id is carried so that both sides read the same columns, and so one exchange.
    words = each.groupBy("part", "word").agg(F.max(F.struct(*[f"`{f.name}`" for f in kept])).alias("any_id"))
    ids = lattice(words, model, ["part"])
    return rows.groupBy("block").cogroup(ids.groupBy("part")).applyInArrow(in_block(model, decode), out)


def decoder(model: Model):
    """An Arrow UDF from ids to text, by the library's rules. Null stays null."""

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decode_ids = Decoder(model)
        for ids in batches:
            yield decode_ids(pa.concat_arrays([ids]) if ids.offset == 0 else pa.array(ids.to_pylist(), ids.type))

    return decode
