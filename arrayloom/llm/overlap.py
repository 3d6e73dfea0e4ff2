"""Jaccard links between sets of word shingles, by a token-group matrix.

Distinct sets are dealt into groups of similar ones, by common keys and by the
links found within these. A group keeps the union of its tokens; a set's
overlap with a group's union bounds its overlap with every member, so only
groups whose bound reaches the threshold are opened, and tasks then hold their
members against the queries by products of incidence matrices. All bounds are
exact: no link between different sets is lost.

Sets that can't have a partner leave early. A set of n tokens with an index of
`least` percent to another lacks at most (100 - least)% of n there, so one with
more tokens of its own than that is alone; a quarter of all tokens, chosen by
hash and the same for all, is enough to see this of most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, staged
from .components import components
from .shingles import hashed_words, mix, rebased, shingled

#: Tokens below this hash, a quarter of them, are the sample for the first screening.
SAMPLE = 1 << 62
#: Keys by which similar sets are grouped: the least hashes at or above two of BOUNDS each. They steer the work, and decide nothing.
KEYS = 8
BOUNDS = np.arange(2 * KEYS, dtype=np.uint64) * np.uint64((1 << 64) // (2 * KEYS))
#: A group is split so that a task holds some so many sets and tokens at once.
MEMBERS, TOKENS = 256, 500_000
#: Columns of an incidence matrix that are multiplied at once.
COLUMNS = 4096


def list_array(flat: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat.view(np.int64)))


def slices(batch: pa.RecordBatch, n: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """A batch in slices of a few texts, with each text's sorted distinct shingle hashes. The word hashes are the last column."""
    for i in range(0, batch.num_rows, 200):
        part = batch.slice(i, 200)
        h, ends = shingled(rebased(part.column(batch.num_columns - 1)), n)
        yield part, [np.unique(h[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def joined(sets: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.empty(0, np.uint64), *sets])


def sketch(n: int):
    """mapInArrow over (doc_id, tkey, word hashes): each text's set by size, digest, group keys and sampled tokens.

    mark is the digest's first half, by which sets are told apart in the first screening.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in slices(batch, n):
                sizes = np.array([len(s) for s in sets])
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                marks = np.frombuffer(b"".join(digests), np.int64)[::2]
                some = sizes > 0
                # Least hashes from each bound on, round to the first where there are none.
                ends = np.array([s[np.searchsorted(s, BOUNDS) % len(s)] for s in sets if len(s)], np.uint64).reshape(-1, KEYS, 2)
                keys = mix(mix(ends[:, :, 0]) + ends[:, :, 1])
                sample = [s[: np.searchsorted(s, np.uint64(SAMPLE))] for s in sets]
                columns = [part.column(0), part.column(1), pa.array(sizes), pa.array(digests, pa.binary()), pa.array(marks), list_array(keys.ravel(), some * KEYS), list_array(joined(sample), np.array([len(s) for s in sample]))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tkey", "size", "digest", "mark", "keys", "sample"])

    return run


SKETCH = "doc_id long, tkey long, size long, digest binary, mark long, keys array<long>, sample array<long>"


def whole_sets(n: int):
    """mapInArrow over word hashes: digest and tokens of each text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in slices(batch, n):
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), list_array(joined(sets), np.array([len(s) for s in sets]))], names=["digest", "tokens"])

    return run


def may_lack(size, least: int):
    """Tokens that a set may have beside those it shares with a partner."""
    return (size * (100 - least)) / 100


def own_tokens(rows: DataFrame, key: str, tokens: str) -> DataFrame:
    """(key, own): how many of its tokens no other key has. Keys without such have no row."""
    held = rows.select(key, F.explode(tokens).alias("token")).groupBy("token").agg(F.min(key).alias(key), F.max(key).alias("other"))
    return held.filter(F.col(key) == F.col("other")).groupBy(key).agg(F.count(F.lit(1)).alias("own"))


def not_alone(sketches: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """The nodes that aren't seen to be without a partner by the sample of their tokens.

    Tokens that only one mark has are counted for it. Should two sets share a
    mark, neither leaves.
    """
    same = nodes.groupBy("mark").agg(F.count(F.lit(1)).alias("same"))
    seen = nodes.join(own_tokens(sketches, "mark", "sample"), "mark", "left").join(same, "mark")
    return seen.filter((F.coalesce("own", F.lit(0)) <= may_lack(F.col("size"), least)) | (F.col("same") > 1)).drop("own", "same", "mark")


def leaders(nodes: DataFrame) -> DataFrame:
    """(node, label): the label of a node's group is that set, of those with which it shares a key, that shares most keys with others.

    Of many copies with small changes it is the text that they stem from, or that nearest to it. Nodes without common keys are their own groups.
    """
    member = nodes.select("node", F.posexplode("keys").alias("t", "k"))
    buckets = staged(member.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    within = staged(member.join(buckets, ["t", "k"]), "within")
    weight = staged(within.groupBy("node").agg(F.sum("n").alias("weight")), "weights")
    heaviest = within.join(weight, "node").groupBy("t", "k").agg(F.max(F.struct("weight", "node")).alias("x"))
    led = within.join(staged(heaviest, "heaviest"), ["t", "k"]).groupBy("node").agg(F.max("x").alias("x"))
    return nodes.select("node").join(led, "node", "left").select("node", F.coalesce("x.node", "node").alias("label"))


def dealt(labelled: DataFrame) -> DataFrame:
    """labelled(node, label, size) with chunk and parts: groups split so that a task can hold a chunk."""
    groups = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    groups = groups.select("label", (1 + F.greatest(F.expr(f"n div {MEMBERS}"), F.expr(f"s div {TOKENS}"))).alias("parts"))
    return labelled.join(staged(groups, "groups"), "label").withColumn("chunk", F.pmod(F.xxhash64("node"), "parts"))


class Incidence:
    """Which of some sets hold which tokens of their union."""

    def __init__(self, lists: pa.ChunkedArray, union: np.ndarray | None = None) -> None:
        arrays = [np.asarray(s.values).view(np.uint64) for s in lists]
        self.size = np.array([len(a) for a in arrays], np.int64)
        row, flat = np.repeat(np.arange(len(arrays)), self.size), joined(arrays)
        if union is None:
            self.union, self.column, self.row = *np.unique(flat, return_inverse=True), row
        else:
            self.union, at = union, np.searchsorted(union, flat)
            held = union[np.minimum(at, len(union) - 1)] == flat if len(union) else np.zeros(len(flat), bool)
            self.column, self.row = at[held], row[held]
        order = np.argsort(self.column, kind="stable")
        self.column, self.row = self.column[order], self.row[order]

    def block(self, begin: int) -> np.ndarray:
        a, b = np.searchsorted(self.column, [begin, begin + COLUMNS])
        out = np.zeros((len(self.size), min(COLUMNS, len(self.union) - begin)), np.float32)
        out[self.row[a:b], self.column[a:b] - begin] = 1
        return out

    def alike(self, other: Incidence, least: int) -> np.ndarray:
        """A boolean matrix of the pairs of own and other's sets (over the same union) with that index."""
        both = np.zeros((len(self.size), len(other.size)), np.float32)  # exact below 2^24
        for begin in range(0, len(self.union), COLUMNS):
            x = self.block(begin)
            both += x @ (x if other is self else other.block(begin)).T
        both = both.astype(np.int64)
        return 100 * both >= least * (self.size[:, None] + other.size[None, :] - both)


EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def within_chunk(least: int):
    """applyInArrow over a chunk (node, tokens): each member's edge to the first of those that links connect it with."""

    def run(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        x = Incidence(table.column("tokens"))
        near = x.alike(x, least)
        todo, edges = np.ones(len(node), bool), []
        for i in range(len(node)):
            if not todo[i]:
                continue
            reached, front = np.zeros(len(node), bool), near[i]
            while (front & ~reached).any():
                new, reached = front & ~reached, reached | front
                front = near[new].any(0)
            todo &= ~reached
            edges.append(np.stack([node[reached], np.full(int(reached.sum()), node[i])]))
        u, v = np.concatenate(edges, axis=1) if edges else np.empty((2, 0), np.int64)
        return pa.table({"u": u[u != v], "v": v[u != v]}, schema=EDGE)

    return run


def across(least: int):
    """Cogrouped: members and queries (node, root, tokens) of an opened chunk: each query's edge to one member of each other root that it links to."""

    def run(members: pa.Table, queries: pa.Table) -> pa.Table:
        x = Incidence(members.column("tokens"))
        q = Incidence(queries.column("tokens"), x.union)
        roots, its = members.column("root").to_numpy(), queries.column("root").to_numpy()
        i, j = np.nonzero(q.alike(x, least) & (its[:, None] != roots[None, :]))
        _, first = np.unique(np.stack([i, roots[j]]), axis=1, return_index=True)
        i, j = i[first], j[first]
        return pa.table({"u": queries.column("node").to_numpy()[i], "v": members.column("node").to_numpy()[j]}, schema=EDGE)

    return run


def grouped_links(sets: DataFrame, labels: DataFrame, least: int) -> DataFrame:
    """Edges that connect what links connect within each chunk of a group; the group's leader is a guest in all of its chunks."""
    at = staged(dealt(labels), "dealt")
    guests = at.filter("node <> label").groupBy("label", "parts").agg(F.count(F.lit(1)).alias("n"))
    guests = guests.select(F.col("label").alias("node"), "label", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("chunk"))
    led = staged(at.filter("label <> node").select("label").distinct(), "led")
    own = at.join(led, "label", "left_semi").select("node", "label", "chunk")
    places = staged(own.union(guests).distinct(), "places")
    return places.join(sets.select("node", "tokens"), "node").groupBy("label", "chunk").applyInArrow(within_chunk(least), EDGE_DDL)


EDGE_DDL = "u long, v long"


def foreign(tokens: DataFrame) -> DataFrame:
    """(node, shared): how many of a set's tokens sets of another root hold too. Sets without such have no row."""
    common = tokens.groupBy("token").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a < b").select("token")
    return tokens.join(common, "token", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("shared"))


def still_open(sets: DataFrame, places: DataFrame, least: int, sample: bool) -> DataFrame:
    """The places of sets that may have a partner of another root, by all of their tokens or by the sample."""
    some = F.filter("tokens", lambda t: (t >= 0) & (t < SAMPLE)) if sample else F.col("tokens")
    held = sets.select("node", some.alias("tokens")).join(places, "node").select("node", "root", "size", "family", "tokens")
    seen = held.select("node", "root", "size", "family", F.size("tokens").alias("held")).join(foreign(held.select("node", "root", F.explode("tokens").alias("token"))), "node", "left")
    return seen.filter(F.col("held") - F.coalesce("shared", F.lit(0)) <= may_lack(F.col("size"), least)).drop("held", "shared")


def matrix_links(sets: DataFrame, places: DataFrame, least: int) -> DataFrame:
    """Edges for all links between sets of different roots, one at least for each set and root that it is the query for.

    places(node, root, size, family) holds the components so far and the groups.
    Of a pair of two groups the smaller set (either, if equal) is the query: it
    lacks at most n (100 - least) / (100 + least) of its n tokens in the other.
    So of any one more of its tokens than that, one is in its partner's group;
    the query's rarest are taken, and the groups that hold one are its
    candidates. A candidate whose union lacks more of the query's tokens isn't
    opened. Its own group is opened for a set that isn't in the largest component there.
    """
    for sample in (True, False):
        places = staged(still_open(sets, places, least, sample), "open")
    tokens = staged(sets.select("node", "tokens").join(places, "node").select("node", "size", "family", F.explode("tokens").alias("token")), "tokens")
    groups = tokens.groupBy("token", "family").agg(F.min("size").alias("s0"), F.max("size").alias("s1"))
    groups = staged(groups.withColumnRenamed("family", "into"), "matrix")  # a row for each token of each group's union
    spread = groups.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    lacks = F.expr(f"size * {100 - least} div {100 + least}")
    ranked = tokens.join(spread, "token").withColumn("rank", F.expr("row_number() over (partition by node order by n, token)"))
    probes = ranked.filter((F.col("rank") <= lacks + 1) & (F.col("n") > 1)).select("node", "family", "size", F.col("token").alias("token_"))
    fits = (F.col("s1") >= F.col("size")) & (F.col("s0") * least <= F.col("size") * 100) & (F.col("into") != F.col("family"))
    candidates = staged(probes.join(groups, (F.col("token") == F.col("token_")) & fits).select("node", "into").distinct(), "candidates")
    bound = candidates.join(tokens.select("node", "size", "token"), "node").join(groups.select("token", "into"), ["token", "into"])
    others = bound.groupBy("node", "into", "size").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("size") - F.col("shared") <= lacks)
    roots = places.groupBy("family", "root").agg(F.count(F.lit(1)).alias("n"))
    largest = roots.groupBy(F.col("family").alias("family_")).agg(F.max(F.struct("n", "root")).alias("x"))
    own = places.join(largest, (F.col("family") == F.col("family_")) & (F.col("root") != F.col("x.root"))).select("node", F.col("family").alias("into"))
    opened = staged(others.select("node", "into").union(own), "opened")
    # An opened group is dealt in chunks, and one with many queries to several tasks a chunk.
    sized = opened.join(places.select("node", "size"), "node").groupBy("into").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    blocks = sized.select("into", (1 + F.greatest(F.expr(f"n div {MEMBERS}"), F.expr(f"s div {TOKENS}"))).alias("blocks"))
    chunks = dealt(places.select("node", "size", F.col("family").alias("label"))).join(blocks, F.col("label") == F.col("into"))
    chunks = staged(chunks.select("node", "into", "parts", "chunk", "blocks"), "chunks")
    split = chunks.groupBy("into", "parts", "blocks").agg(F.count(F.lit(1)).alias("members")).drop("members")
    full = staged(sets.select("node", "tokens").join(places.select("node", "root"), "node"), "full")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    members = full.join(chunks, "node").select("into", "chunk", every("blocks").alias("block"), "node", "root", "tokens")
    queries = opened.join(full, "node").join(split, "into").select("into", every("parts").alias("chunk"), F.pmod(F.xxhash64("node"), "blocks").alias("block"), "node", "root", "tokens")
    queries = queries.toDF(*queries.columns)  # names of their own, as both sides come from one table
    key = ("into", "chunk", "block")
    return members.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(across(least), EDGE_DDL)


def ngram_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 4, least: int = 85) -> DataFrame:
    """Every row of docs: doc_id, n_shingles, component_id, by links of sets with 100 * intersection >= least * union.

    Words are split at white space after lower-casing A-Z; a set holds the
    distinct shingles of n words, or all words as one where there are fewer. A
    null, empty or wordless text has no shingles and links with nothing, not even
    its like: component_id is its own doc_id. Equal sets are one node, however
    many rows have it, so repeated rows share a result; rows that repeat an id
    with different texts each have their own. component_id is the least doc_id
    reachable; a null id only if all are null. An empty table gives no rows.
    Shingles are held as 64-bit hashes, sets as 128-bit digests of these.
    """
    id_, t = docs[f"`{doc_id}`"].cast("long"), docs[f"`{text}`"]
    tkey = F.xxhash64(F.coalesce(t, F.lit("")))
    rows = docs.select(id_.alias("doc_id"), tkey.alias("tkey"), hashed_words(t).alias("w_"))
    sketches = staged(rows.mapInArrow(sketch(n), SKETCH), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey")).alias("first")
    nodes = sketches.filter("size > 0").groupBy("digest", "size", "mark").agg(first, F.first("keys").alias("keys"), F.count(F.lit(1)).alias("n"))
    nodes = staged(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    some = staged(not_alone(sketches, nodes, least), "some")
    every = staged(sketches.select("doc_id", "size", "digest"), "rows")
    dropped(sketches)
    # One row holds each set whose tokens are wanted, so copies don't meet in a task. Both sides are dealt by the key, as neither is small at scale.
    wanted = staged(some.select(F.col("first.doc_id").alias("d_"), F.col("first.tkey").alias("k_"), F.col("digest").alias("g_"), "node"), "wanted")
    texts = docs.select(id_.alias("doc_id"), tkey.alias("tkey"), t.alias("t_"))
    texts = texts.join(wanted.hint("merge"), (F.col("tkey") == F.col("k_")) & F.col("doc_id").eqNullSafe(F.col("d_")), "left_semi").select(hashed_words(F.col("t_")).alias("w_"))
    found = texts.mapInArrow(whole_sets(n), "digest binary, tokens array<long>").groupBy("digest").agg(F.first("tokens").alias("tokens"))
    sets = staged(found.join(wanted, found["digest"] == wanted["g_"]).select("node", "tokens"), "sets")
    near = some.join(own_tokens(sets, "node", "tokens"), "node", "left").filter(F.coalesce("own", F.lit(0)) <= may_lack(F.col("size"), least)).drop("own")
    near = staged(near, "near")
    labels = staged(leaders(near).join(near.select("node", "size"), "node"), "labels")
    edges = staged(grouped_links(sets, labels, least).distinct(), "edges")
    roots = staged(components(edges), "roots")
    led = labels.filter("node <> label").select(F.col("node").alias("u"), F.col("label").alias("v"))
    families = components(edges.union(led)).withColumnRenamed("root", "family")
    places = near.select("node", "size").join(roots, "node", "left").join(families, "node", "left")
    places = staged(places.select("node", F.coalesce("root", "node").alias("root"), "size", F.coalesce("family", "node").alias("family")), "places")
    more = staged(matrix_links(sets, places, least).distinct(), "more")
    if not more.isEmpty():
        roots = staged(components(edges.union(more)), "roots")
    rooted = nodes.select("node", "digest", F.col("first.doc_id").alias("least")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = staged(rooted.join(ids, "root").select(F.col("digest").alias("digest_"), "component_id"), "named")
    out = every.join(named, F.col("digest") == F.col("digest_"), "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
