"""Near-duplicates by the Jaccard index of word shingles, with candidates from MinHash bands.

A text has a key for each band: the least values of a few hash functions over
its shingles. Texts that share a key are candidates; each candidate pair is held
to the exact index of its sets of 64-bit shingle hashes. With 24 bands of 4, a
pair with index 0.8 shares no key with a probability of 3.1e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fitted, staged, words
from .components import components
from .simhash import LOWER, UPPER, least_rows, marked, text_keys

BANDS, EACH = 24, 4
SEEDS = np.random.default_rng(42).integers(0, 1 << 63, (2, BANDS * EACH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def hashed_words(text: Column) -> Column:
    """The hashes of a text's words, after lower-casing A-Z."""
    return F.transform(words(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)), lambda w: F.xxhash64(w))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingled(lists: pa.ListArray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lists' shingles, repeats included, and where each list's begin (and the last end).

    A shingle is n words, or all of a text's where there are fewer.
    """
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = np.asarray(lists.values)[: offsets[-1]].astype(np.int64).view(np.uint64)
    size = np.diff(offsets)
    count = np.where(size > 0, np.maximum(size - n + 1, 1), 0)
    ends = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(ends[-1]) + np.repeat(offsets[:-1] - ends[:-1], count)
    last = np.repeat(offsets[1:], count)
    h = np.zeros(len(at), np.uint64)
    for k in range(n):
        here = at + k < last
        h[here] = mix(h[here] + flat[at[here] + k] + np.uint64(0x9E3779B97F4A7C15))
    return h, ends


def rebased(lists: pa.ListArray) -> pa.ListArray:
    """A slice of lists with values and offsets of its own."""
    offsets = lists.offsets.to_numpy()
    return pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), lists.flatten())


def in_slices(f, out: str):
    """mapInArrow by f(digests, word lists) in slices of a few texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                yield pa.RecordBatch.from_arrays([part.column(0), f(rebased(part.column(1)))], names=["digest", out])

    return run


def keys_of(n: int):
    def run(lists: pa.ListArray) -> pa.Array:
        h, ends = shingled(lists, n)
        some = np.diff(ends) > 0
        keys = np.zeros((int(some.sum()), BANDS), np.uint64)
        if len(h):
            for i in range(BANDS * EACH):
                least = np.minimum.reduceat(h * SEEDS[0, i] + SEEDS[1, i], ends[:-1][some])
                keys[:, i // EACH] = mix(keys[:, i // EACH] + least)
        bounds = np.concatenate([[0], np.cumsum(some * BANDS)])
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(keys.ravel().view(np.int64)))

    return run


def sets_of(n: int):
    def run(lists: pa.ListArray) -> pa.Array:
        h, ends = shingled(lists, n)
        sets = [np.unique(h[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)))

    return run


def alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Of pairs (u, v) of digests, those whose sets have a Jaccard index of at least `least`."""
    u, v = (sets.select(F.col("digest").alias(c), F.col("set").alias(f"{c}_")) for c in "uv")
    both = F.size(F.array_intersect("u_", "v_"))
    return pairs.join(u, "u").join(v, "v").filter(both >= least * (F.size("u_") + F.size("v_") - both)).select("u", "v")


def hubs_of(member: DataFrame, kept) -> DataFrame:
    """(t, k, a, b, hub) of the buckets with two digests or more: the least, the greatest, and the digest whose own buckets hold most in all.

    Of many copies with small changes, the hub is the text that they stem from, or that nearest to it.
    """
    sized = kept(member.groupBy("t", "k").agg(F.min("digest").alias("a"), F.max("digest").alias("b"), F.count(F.lit(1)).alias("n")).filter("a < b"), "buckets")
    within = member.join(sized, ["t", "k"])
    weight = kept(within.groupBy("digest").agg(F.sum("n").alias("weight")), "weights")
    best = within.select("t", "k", "digest").join(weight, "digest").groupBy("t", "k").agg(F.max(F.struct("weight", "digest")).alias("x"))
    return kept(sized.join(best.select("t", "k", F.col("x.digest").alias("hub")), ["t", "k"]).select("t", "k", "a", "b", "hub"), "hubs")


def own_shingles(sets: DataFrame) -> DataFrame:
    """(digest, own): how many of a set's shingles are in no other set. Sets without such have no row."""
    holders = sets.select("digest", F.explode("set").alias("h")).groupBy("h").agg(F.min("digest").alias("a"), F.max("digest").alias("b"))
    return holders.filter("a = b").groupBy(F.col("a").alias("digest")).agg(F.count(F.lit(1)).alias("own"))


def jaccard_roots(texts: DataFrame, known: DataFrame, n: int, least: float) -> DataFrame:
    """(node, root) for the digests that links connect: those known (u, v), and pairs of texts (digest, t_) with at least that index.

    Bucket members are first held against the bucket's least, greatest and hub.
    Then, in buckets that aren't of one component, members outside the least
    component are held against all of other components, but for pairs that can't
    reach the index: what two sets share is at most either's size less the
    shingles that only it has. A pair is taken in the first band that it shares.
    """
    hashed = texts.select("digest", hashed_words(F.col("t_")).alias("w_"))
    keys = staged(hashed.mapInArrow(in_slices(keys_of(n), "keys"), "digest long, keys array<long>"), "bands")
    rows = keys.count() * BANDS
    kept = lambda df, name: staged(fitted(df, rows), name)
    member = keys.select("digest", F.posexplode("keys").alias("t", "k"))
    ends = hubs_of(member, kept)
    member = kept(member.join(ends, ["t", "k"]).select("t", "k", "digest", "a", "b", "hub"), "members")
    pair = lambda x, y: (F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
    star = lambda end: member.filter(F.col("digest") != F.col(end)).select(*pair(F.col("digest"), F.col(end)))
    pairs = kept(star("a").union(star("b")).union(star("hub")).distinct(), "pairs")
    wanted = kept(member.select(F.col("digest").alias("d_")).distinct(), "wanted")
    some = texts.join(wanted, F.col("digest") == F.col("d_"), "left_semi").select("digest", hashed_words(F.col("t_")).alias("w_"))
    sets = some.mapInArrow(in_slices(sets_of(n), "set"), "digest long, set array<long>")
    sets = staged(sets.groupBy("digest").agg(F.first("set").alias("set")), "sets")
    edges = kept(known.union(kept(alike(pairs, sets, least), "links")).distinct(), "edges")
    roots = staged(components(edges), "roots").withColumnRenamed("node", "digest")
    found = member.select("t", "k", "digest").join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    found = kept(found, "known")
    mixed = kept(found.groupBy("t", "k").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a < b"), "mixed")
    mixed = kept(found.join(mixed, ["t", "k"]).select("t", "k", "digest", "root", "a"), "mixed")
    still = kept(mixed.select(F.col("digest").alias("d_")).distinct(), "still")
    open_sets = sets.join(still, F.col("digest") == F.col("d_"), "left_semi")
    own = kept(own_shingles(open_sets), "own").withColumnRenamed("digest", "o_")
    about = open_sets.join(own, F.col("digest") == F.col("o_"), "left").select(F.col("digest").alias("d_"), F.size("set").alias("size"), (F.size("set") - F.coalesce("own", F.lit(0))).alias("shared"))
    about = about.join(keys.dropDuplicates(["digest"]).withColumnRenamed("digest", "k_"), F.col("d_") == F.col("k_")).drop("k_")
    mixed = mixed.join(kept(about, "about"), F.col("digest") == F.col("d_")).drop("d_")
    # A row that shares less than the index of its own size has no partner at all.
    mixed = kept(mixed.filter(F.col("shared") >= least * F.col("size")), "open")
    x, y = mixed.filter("root > a").alias("x"), mixed.alias("y")
    enough = F.least("x.shared", "y.shared") * (1 + least) >= least * (F.col("x.size") + F.col("y.size"))
    first = F.array_position(F.zip_with("x.keys", "y.keys", lambda p, q: p == q), True) == F.col("x.t") + 1
    differ = (F.col("x.t") == F.col("y.t")) & (F.col("x.k") == F.col("y.k")) & (F.col("x.root") > F.col("y.root")) & enough & first
    rest = staged(x.join(y, differ).select(*pair(F.col("x.digest"), F.col("y.digest"))).distinct().join(pairs, ["u", "v"], "left_anti"), "rest")
    more = staged(alike(rest, sets, least), "more")
    return staged(components(edges.union(more)), "roots") if not more.isEmpty() else roots.withColumnRenamed("digest", "node")


def drop_alike(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, least: float = 0.8) -> DataFrame:
    """One row of docs for each component of near copies, with docs' columns.

    Near copies are texts with a Jaccard index of at least `least` over shingles
    of n words, and those that simhash.drop_near links (4-word shingles, 4 bits).
    Which row stays, and what odd rows give, is as there.
    """
    key = text_keys(docs, text)
    fps = marked(docs, doc_id, text, 4, 4, key)
    # The digests of one fingerprint's component hang on its least.
    hubs = staged(fps.groupBy("root").agg(F.min("digest").alias("v"), F.max("digest").alias("w")).filter("v < w").drop("w"), "hubs")
    known = staged(fps.join(hubs, "root").filter("digest > v").select(F.col("digest").alias("u"), "v").distinct(), "known")
    texts = docs.select(key(docs[f"`{text}`"]).alias("digest"), docs[f"`{text}`"].alias("t_"))
    roots = jaccard_roots(texts, known, n, least)
    out = fps.select("doc_id", "digest").join(roots, fps["digest"] == roots["node"], "left").select("doc_id", "digest", F.coalesce("root", "digest").alias("root"))
    return least_rows(docs, staged(out, "marked"), doc_id, text, key)
