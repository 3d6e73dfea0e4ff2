"""Near-duplicates by SimHash, with candidates from covering locality-sensitive hashing.

Each of the 64 bit positions gets a vector of radius + 1 bits. For every nonzero
vector v there is a table keyed by the bits whose vectors are not orthogonal to
v (over two elements). Up to `radius` differing positions leave some v orthogonal
to all their vectors, so two fingerprints within the radius share that table's
key: no pair is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fitted, packed, staged, unpacked, words
from .components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def masks(radius: int) -> list[int]:
    """The tables' bit masks, as signed 64-bit integers."""
    n = 1 << (radius + 1)
    vectors = [i % n for i in range(64)]  # all vectors equally often, as far as 64 allows
    out = []
    for v in range(1, n):
        m = sum(1 << i for i in range(64) if (vectors[i] & v).bit_count() % 2)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def fingerprints(rows: DataFrame, text: str, n: int, key: list[str]) -> DataFrame:
    """A row for each key of rows, with n_shingles and the fingerprint fp (long).

    Bits i and i + 32 are counted in the halves of one long, so that 32 sums do.
    """
    low = words(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER))
    w = F.col("w_")
    shingle = lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)])
    whole = F.when(F.size(w) > 0, F.array(F.concat_ws(" ", w)))
    some = F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), shingle)).otherwise(whole)
    df = rows.withColumn("w_", low).withColumn("s_", some)
    df = df.select(*key, F.explode_outer("s_").alias("s_")).withColumn("h_", F.when(F.col("s_").isNotNull(), F.xxhash64("s_")))
    pair = F.lit(0x0000000100000001)
    sums = df.groupBy(*key).agg(F.count("h_").alias("n_shingles"), *[F.coalesce(F.sum(F.shiftrightunsigned("h_", i).bitwiseAND(pair)), F.lit(0)).alias(f"b{i}") for i in range(32)])
    half = lambda c: c * 2 > F.col("n_shingles")
    bits = [half(F.col(f"b{i}").bitwiseAND(F.lit(0xFFFFFFFF))) for i in range(32)] + [half(F.shiftrightunsigned(f"b{i}", 32)) for i in range(32)]
    fp = F.lit(0).cast("long")
    for i, bit in enumerate(bits):
        fp = fp.bitwiseOR(F.when(bit, F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long"))
    return sums.select(*key, "n_shingles", fp.alias("fp"))


def apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def linked(fps: DataFrame, radius: int) -> DataFrame:
    """(fp, root) of distinct fingerprints fp: one root for all that links within the radius connect.

    First every member of a bucket is held against the bucket's least and
    greatest. That joins dense groups at a row or two a member, and buckets that
    lie in one component are done. In the others, members outside the bucket's
    least component are held against all; the join's condition holds the
    distance, so only true links come out of it.
    """
    rows = fps.count() * len(masks(radius))
    kept = lambda df, name: staged(fitted(df, rows), name)
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks(radius))])
    member = fps.select("fp", F.inline(tables))
    member = member.toDF("fp", "t", "k")
    ends = member.groupBy("t", "k").agg(F.min("fp").alias("a"), F.max("fp").alias("b"))
    ends = kept(ends.filter("a < b"), "buckets")
    member = kept(member.join(ends, ["t", "k"]), "members")
    star = lambda end: member.filter((F.col("fp") != F.col(end)) & (apart(F.col("fp"), F.col(end)) <= radius)).select(F.col("fp").alias("u"), F.col(end).alias("v"))
    first = kept(star("a").union(star("b")).distinct(), "links")
    roots = staged(components(first), "roots").withColumnRenamed("node", "fp")
    known = kept(member.select("t", "k", "fp").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "known")
    mixed = known.groupBy("t", "k").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a < b")
    mixed = kept(known.join(kept(mixed, "mixed"), ["t", "k"]), "mixed")
    x, y = mixed.filter("root > a").alias("x"), mixed.alias("y")
    differ = (F.col("x.t") == F.col("y.t")) & (F.col("x.k") == F.col("y.k")) & (F.col("x.root") > F.col("y.root")) & (apart(F.col("x.fp"), F.col("y.fp")) <= radius)
    more = x.join(y, differ).select(F.col("x.root").alias("u"), F.col("y.root").alias("v"))
    # What is left is a graph of components, which is far smaller.
    joined = staged(components(more), "joined").select(F.col("node").alias("root"), F.col("root").alias("last"))
    singles = fps.select("fp").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return singles.join(joined, "root", "left").select("fp", F.coalesce("last", "root").alias("root"))


def near_groups(rows: DataFrame, radius: int) -> DataFrame:
    """rows (doc_id, fp, ...) with component_id, the least doc_id reachable by links."""
    fps = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    rooted = staged(fps.join(linked(fps.select("fp"), radius), "fp"), "rooted")
    least = staged(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    groups = staged(rooted.join(least, "root").select(F.col("fp").alias("fp_"), "component_id"), "groups")
    return rows.join(groups, rows["fp"] == groups["fp_"]).drop("fp_")


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 4, radius: int = 4) -> DataFrame:
    """Every row of docs: doc_id, fingerprint (16 hex digits), n_shingles, component_id.

    Words are split at white space after lower-casing A-Z; shingles are n words,
    repeats included, or all words where there are fewer. A bit is set if it is
    in over half the shingles' XXH64 (seed 42). A null or wordless text has
    fingerprint zero, linked like any other. Rows that repeat a doc_id with the
    same text share a row's result; with different texts each keeps its own. A
    null doc_id is never a component's least id unless all its ids are null.
    """
    rows = docs.select(docs[f"`{doc_id}`"].alias("doc_id"), docs[f"`{text}`"].alias("t_"))
    # The text's digest and a row number within the task tell rows apart without a shuffle.
    rows = rows.withColumn("row_", F.monotonically_increasing_id())
    fps = staged(fingerprints(rows, "t_", n, ["row_", "doc_id"]), "simhash").drop("row_")
    out = near_groups(fps, radius)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "n_shingles", "component_id")


def least_rows(docs: DataFrame, marked: DataFrame, doc_id: str, text: str, key) -> DataFrame:
    """One row of docs for each root of marked (doc_id, digest, root; a row for each of docs).

    That is the row with the least id, null ids last, then the least digest; of
    full repeats (same id and text) the one whose contents' hash is least.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    first = staged(marked.groupBy("root").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "first")
    repeats = marked.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id", "digest", F.lit(False).alias("gone"))
    gone = marked.join(first.drop("n"), "root").filter(F.col("first") != order).select("doc_id", "digest", F.lit(True).alias("gone"))
    # Repeats that go are in both.
    marks = gone.union(repeats).groupBy(F.col("doc_id").alias("doc_id_"), F.col("digest").alias("digest_")).agg(F.max("gone").alias("gone_"))
    marks = staged(marks, "gone")
    rows = packed(docs, id_=docs[f"`{doc_id}`"], h_=key(docs[f"`{text}`"]))
    same = lambda m: (rows["h_"] == m["digest_"]) & rows["id_"].eqNullSafe(m["doc_id_"])
    out = rows.join(marks, same(marks), "left_anti").select("row")
    twice = marks.filter("not gone_")
    if not twice.isEmpty():
        again = rows.join(twice, same(twice), "left_semi").groupBy("id_", "h_").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        out = out.union(again.select("row"))
    return unpacked(out)


def digest(text: Column) -> Column:
    """A 64-bit hash of a text. Null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def second(text: Column) -> Column:
    """Another 64-bit hash, for texts that share a digest."""
    return F.xxhash64(F.lit("second"), F.coalesce(text, F.lit("")))


#: Digests of more than one text that can be told apart; some 17 are expected among 2.5e10 texts.
MOST_SHARED = 10_000


def text_keys(docs: DataFrame, text: str):
    """A function from a text to a 64-bit key that no two different texts of docs share.

    That is the digest; texts whose digest others have too, found by a pass over
    all texts, take their second hash. An error if keys still clash.
    """
    t = docs[f"`{text}`"]
    clashes = lambda first: docs.select(first(t).alias("d"), digest(t).alias("a"), second(t).alias("b")).groupBy("d").agg(*[f(c).alias(f"{n}_{c}") for c in "ab" for n, f in (("low", F.min), ("high", F.max))]).filter("low_a < high_a or low_b < high_b")
    shared = [r.d for r in clashes(digest).limit(MOST_SHARED + 1).collect()]
    if not shared:
        return digest
    key = lambda c: F.when(digest(c).isin(shared), second(c)).otherwise(digest(c))
    if len(shared) > MOST_SHARED or not clashes(key).isEmpty():
        raise RuntimeError("too many texts share their 64-bit hashes")
    return key


def marked(docs: DataFrame, doc_id: str, text: str, n: int, radius: int, key) -> DataFrame:
    """A row for each of docs: doc_id, digest (its text's key), and root, one of its component's fingerprints."""
    rows = docs.select(docs[f"`{doc_id}`"].alias("doc_id"), key(docs[f"`{text}`"]).alias("digest"), docs[f"`{text}`"].alias("t_"))
    rows = rows.withColumn("row_", F.monotonically_increasing_id())
    fps = staged(fingerprints(rows, "t_", n, ["row_", "doc_id", "digest"]), "simhash")
    roots = staged(linked(staged(fps.select("fp").distinct(), "fingerprints"), radius), "rooted")
    return staged(fps.select("doc_id", "digest", "fp").join(roots, "fp").drop("fp"), "marked")


def drop_near(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 4, radius: int = 4) -> DataFrame:
    """One row of docs for each component of linked fingerprints, with docs' columns.

    Rows are told apart by id and text. The least id stays; a null id only if
    all its component's ids are null. Rows that repeat an id with different texts
    are judged each by its own text; of an id's rows in one component that with
    the least digest stays, and of full repeats one.
    """
    key = text_keys(docs, text)
    return least_rows(docs, marked(docs, doc_id, text, n, radius, key), doc_id, text, key)
