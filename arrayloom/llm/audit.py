"""How quality filters interact in every order, by aggregating over the edges of the lattice of applied subsets.

A document meets a filter f after a set S of others has been applied; (S, f) is
an edge of the subset lattice, and five filters have 80 of them. An order of the
filters is a path of five edges from the empty set to all. So documents are
counted once on the edges, and every order's figures are sums along a path.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, words

FILTERS = "ABCDE"


def failures(docs: DataFrame, doc_id: str, text: str, part: str) -> DataFrame:
    """A row for each of docs: doc_id, part, fails (a bit for each filter, A lowest).

    Only ids, parts, bits and SHA-256 digests are written and joined, no texts.
    A null id copies nothing and is copied by nothing, and of rows that repeat
    an id none comes before another.
    """
    t = F.coalesce(docs[f"`{text}`"], F.lit(""))
    rows = docs.select(docs[f"`{doc_id}`"].alias("doc_id"), F.coalesce(docs[f"`{part}`"].cast("string"), F.lit("")).alias("part"), t.alias("t_"), words(t).alias("w_"))
    n = F.size("w_")
    # A run of other characters goes in one step of the pattern, so capitals are what is left.
    capitals = F.length(F.regexp_replace("t_", "[^A-Z]+", ""))
    tests = [n < 200, F.size(F.array_distinct("w_")) * 100 < n * 50, capitals * 100 > F.length("t_") * 2, F.col("t_").rlike("[#$%&*|]")]
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(tests)), F.lit(0))
    own = staged(rows.select("doc_id", "part", bits.alias("own_"), F.unhex(F.sha2("t_", 256)).alias("sha_")), "judged")
    # Texts of one row alone take no part in the join.
    copied = own.groupBy("sha_").agg(F.min("doc_id").alias("a_"), F.max("doc_id").alias("b_")).filter("a_ < b_").select("sha_", "a_")
    found = own.join(staged(copied, "copied"), "sha_", "left")
    return found.select("doc_id", "part", (F.col("own_") + F.when(F.col("doc_id") > F.col("a_"), 16).otherwise(0)).alias("fails"))


def edges(filters: int) -> list[tuple[int, int]]:
    """(applied, bit): every subset of the filters, with every filter outside it."""
    return [(s, 1 << f) for f in range(filters) for s in range(1 << filters) if not s >> f & 1]


def steps(names: str) -> list[tuple[str, int, int, int]]:
    """(filter_order, step, applied, bit) for all orders of the filters."""
    out = []
    for order in itertools.permutations(range(len(names))):
        applied = 0
        for k, f in enumerate(order):
            out.append(("".join(names[i] for i in order), k + 1, applied, 1 << f))
            applied |= 1 << f
    return out


def on_edges(judged: DataFrame, names: str = FILTERS) -> DataFrame:
    """For each part and edge, sums over judged(part, fails, good, toxic).

    Rows are counted by (part, fails, good, toxic) first, so what is exploded to
    edges is at most 4 * 2^filters rows a part, however many documents it has.
    """
    counts = judged.groupBy("part", "fails", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
    all_edges = F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(b).alias("bit")) for s, b in edges(len(names))])
    spread = counts.select("*", F.inline(all_edges))
    fails, applied, bit, n = F.col("fails"), F.col("applied"), F.col("bit"), F.col("n")
    before, now = fails.bitwiseAND(applied) != 0, fails.bitwiseAND(bit) != 0
    gone = now & ~before
    total = lambda when, name: F.sum(F.when(when, n).otherwise(F.lit(0).cast("long"))).alias(name)
    return spread.groupBy("part", "applied", "bit").agg(
        total(~before & ~now, "kept"), total(gone, "removed"), total(now & before, "redundant"), total(fails == bit, "unique_fails"), total(gone & F.col("good"), "good_lost"), total(gone & F.col("toxic"), "toxic_lost")
    )


def filter_audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """A row for each part, order of the five filters (filter_order) and step, with the counts at that step.

    Filters fail a text: A with under 200 words; B with distinct words under half
    of its words; C with capitals A-Z above a fiftieth of its code points; D with
    any of #$%&*|; E if a smaller doc_id has the same text, removed or not.
    shapley is what the step's filter removes, summed over all orders.

    A null text is empty, a null part is the empty string. An id counts as good
    (toxic) if any of its labels has quality 1 (toxic 1); ids without labels,
    null ids and labels without documents count as neither. An empty table gives
    no rows.
    """
    flag = lambda c: F.max(F.coalesce(labels[c] == 1, F.lit(False))).alias(f"{c}_")
    marks = labels.filter(labels["doc_id"].isNotNull()).groupBy(labels["doc_id"].alias("id_")).agg(flag("quality"), flag("toxic"))
    judged = failures(docs, doc_id, text, part).join(marks, F.col("doc_id") == F.col("id_"), "left")
    judged = judged.select("part", "fails", F.coalesce("quality_", F.lit(False)).alias("good"), F.coalesce("toxic_", F.lit(False)).alias("toxic"))
    counted = staged(on_edges(judged), "edges")
    paths = docs.sparkSession.createDataFrame(steps(FILTERS), "filter_order string, step int, applied int, bit int")
    # Every edge into a filter weighs as many orders as pass it; those sums are the paths' own.
    weight = paths.groupBy("applied", "bit").agg(F.count(F.lit(1)).alias("paths"))
    shapley = counted.join(weight, ["applied", "bit"]).groupBy("part", "bit").agg(F.sum(F.col("removed") * F.col("paths")).alias("shapley"))
    return counted.join(paths, ["applied", "bit"]).join(shapley, ["part", "bit"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
