"""Document quality rules with verdicts by host, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, packed, staged, unpacked, words

WINDOW = 8


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs (columns `row` and the text) with the base measures of each text.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.
    Windows of eight words are compared by their 64-bit hashes within one text.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    df = docs.withColumn("w_", words(F.col(text))).withColumn("lines_", lines)
    w = F.col("w_")
    window = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])
    df = df.withColumn("h_", F.when(F.size(w) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), window)))
    repeats = F.size(F.array_distinct("h_")) < F.size("h_")
    pairs = F.array_sort(F.transform("h_", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # Texts without a repeated window (most) skip the sort.
    df = df.withColumn("p_", F.when(repeats, pairs))
    p = F.col("p_")
    twice = lambda x, k: (F.get(p, k - 1)["h"] == x["h"]) | (F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False)))
    at = F.array_sort(F.transform(F.filter(p, lambda x, k: F.coalesce(twice(x, k), F.lit(False))), lambda x: x["i"]))
    covered = F.aggregate(
        at,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda s, i: F.struct((s["n"] + i + WINDOW - F.greatest(s["end"], i)).alias("n"), (i + WINDOW).alias("end")),
        lambda s: s["n"],
    )
    long = lambda c: c.cast("long")
    df = df.withColumns({
        "words_": long(F.size(w)),
        "word_chars": long(F.length(t) - F.regexp_count(t, F.lit(SPACE))),
        "n_symbols": long(F.regexp_count(t, F.lit("[#*$%&|<>]"))),
        "n_dup_lines": long(F.size("lines_") - F.size(F.array_distinct("lines_"))),
    })
    # A generator, as filters aren't pushed below it: inlined into a filter, p_ would be made anew for each window.
    tested = F.struct(F.col("words_").alias("n_words"), long(F.when(p.isNull(), 0).otherwise(covered)).alias("n_repeat_words"))
    df = df.select("*", F.inline(F.array(tested))).drop("w_", "lines_", "h_", "p_", "words_")
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return df.withColumn("base_failed", failed)


def host_verdicts(scored: DataFrame, max_rate: float, prior_docs: float) -> DataFrame:
    """A row per host: its documents, failures, shrunk failure rate and verdict.

    The hosts' rates give a beta prior by moments: mean m, variance v, weight
    m(1-m)/v - 1 documents. Where that isn't positive (one host, equal rates),
    the prior weighs prior_docs documents. A host is rejected if its shrunk rate
    (failed + m * weight) / (docs + weight) exceeds max_rate.
    """
    hosts = staged(scored.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed")), "hosts")
    rate = F.col("host_failed") / F.col("host_docs")
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_samp(rate).alias("v"))
    weight = F.when(F.col("v") > 0, F.greatest(F.col("m") * (1 - F.col("m")) / F.col("v") - 1, F.lit(0.0)))
    prior = prior.select("m", F.when(weight > 0, weight).otherwise(F.lit(float(prior_docs))).alias("weight"))
    m, k = prior.select("m").scalar(), prior.select("weight").scalar()
    shrunk = (F.col("host_failed") + m * k) / (F.col("host_docs") + k)
    return hosts.withColumn("host_rate", shrunk).withColumn("host_rejected", F.col("host_rate") > max_rate)


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = 0.5, prior_docs: float = 100.0, keep_text: bool = True) -> DataFrame:
    """Every row of docs as the struct `row`, with its measures and verdict.

    If keep_text is false, rows come without their text, and measures are taken
    once and staged, a small table. Otherwise they are taken twice, for hosts
    and for rows, as a staged table would hold all texts.

    Measures are those of measured(); kept is false if base_failed or if the
    host's shrunk failure rate exceeds max_rate. A null text is empty (so it
    fails); a null host is a host of its own; repeated rows are judged alike and
    all count; an empty table gives no rows.
    """
    rows = packed(docs, t_=docs[f"`{text}`"], host=docs[f"`{host}`"])
    if not keep_text:
        rows = rows.withColumn("row", F.struct(*[F.col("row")[c].alias(c) for c in docs.columns if c != text]))
    scored = measured(rows, "t_").drop("t_")
    if not keep_text:
        scored = staged(scored, "quality")
    verdicts = host_verdicts(scored, max_rate, prior_docs).withColumnRenamed("host", "h_")
    out = scored.join(verdicts, scored["host"].eqNullSafe(verdicts["h_"]), "left").drop("h_")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def keep_good(docs: DataFrame, **rules) -> DataFrame:
    """The rows of docs that quality_rules() keeps, with docs' columns."""
    return unpacked(quality_rules(docs, **rules).filter("kept"))
