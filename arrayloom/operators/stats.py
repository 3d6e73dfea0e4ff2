"""Histograms, information measures, covariance, PCA and classification metrics."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import vectors as V
from ..functions.storage import staged


def bin_of(x: Column, width: float, bins: int, signed: bool = False) -> Column:
    """floor(x / width), clamped: to the last bin, or if signed to -bins..bins and moved to 0..2 bins."""
    b = F.floor(x / width)
    if signed:
        return (F.greatest(F.lit(-bins), F.least(b, F.lit(bins))) + bins).cast("long")
    return F.least(b, F.lit(bins - 1)).cast("long")


def packed_bins(bins: Column, base: int, n: int) -> Column:
    """Groups of n bins as digits of one number, the first the lowest."""
    groups = F.sequence(F.lit(0), F.floor((F.size(bins) - 1) / n).cast("int"))
    part = lambda g: F.slice(bins, g * n + 1, F.lit(n))
    return F.transform(groups, lambda g: F.aggregate(F.reverse(part(g)), F.lit(0).cast("long"), lambda s, b: s * base + b))


def histogram(df: DataFrame, vec: Column, width: float, bins: int, keys: tuple[str, ...] = (), pack: int = 0) -> DataFrame:
    """Counts by the vector of bins: keys, bin (array<long>), n. Partial sums come before the shuffle."""
    b = F.transform(vec, lambda x: bin_of(x, width, bins))
    if pack:
        b = packed_bins(b, bins, pack)
    return df.select(*keys, b.alias("bin")).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))


def merge_bins(hist: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Histograms summed bin by bin."""
    return hist.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))


def marginal(hist: DataFrame, dims: list[int], keys: tuple[str, ...] = ()) -> DataFrame:
    """The histogram of some dimensions."""
    kept = F.array(*[F.get("bin", d) for d in dims])
    return merge_bins(hist.select(*keys, kept.alias("bin"), "n"), keys)


def entropy(hist: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, h: the entropy in nats, from counts in one aggregate: ln N - sum(n ln n) / N."""
    n = F.col("n").cast("double")
    return hist.groupBy(*keys).agg((F.log(F.sum(n)) - F.sum(n * F.log(n)) / F.sum(n)).alias("h"))


def conditional_entropy(hist: DataFrame, dims: list[int]) -> DataFrame:
    """H(all) - H(dims)."""
    a, b = entropy(hist), entropy(marginal(hist, dims)).withColumnRenamed("h", "hd")
    return a.crossJoin(b).select((F.col("h") - F.col("hd")).alias("h"))  # one row each


def mutual_information(hist: DataFrame, dims: list[int], n_dims: int) -> DataFrame:
    """H(dims) + H(the rest) - H(all)."""
    rest = [d for d in range(n_dims) if d not in dims]
    parts = [entropy(marginal(hist, dims)).select("h"), entropy(marginal(hist, rest)).select("h"), entropy(hist).select((-F.col("h")).alias("h"))]
    return reduce(DataFrame.union, parts).agg(F.sum("h").alias("mi"))


def fixed_histogram(df: DataFrame, x: str, width: float, bins: int) -> DataFrame:
    """Counts of floor(x / width) + bins / 2 in 0..bins-1; others are left out."""
    b = (F.floor(F.col(x) / width) + bins // 2).cast("long")
    return df.select(b.alias("bin")).filter(F.col("bin").between(0, bins - 1)).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def moments(df: DataFrame, x: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean, population and sample variance, range."""
    return df.groupBy(*keys).agg(F.avg(x).alias("mean"), F.var_pop(x).alias("var_pop"), F.var_samp(x).alias("var_samp"), F.min(x).alias("lo"), F.max(x).alias("hi"))


def elements(df: DataFrame, vec: str, keys: tuple[str, ...]) -> DataFrame:
    """A row for each element: keys, i, v."""
    return df.select(*keys, F.posexplode(F.col(vec).cast("array<double>")).alias("i", "v"))


def vector_mean(df: DataFrame, vec: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, mean (array): element-wise means."""
    m = elements(df, vec, keys).groupBy(*keys, "i").agg(F.avg("v").alias("m"))
    return m.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))


def feature_bounds(df: DataFrame, vec: str) -> DataFrame:
    """By element: ranges for means (min / 4, max / 4) and variances (var / 2, 10 var)."""
    return elements(df, vec, ()).groupBy("i").agg((F.min("v") / 4).alias("mu_lo"), (F.max("v") / 4).alias("mu_hi"), (F.var_pop("v") / 2).alias("var_lo"), (F.var_pop("v") * 10).alias("var_hi"))


def covariance(df: DataFrame, vec: str, n: int) -> DataFrame:
    """(i, j, c) of the population covariance, i <= j.

    Each task sums its batches' outer products about a common shift (a rough
    mean, so that no digits are lost), and gives n rows; Spark adds them.
    """
    shift = df.select(F.col(vec).cast("array<double>").alias("v")).limit(100).collect()
    about = np.mean([r.v for r in shift], axis=0) if shift else np.zeros(n)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, first, second = 0, np.zeros(n), np.zeros((n, n))
        for b in batches:
            if len(b):
                x = np.stack(b["v"].to_list()) - about
                rows, first, second = rows + len(x), first + x.sum(axis=0), second + x.T @ x
        if rows:
            yield pd.DataFrame({"i": np.arange(n), "rows": rows, "a": first, "b": [first] * n, "ab": list(second)})

    parts = df.select(F.col(vec).cast("array<double>").alias("v")).mapInPandas(run, "i int, rows long, a double, b array<double>, ab array<double>")
    # Every cell is a row, so Spark adds before and after the shuffle.
    cells = parts.select("i", "rows", "a", F.posexplode(F.arrays_zip("b", "ab")).alias("j", "z")).filter("j >= i")
    sums = cells.groupBy("i", "j").agg(F.sum("rows").alias("rows"), F.sum("a").alias("a"), F.sum("z.b").alias("b"), F.sum("z.ab").alias("ab"))
    return sums.select("i", "j", (F.col("ab") / F.col("rows") - F.col("a") / F.col("rows") * F.col("b") / F.col("rows")).alias("c"))


def as_matrix(cov: DataFrame, n: int) -> np.ndarray:
    """The small symmetric matrix of covariance(), on the driver: n squared numbers."""
    out = np.zeros((n, n))
    for r in cov.collect():
        out[r.i, r.j] = out[r.j, r.i] = r.c
    return out


def pca(df: DataFrame, vec: str, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, the k leading components as rows (largest coordinate positive), and their variances.

    The covariance is summed by Spark; only its n x n matrix reaches the driver.
    """
    values, rows = np.linalg.eigh(as_matrix(covariance(df, vec, n), n))
    order = np.argsort(values)[::-1][:k]
    rows = rows.T[order]
    rows *= np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(axis=1)])[:, None]
    mean = np.array(vector_mean(df, vec).first()["mean"])
    return mean, rows, values[order]


def singular_values(variances: np.ndarray, n_rows: int) -> np.ndarray:
    """Singular values of the centred data matrix."""
    return np.sqrt(np.maximum(variances, 0) * n_rows)


def triangle(df: DataFrame, vec: str, n: int, fan: int = 32) -> np.ndarray:
    """R (n x n) of the QR decomposition of all rows, by a tree of factors.

    A task keeps the factor of its rows so far; `fan` factors are then merged by
    one task at a time until one is left. Singular values of R are those of the
    rows, and no product of the data with itself squares their condition.
    """

    def factors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = np.zeros((0, n))
        for b in batches:
            if len(b):
                r = np.linalg.qr(np.vstack([r, np.stack(b["v"].to_list())]), mode="r")
        if len(r):
            yield pd.DataFrame({"r": [r.ravel()]})

    def merged(parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"r": [np.linalg.qr(np.vstack([x.reshape(-1, n) for x in parts["r"]]), mode="r").ravel()]})

    level = staged(df.filter(F.col(vec).isNotNull()).select(F.col(vec).cast("array<double>").alias("v")).mapInPandas(factors, "r array<double>"), "factors")
    count = level.count()
    while count > 1:
        groups = -(-count // fan)
        at = F.pmod(F.xxhash64("r"), F.lit(groups)) if groups > 1 else F.lit(0)
        level = staged(level.groupBy(at.alias("g")).applyInPandas(merged, "r array<double>"), "factors")
        count = level.count()
    out = np.zeros((n, n))
    if count:
        r = np.array(level.first()["r"]).reshape(-1, n)
        out[: len(r)] = r
    return out


def svd_components(df: DataFrame, vec: str, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, the k leading right singular vectors of the centred rows (largest coordinate positive), and their singular values."""
    mean = np.array(vector_mean(df.filter(F.col(vec).isNotNull()), vec).first()["mean"])
    centred = F.zip_with(F.col(vec).cast("array<double>"), F.array(*map(F.lit, mean.tolist())), lambda x, m: x - m)
    _, values, rows = np.linalg.svd(triangle(df.select(centred.alias("centred_")), "centred_", n))
    rows = rows[:k] * np.sign(rows[np.arange(k), np.abs(rows[:k]).argmax(axis=1)])[:, None]
    return mean, rows, values[:k]


def at_ranks(df: DataFrame, value: str, ranks: list[int], keys: tuple[str, ...] = (), held: int = 1000) -> DataFrame:
    """keys, rank, value: the rank-th smallest value (from 1) of each group, exactly, without a sort of the rows.

    Approximate percentiles give bounds about each wanted rank; counts below and
    within them narrow them until few distinct values are left, which are
    counted. Two or three passes are usual; each shuffles a few numbers a group.
    Nulls have no rank; a rank beyond a group's rows gives no row.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v_"))
    on = list(keys) or ["all_"]
    rows = rows if keys else rows.withColumn("all_", F.lit(0))
    ends = rows.groupBy(*on).agg(F.min("v_").alias("low"), F.max("v_").alias("high"), F.count(F.lit(1)).alias("n"))
    todo = staged(ends.select(*on, "low", "high", F.explode(F.array(*[F.lit(r).cast("long") for r in ranks])).alias("rank"), "n").filter("rank between 1 and n").withColumn("left", F.col("rank")), "bounds")
    names = [*on, "low", "high", "rank", "n", "left"]
    while not todo.filter((F.col("n") > held) & (F.col("low") < F.col("high"))).isEmpty():
        # Rows between the bounds of a group's ranks; a rank's place in them is `left`.
        inside = rows.join(todo, on).filter(F.col("v_").between(F.col("low"), F.col("high")))
        cut = F.percentile_approx("v_", F.array(*[F.lit(i / 64) for i in range(65)]), F.lit(1000))
        cuts = staged(inside.groupBy(*names).agg(cut.alias("cuts")), "cuts")
        # How many rows lie below and at each cut, so exact counts choose the next bounds.
        found = rows.join(cuts, on).filter(F.col("v_").between(F.col("low"), F.col("high"))).withColumn("slot", F.size(F.filter("cuts", lambda c: c < F.col("v_"))))
        slots = found.groupBy(*names, "slot").agg(F.count(F.lit(1)).alias("m"), F.min("v_").alias("a"), F.max("v_").alias("b"))
        run = F.sum("m").over(W.partitionBy(*on, "rank").orderBy("slot"))
        picked = slots.withColumn("upto", run).filter((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("m") < F.col("left")))
        todo = staged(picked.select(*on, F.col("a").alias("low"), F.col("b").alias("high"), "rank", F.col("m").alias("n"), (F.col("left") - F.col("upto") + F.col("m")).alias("left")), "bounds")
    last = rows.join(todo, on).filter(F.col("v_").between(F.col("low"), F.col("high"))).groupBy(*on, "rank", "left", "v_").agg(F.count(F.lit(1)).alias("m"))
    upto = F.sum("m").over(W.partitionBy(*on, "rank").orderBy("v_"))
    out = last.withColumn("upto", upto).filter((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("m") < F.col("left")))
    return out.select(*keys, "rank", F.col("v_").alias("value"))


def project(vec: Column, mean: list[float], rows: list[list[float]]) -> Column:
    """(v - mean) times each component."""
    centred = F.zip_with(vec, F.array(*map(F.lit, mean)), lambda x, m: x - m)
    return F.array(*[V.dot(centred, F.array(*map(F.lit, r))) for r in rows])


def accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Percent of rows whose rounded labels agree."""
    same = F.bround(F.col(truth), 0) == F.bround(F.col(predicted), 0)
    return df.agg((F.avg(same.cast("double")) * 100).alias("accuracy"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """truth, predicted, share: the dense square of labels from least to greatest, by row; null rows where no truth is."""
    t, p = F.col(truth).cast("int"), F.col(predicted).cast("int")
    counts = df.select(t.alias("truth"), p.alias("predicted")).groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))
    ends = counts.agg(F.least(F.min("truth"), F.min("predicted")).alias("a"), F.greatest(F.max("truth"), F.max("predicted")).alias("b"))
    labels = ends.select(F.explode(F.sequence("a", "b")).alias("truth"), "a", "b").select("truth", F.explode(F.sequence("a", "b")).alias("predicted"))
    total = F.sum(F.coalesce("n", F.lit(0))).over(W.partitionBy("truth"))
    return labels.join(counts, ["truth", "predicted"], "left").select("truth", "predicted", F.when(total > 0, F.coalesce("n", F.lit(0)) / total).alias("share"))


def majority(df: DataFrame, keys: list[str], vote: str) -> DataFrame:
    """keys, winner: the vote of more than half the rows; null without one."""
    n = df.groupBy(*keys, F.col(vote).alias("winner")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*keys).agg(F.sum("n").alias("all"), F.max(F.struct("n", "winner")).alias("x")).select(*keys, F.when(F.col("x.n") * 2 > F.col("all"), F.col("x.winner")).alias("winner"))


def radial_profile(df: DataFrame, cy: float, cx: float) -> DataFrame:
    """By id and whole radius: summed values."""
    r = F.floor(F.sqrt(F.pow(F.col("y") - cy, F.lit(2)) + F.pow(F.col("x") - cx, F.lit(2)))).cast("int")
    return df.groupBy("id", r.alias("r")).agg(F.sum("v").alias("s"))
