"""K-means, VLAD, Gaussian mixtures and Fisher vectors over bags of vectors.

Models are small tables (k rows), broadcast to points. Points are rows
(id, point, vec); training loops over Spark aggregates, with only models on the
driver and each round's input staged or read anew.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V


def centers_table(spark: SparkSession, centers: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centers)], "k int, center array<double>")


def literal(m: np.ndarray) -> Column:
    """A small matrix or vector as a constant."""
    return F.array(*[literal(r) if np.ndim(r) else F.lit(float(r)) for r in m])


def distances(vec: Column, centers: Column) -> Column:
    """[(d2, k)] to each center."""
    return F.transform(centers, lambda c, k: F.struct(V.squared_distance(vec, c).alias("d2"), k.alias("k")))


def assigned(df: DataFrame, centers: np.ndarray, vec: str = "vec") -> DataFrame:
    """df with k and d2: the nearest center, the lowest index on ties. No shuffle."""
    best = F.array_min(distances(F.col(vec), literal(centers)))
    return df.withColumn("a_", best).withColumns({"k": F.col("a_.k"), "d2": F.col("a_.d2")}).drop("a_")


def cluster_stats(df: DataFrame, vec: str = "vec") -> tuple[DataFrame, DataFrame]:
    """Of assigned rows: (k, size, distortion), and (k, i, m) element-wise means."""
    sizes = df.groupBy("k").agg(F.count(F.lit(1)).alias("size"), F.sum("d2").alias("distortion"))
    means = df.select("k", F.posexplode(F.col(vec).cast("array<double>")).alias("i", "v")).groupBy("k", "i").agg(F.avg("v").alias("m"))
    return sizes, means


def soft_assignment(vec: Column, centers: np.ndarray) -> Column:
    """max(0, mean d2 - d2) to each center, over length."""
    d = F.transform(distances(vec, literal(centers)), lambda s: s["d2"])
    mean = V.total(d) / len(centers)
    raw = F.transform(d, lambda x: F.greatest(F.lit(0.0), mean - x))
    return V.l2_unit(raw)


def drawn(seed: int, vec: str = "vec") -> Column:
    """A number in (0, 1) from the hash of a vector and the seed."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), vec), 11) + 0.5) / float(1 << 53)


def kmeans(df: DataFrame, k: int, seed: int = 1, threshold: float = 1e-3, rounds: int = 50, vec: str = "vec", kept=None) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd's centers and their sizes. An error if there are fewer points than centers.

    Seeds are drawn in turn with probability by squared distance from those
    before, by exponential draws in Spark, so one row reaches the driver each
    time. A draw depends on the seed and the vector alone, never on partitions;
    equal vectors draw alike. An empty cluster takes the point farthest from its center.
    Stops when the distortion changes by less than threshold of itself, or is 0.
    With kept (sources.models.Rounds) every round is written, and training goes
    on from the last whole one: the end is the same as without a stop.
    """
    rows = df.select(F.col(vec).cast("array<double>").alias("vec"))
    done = kept.last() if kept else None
    if done:
        start, (centers, last) = done[0], done[1]
        return _lloyd(rows, centers, float(last), start, threshold, rounds, kept)
    if rows.limit(k).count() < k:
        raise ValueError("there are fewer points than clusters")
    centers = np.array([rows.agg(F.min_by("vec", F.struct(drawn(seed), "vec")).alias("v")).first()["v"]])
    for n in range(1, k):
        far = assigned(rows, centers)
        w = -F.log(drawn(seed + n)) / F.when(F.col("d2") > 0, F.col("d2"))
        pick = far.agg(F.min_by("vec", F.when(w.isNotNull(), F.struct(w, "vec"))).alias("v"), F.max_by("vec", F.struct("d2", "vec")).alias("f")).first()
        centers = np.vstack([centers, pick.v or pick.f])
    return _lloyd(rows, centers, math.inf, 0, threshold, rounds, kept)


def _lloyd(rows: DataFrame, centers: np.ndarray, last: float, start: int, threshold: float, rounds: int, kept) -> tuple[np.ndarray, np.ndarray]:
    """Rounds from number `start` on; a round of that number has its centers and the distortion before them."""
    k, sizes = len(centers), np.zeros(len(centers))
    for number in range(start, max(rounds, start + 1)):
        if kept and (number > start or not number):
            kept.keep(number, (centers, np.array(last)))
        now = assigned(rows, centers)
        means = now.select("k", "d2", F.posexplode("vec").alias("i", "v")).groupBy("k", "i").agg(F.avg("v").alias("m"), F.count(F.lit(1)).alias("n"), F.sum("d2").alias("s")).collect()
        sizes, distortion, new = np.zeros(k), 0.0, centers.copy()
        for r in means:
            new[r.k, r.i] = r.m
            if r.i == 0:
                sizes[r.k], distortion = r.n, distortion + r.s
        if not distortion or abs((last - distortion) / distortion) < threshold:
            break
        for e in np.flatnonzero(sizes == 0):
            new[e] = now.agg(F.max_by("vec", F.struct("d2", "vec")).alias("f")).first().f
        centers, last = new, distortion
    return centers, sizes


def bag_sums(df: DataFrame, value: Column, keys: list[str], vec: str) -> DataFrame:
    """keys, k, i, s: value (of element v, index i) summed over a bag's points."""
    return df.select(*keys, "k", F.posexplode(vec).alias("i", "v"), *[c for c in df.columns if c not in (*keys, "k", vec)]).groupBy(*keys, "k", "i").agg(F.sum(value).alias("s"))


def flat_vectors(sums: DataFrame, keys: list[str], n: int) -> DataFrame:
    """keys, vec: (index j, s) rows as vectors of n values, 0 where there is none."""
    m = sums.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("j", "s"))).alias("m"))
    return m.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.coalesce(F.try_element_at("m", j), F.lit(0.0))).alias("vec"))


def power_normalised(df: DataFrame, keys: list[str]) -> DataFrame:
    """Signed roots, over length; zero vectors stay."""
    rooted = df.select(*keys, V.signed_root(F.col("vec")).alias("vec"))
    return rooted.withColumn("length", V.norm(F.col("vec"))).select(*keys, V.scaled(F.col("vec"), F.col("length")).alias("vec"))


def vlad(df: DataFrame, centers: np.ndarray, keys: list[str], vec: str = "vec") -> DataFrame:
    """By bag: summed residuals from the nearest centers, signed roots, over length."""
    dims = centers.shape[1]
    near = assigned(df.select(*keys, F.col(vec).cast("array<double>").alias("vec")), centers)
    residual = F.zip_with("vec", F.get(literal(centers), F.col("k")), lambda x, c: x - c)
    sums = near.select(*keys, "k", F.posexplode(residual).alias("i", "r")).groupBy(*keys, (F.col("k") * dims + F.col("i")).alias("j")).agg(F.sum("r").alias("s"))
    return power_normalised(flat_vectors(sums, keys, centers.size), keys)


def log_densities(vec: Column, w: np.ndarray, mu: np.ndarray, var: np.ndarray) -> Column:
    """[ln(w_k N(vec; mu_k, var_k))] of a diagonal mixture."""
    parts = []
    for k in range(len(w)):
        log_norm = math.log(w[k]) - 0.5 * float(np.sum(np.log(2 * math.pi * var[k])))
        d = F.zip_with(F.zip_with(vec, literal(mu[k]), lambda x, m: (x - m) * (x - m)), literal(var[k]), lambda q, s: q / s)
        parts.append(F.lit(log_norm) - 0.5 * V.total(d))
    return F.array(*parts)


def responsibilities(df: DataFrame, w: np.ndarray, mu: np.ndarray, var: np.ndarray, vec: str = "vec") -> DataFrame:
    """df with a (shares of components) and ll (the log density). Densities stand over the greatest, so far points don't underflow."""
    out = df.withColumn("d_", log_densities(F.col(vec).cast("array<double>"), w, mu, var)).withColumn("top_", F.array_max("d_"))
    out = out.withColumn("e_", F.transform("d_", lambda x: F.exp(x - F.col("top_")))).withColumn("t_", V.total(F.col("e_")))
    return out.withColumn("a", F.transform("e_", lambda x: x / F.col("t_"))).withColumn("ll", F.col("top_") + F.log("t_")).drop("d_", "top_", "e_", "t_")


def average_log_likelihood(df: DataFrame) -> DataFrame:
    """From responsibilities(): the mean log density."""
    return df.agg(F.avg("ll").alias("avg_ll"))


def em_sums(df: DataFrame, vec: str = "vec") -> DataFrame:
    """(k, i, n, s1, s2): by component and element, summed shares and their first two moments."""
    by = df.select(F.posexplode("a").alias("k", "r"), F.col(vec).cast("array<double>").alias("vec")).select("k", "r", F.posexplode("vec").alias("i", "x"))
    x, r = F.col("x"), F.col("r")
    return by.groupBy("k", "i").agg(F.sum(r).alias("n"), F.sum(r * x).alias("s1"), F.sum(r * x * x).alias("s2"))


def em_step(df: DataFrame, w: np.ndarray, mu: np.ndarray, var: np.ndarray, vec: str = "vec") -> DataFrame:
    """One round: (k, i, weight, mu, var), variances about the new means, weights over their sum."""
    s = em_sums(responsibilities(df, w, mu, var, vec), vec)
    m = F.col("s1") / F.col("n")
    total = df.count()
    return s.select("k", "i", (F.col("n") / total).alias("weight"), m.alias("mu"), (F.col("s2") / F.col("n") - m * m).alias("var"))


def gmm(df: DataFrame, k: int, seed: int = 1, threshold: float = 1e-4, rounds: int = 50, floor: float = 1e-6, vec: str = "vec", kept=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A diagonal mixture by EM: weights, means, variances. Empty or collapsed components are drawn anew, by seed and round.

    Stops at a relative change of the likelihood below threshold; a round that
    lowers it gives the model before. kept is as in kmeans().
    """
    rng = np.random.default_rng(seed)
    bounds = df.select(F.posexplode(F.col(vec).cast("array<double>")).alias("i", "v")).groupBy("i").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.var_pop("v").alias("var")).orderBy("i").collect()
    lo, hi, v = (np.array([r[c] for r in bounds]) for c in ("lo", "hi", "var"))
    draw = lambda n: (rng.uniform(lo, hi, (n, len(lo))), np.tile(np.maximum(v, floor), (n, 1)))
    w = rng.uniform(1, 1000, k)
    model = (w / w.sum(), *draw(k))
    last, before, start = -math.inf, model, 0
    done = kept.last() if kept else None
    if done:
        start, (*arrays, seen) = done
        model, before, last = tuple(arrays[:3]), tuple(arrays[3:]), float(seen)
    for number in range(start, rounds):
        if kept and (number > start or not number):
            kept.keep(number, (*model, *before, np.array(last)))
        rng = np.random.default_rng((seed, number))
        # One pass: every row's log density rides along with its sums.
        shares = responsibilities(df, *model, vec)
        by = shares.select("ll", F.posexplode("a").alias("k", "r"), F.col(vec).cast("array<double>").alias("vec")).select("ll", "k", "r", F.posexplode("vec").alias("i", "x"))
        r, x = F.col("r"), F.col("x")
        got = by.groupBy("k", "i").agg(F.sum(r).alias("n"), F.sum(r * x).alias("s1"), F.sum(r * x * x).alias("s2"), F.sum("ll").alias("ll"), F.count(F.lit(1)).alias("rows")).collect()
        total = max((g["rows"] for g in got), default=0)
        ll = got[0].ll / total if got and math.isfinite(got[0].ll) else -math.inf
        if ll < last:
            return before
        if math.isfinite(last) and abs((ll - last) / ll) < threshold:
            break
        before, last = model, ll
        w, mu, var = np.zeros(k), np.full((k, len(lo)), math.nan), np.full((k, len(lo)), math.nan)
        for g in got:
            w[g.k] = g.n / total
            if g.n > 0:
                mu[g.k, g.i], var[g.k, g.i] = g.s1 / g.n, g.s2 / g.n - (g.s1 / g.n) ** 2
        bad = ~np.isfinite(mu).all(1) | (w <= 0) | (np.nan_to_num(var) <= floor / 1e4).all(1)
        mu[bad], var[bad] = draw(int(bad.sum()))
        w[bad] = 1 / k
        model = (w / w.sum(), mu, np.maximum(var, floor))
    return model


def fisher_vectors(df: DataFrame, w: np.ndarray, mu: np.ndarray, var: np.ndarray, keys: list[str], vec: str = "vec") -> DataFrame:
    """By bag: gradients by means, then by variances, each over root(N w), with signed roots, over length."""
    dims = mu.shape[1]
    r = responsibilities(df.select(*keys, F.col(vec).cast("array<double>").alias("vec")), w, mu, var)
    rows = r.select(*keys, "vec", F.posexplode("a").alias("k", "r")).select(*keys, "k", "r", F.posexplode("vec").alias("i", "x"))
    m, s2, wk = F.get(F.get(literal(mu), F.col("k")), F.col("i")), F.get(F.get(literal(var), F.col("k")), F.col("i")), F.get(literal(w), F.col("k"))
    g = rows.groupBy(*keys, "k", "i").agg(F.sum("r").alias("n"), F.sum(F.col("r") * F.col("x")).alias("s1"), F.sum(F.col("r") * F.col("x") * F.col("x")).alias("s2"))
    count = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("points"))
    g = g.join(count, keys)
    by_mean = (F.col("s1") - m * F.col("n")) / s2 * F.sqrt(s2 / (F.col("points") * wk))
    by_var = ((F.col("s2") - 2 * m * F.col("s1") + m * m * F.col("n")) / s2 - F.col("n")) * F.sqrt(F.lit(0.5) / (F.col("points") * wk))
    at = F.col("k") * dims + F.col("i")
    sums = g.select(*keys, F.inline(F.array(F.struct(at.alias("j"), by_mean.alias("s")), F.struct((at + mu.size).alias("j"), by_var.alias("s")))))
    return power_normalised(flat_vectors(sums, keys, 2 * mu.size), keys)


def layered_fisher_vectors(layers: list[DataFrame], models: list[tuple], keys: list[str], vec: str = "vec") -> DataFrame:
    """By bag: each layer's Fisher vector (over its length), end to end. A bag without points in a layer has zeros there."""
    parts = None
    for n, (df, (w, mu, var)) in enumerate(zip(layers, models, strict=True)):
        v = fisher_vectors(df, w, mu, var, keys, vec).select(*keys, F.lit(n).alias("layer"), "vec")
        parts = v if parts is None else parts.union(v)
    by = parts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("layer", "vec"))).alias("m"))
    each = [F.coalesce(F.try_element_at("m", F.lit(n)), F.array_repeat(F.lit(0.0), 2 * mu.size)) for n, (_, mu, _) in enumerate(models)]
    return by.select(*keys, F.flatten(F.array(*each)).alias("vec"))
