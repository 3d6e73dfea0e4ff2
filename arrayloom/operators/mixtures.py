"""Mixtures of probabilistic PCA, per-feature Gaussian mixtures, and their Fisher vectors.

Rows are read in Arrow batches, which give sums of sufficient statistics; Spark
adds those, and the driver holds models alone (k x d x q numbers).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import encoders
from .classifiers import sums


@dataclass(frozen=True)
class Ppca:
    """weight, mean (d), loadings (d x q) and noise variance."""

    weight: float
    mu: np.ndarray
    w: np.ndarray
    noise: float

    def inner(self) -> np.ndarray:
        """M = noise I + W'W."""
        return self.noise * np.eye(self.w.shape[1]) + self.w.T @ self.w

    def latent(self, x: np.ndarray) -> np.ndarray:
        """inverse M W'(x - mu), for rows x."""
        return (x - self.mu) @ self.w @ np.linalg.inv(self.inner()).T

    def log_density(self, x: np.ndarray) -> np.ndarray:
        """Of rows, with the constant of (2 pi)^(d / 2) left out."""
        d, q = self.w.shape
        m, z = self.inner(), x - self.mu
        u = z @ self.w
        quad = ((z * z).sum(1) - (u @ np.linalg.inv(m) * u).sum(1)) / self.noise
        return -0.5 * (quad + (d - q) * math.log(self.noise) + np.linalg.slogdet(m)[1])


def shares(model: list[Ppca], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Responsibilities (rows x components) and log densities of rows."""
    ld = np.stack([math.log(m.weight) + m.log_density(x) for m in model], axis=1)
    top = ld.max(axis=1, keepdims=True)
    p = np.exp(ld - top)
    return p / p.sum(axis=1, keepdims=True), (top[:, 0] + np.log(p.sum(axis=1)))


def train_mppca(df: DataFrame, d: int, k: int, q: int, seed: int = 1, threshold: float = 1e-4, rounds: int = 30, vec: str = "vec") -> list[Ppca]:
    """EM until the average likelihood changes by less than threshold of itself, or for `rounds`."""
    rng = np.random.default_rng(seed)
    rows = df.select(F.col(vec).alias("x_"), F.lit(0.0).alias("y_"))
    bounds = df.select(F.posexplode(F.col(vec).cast("array<double>")).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("i").collect()
    mean, spread = np.array([b.m for b in bounds]), np.array([b.s for b in bounds])
    model = [Ppca(1 / k, mean + rng.normal(size=d) * spread, rng.normal(size=(d, q)) * spread[:, None] * 0.1, float((spread**2).mean()) + 1e-6) for _ in range(k)]
    size, last = 1 + d + d * d, -math.inf
    for _ in range(rounds):

        def f(x: np.ndarray, _: np.ndarray, model: list[Ppca] = model) -> np.ndarray:
            r, ll = shares(model, x)
            parts = [np.concatenate([[r[:, j].sum()], r[:, j] @ x, ((x * r[:, j, None]).T @ x).ravel()]) for j in range(k)]
            return np.concatenate([*parts, [ll.sum(), len(x)]])

        got = sums(rows, f, k * size + 2, "x_", "y_")
        ll, n = got[-2] / got[-1], got[-1]
        if abs(ll - last) < threshold * abs(ll):
            break
        last, new = ll, []
        for j, m in enumerate(model):
            s = got[j * size : (j + 1) * size]
            if s[0] < 1e-6:
                new.append(Ppca(1e-6, mean + rng.normal(size=d) * spread, m.w, m.noise))
                continue
            mu = s[1 : 1 + d] / s[0]
            cov = s[1 + d :].reshape(d, d) / s[0] - np.outer(mu, mu)
            values, axes = np.linalg.eigh(cov)
            noise = max(float(values[: d - q].mean()), 1e-9) if q < d else 1e-9
            new.append(Ppca(s[0] / n, mu, axes[:, -q:] * np.sqrt(np.maximum(values[-q:] - noise, 1e-12)), noise))
        total = sum(m.weight for m in new)
        model = [Ppca(m.weight / total, m.mu, m.w, m.noise) for m in new]
    return model


def mppca_fisher(df: DataFrame, model: list[Ppca], vec: str = "vec", keys: str = "id") -> DataFrame:
    """By bag (one key column): latent positions summed by share, scaled by the root of M, over root(N weight), signed roots, over length."""
    roots = [np.linalg.cholesky(m.inner()) for m in model]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = np.stack(b["x"].to_list())
            r, _ = shares(model, x)
            z = np.concatenate([r[:, j, None] * (m.latent(x) @ roots[j]) / math.sqrt(m.weight) for j, m in enumerate(model)], axis=1)
            part = pd.DataFrame(z).groupby(b["key"].to_numpy()).sum()
            counts = b.groupby("key").size()
            yield pd.DataFrame({"key": part.index, "n": counts.loc[part.index].to_numpy(), "z": list(part.to_numpy())})

    sums_ = df.select(F.col(keys).cast("long").alias("key"), F.col(vec).cast("array<double>").alias("x")).mapInPandas(run, "key long, n long, z array<double>")
    each = sums_.select("key", "n", F.posexplode("z").alias("j", "s")).groupBy("key", "j").agg((F.sum("s") / F.sqrt(F.sum("n"))).alias("s"))
    return encoders.power_normalised(encoders.flat_vectors(each, ["key"], sum(m.w.shape[1] for m in model)), ["key"])


def feature_mixtures(df: DataFrame, k: int, seed: int = 1, rounds: int = 50, threshold: float = 1e-4, vec: str = "vec") -> DataFrame:
    """A 1-D mixture for each element: (feature, k, weight, mu, variance), all by one EM over Spark aggregates.

    A round is one pass: responsibilities of every element's value, and their
    sums by element and component. Empty components are drawn anew.
    """
    spark, rng = df.sparkSession, np.random.default_rng(seed)
    x = df.select(F.posexplode(F.col(vec).cast("array<double>")).alias("feature", "x"))
    b = x.groupBy("feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.var_pop("x").alias("var"), F.count(F.lit(1)).alias("n")).orderBy("feature").collect()
    lo, hi, var, n = (np.array([r[c] for r in b], dtype=float) for c in ("lo", "hi", "var", "n"))
    d = len(lo)
    w, mu, s2 = np.full((d, k), 1 / k), rng.uniform(lo[:, None], hi[:, None], (d, k)), np.tile(np.maximum(var, 1e-9)[:, None], (1, k))
    last = -math.inf
    for _ in range(rounds):
        at = lambda m: F.get(encoders.literal(m), F.col("feature"))  # noqa: B023, E731
        p = [F.get(at(w), F.lit(j)) * F.exp(-F.pow(F.col("x") - F.get(at(mu), F.lit(j)), F.lit(2)) / (2 * F.get(at(s2), F.lit(j)))) / F.sqrt(2 * math.pi * F.get(at(s2), F.lit(j))) for j in range(k)]
        r = x.withColumn("p", F.array(*p)).withColumn("t", F.aggregate("p", F.lit(0.0), lambda a, c: a + c))
        share = lambda j: F.when(F.col("t") > 0, F.get("p", F.lit(j)) / F.when(F.col("t") > 0, F.col("t"))).otherwise(0.0)
        cols = [F.sum(F.log(F.when(F.col("t") > 0, F.col("t")))).alias("ll")]
        for j in range(k):
            cols += [F.sum(share(j)).alias(f"n{j}"), F.sum(share(j) * F.col("x")).alias(f"a{j}"), F.sum(share(j) * F.col("x") * F.col("x")).alias(f"b{j}")]
        got = {g.feature: g for g in r.groupBy("feature").agg(*cols).collect()}
        ll = sum(g.ll or 0.0 for g in got.values()) / n.sum()
        for f, g in got.items():
            for j in range(k):
                if g[f"n{j}"] < 1e-9:
                    w[f, j], mu[f, j], s2[f, j] = 1 / k, rng.uniform(lo[f], hi[f]), max(var[f], 1e-9)
                else:
                    w[f, j], mu[f, j] = g[f"n{j}"], g[f"a{j}"] / g[f"n{j}"]
                    s2[f, j] = max(g[f"b{j}"] / g[f"n{j}"] - mu[f, j] ** 2, 1e-9)
        w /= w.sum(axis=1, keepdims=True)
        if abs(ll - last) < threshold * abs(ll):
            break
        last = ll
    return spark.createDataFrame([(f, j, float(w[f, j]), float(mu[f, j]), float(s2[f, j])) for f in range(d) for j in range(k)], "feature int, k int, weight double, mu double, variance double")


def axes_encoding(df: DataFrame, keys: list[str], k: int, vec: str = "vec") -> DataFrame:
    """By bag: its k principal axes, joined, over length.

    Products of elements are summed by bag as they are shuffled, so a bag is
    never in one task; only its matrix is.
    """
    x = df.select(*keys, F.col(vec).cast("array<double>").alias("x"))
    pairs = x.select(*keys, "x", F.posexplode("x").alias("i", "a")).select(*keys, "i", "a", F.posexplode("x").alias("j", "b")).filter("j >= i")
    cells = pairs.groupBy(*keys, "i", "j").agg((F.avg(F.col("a") * F.col("b")) - F.avg("a") * F.avg("b")).alias("c"))
    bags = cells.groupBy(*keys).agg(F.collect_list(F.struct("i", "j", "c")).alias("cells"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for cells in b["cells"]:
                i, j, c = (np.array([x[name] for x in cells]) for name in "ijc")
                m = np.zeros((i.max() + 1, j.max() + 1))
                m[i, j] = m[j, i] = c
                axes = np.linalg.eigh(m)[1].T[::-1][:k]
                axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
                length = np.linalg.norm(axes)
                out.append(axes.ravel() / length if length else axes.ravel())
            yield b[keys].assign(vec=out)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    return bags.mapInPandas(run, f"{kinds}, vec array<double>")
