"""Linear and kernel classifiers: training by sums over rows, prediction, search and validation.

Primal objectives are minimised by gradients that Spark sums over partitions;
only weight vectors (classes x features) pass through the driver. Kernel
machines work on a bounded set of training rows.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import vectors as V
from ..functions.storage import staged


@dataclass(frozen=True)
class Linear:
    """One weight vector for each label. Labels stand in order of first occurrence, which settles ties."""

    labels: tuple[float, ...]
    weights: np.ndarray

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, float(y), [float(x) for x in w]) for i, (y, w) in enumerate(zip(self.labels, self.weights, strict=True))], "class_pos int, label double, w array<double>")

    def scores(self, vec: Column) -> Column:
        return F.array(*[V.dot(vec, F.array(*[F.lit(float(x)) for x in w])) for w in self.weights])


def predicted(df: DataFrame, model: Linear, vec: str = "vec") -> DataFrame:
    """df with scores and predicted: the label of the greatest score, the first on ties."""
    s = df.withColumn("scores", model.scores(F.col(vec).cast("array<double>")))
    best = F.array_position("scores", F.array_max("scores")).cast("int")
    return s.withColumn("predicted", F.get(F.array(*map(F.lit, model.labels)), best - 1))


def binary_predicted(score: Column, positive: float, negative: float) -> Column:
    """The positive label where a score exceeds 0."""
    return F.when(score > 0, positive).otherwise(negative)


def probabilities(scores: Column) -> Column:
    """Logistic values of scores, over their sum."""
    p = F.transform(scores, lambda s: 1 / (1 + F.exp(-s)))
    return F.transform(p, lambda x: x / V.total(p))


def labels_in_order(df: DataFrame, label: str, order: str) -> tuple[float, ...]:
    """Labels by first occurrence."""
    rows = df.groupBy(F.col(label).cast("double").alias("y")).agg(F.min(order).alias("o")).orderBy("o").collect()
    return tuple(r.y for r in rows)


#: The hinge is rounded off over this width of margin, which moves no optimum by more.
CORNER = 1e-2


def hinge(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value, slope and curvature of the hinge with its corner rounded off."""
    under = 1 - z
    near = (under > 0) & (under < CORNER)
    value = np.where(under >= CORNER, under - CORNER / 2, np.where(near, under**2 / (2 * CORNER), 0.0))
    return value, np.where(under >= CORNER, -1.0, np.where(near, -under / CORNER, 0.0)), np.where(near, 1 / CORNER, 0.0)


#: Losses of margins z, their derivatives and curvatures.
LOSSES = {
    "squared_hinge": lambda z: (np.maximum(0, 1 - z) ** 2, -2 * np.maximum(0, 1 - z), 2.0 * (z < 1)),
    "hinge": hinge,
    "logistic": lambda z: (np.logaddexp(0, -z), -1 / (1 + np.exp(np.minimum(z, 700))), 1 / (2 + np.exp(np.minimum(z, 700)) + np.exp(np.minimum(-z, 700)))),
}


def sums(df: DataFrame, f, width: int, vec: str, y: str) -> np.ndarray:
    """The sum over rows of f(X, y), arrays of `width` values: one array from each task, added by Spark."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(width)
        for b in batches:
            if len(b):
                total += f(np.stack(b["x"].to_list()), b["y"].to_numpy())
        yield pd.DataFrame({"i": np.arange(width), "s": total})

    rows = df.select(F.col(vec).cast("array<double>").alias("x"), F.col(y).cast("double").alias("y"))
    out = np.zeros(width)
    for r in rows.mapInPandas(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():
        out[r.i] = r.s
    return out


#: Up to this many features a pass sums whole Hessians; beyond, products of Hessians with directions.
DENSE = 128


def step_within(product, gradient: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steihaug's conjugate gradients for each row of gradient: a step within its radius, and the model's reduction.

    product(directions) gives all rows' Hessian products at once, so an iteration is one pass over the data.
    """
    s, r = np.zeros_like(gradient), -gradient
    d, target = r.copy(), 0.1 * np.linalg.norm(gradient, axis=1)
    live = np.linalg.norm(r, axis=1) > target
    for _ in range(2 * gradient.shape[1] if live.any() else 0):
        hd = product(d)
        rr, curve = (r * r).sum(1), (d * hd).sum(1)
        alpha = np.where(live, rr / np.where(curve > 0, curve, 1.0), 0.0)
        ahead = s + alpha[:, None] * d
        out = live & (np.linalg.norm(ahead, axis=1) >= radius)
        for k in np.flatnonzero(out):  # to the border along d
            a, b, c = d[k] @ d[k], 2 * s[k] @ d[k], s[k] @ s[k] - radius[k] ** 2
            alpha[k] = (-b + np.sqrt(max(b * b - 4 * a * c, 0.0))) / (2 * a)
        s, r = s + alpha[:, None] * d, r - alpha[:, None] * hd
        live &= ~out & (np.linalg.norm(r, axis=1) > target)
        if not live.any():
            break
        d = np.where(live[:, None], r + ((r * r).sum(1) / np.where(rr > 0, rr, 1.0))[:, None] * d, 0.0)
    return s, 0.5 * ((s * r).sum(1) - (s * gradient).sum(1))


def trust_region(start: np.ndarray, value_slope, product_at, tolerance: float, rounds: int) -> np.ndarray:
    """The minimum of each row's objective. A step that doesn't lower it is not taken; its radius shrinks instead."""
    w = start
    f, g, state = value_slope(w)
    first, radius = np.linalg.norm(g, axis=1), np.linalg.norm(g, axis=1)
    for _ in range(rounds):
        done = np.linalg.norm(g, axis=1) <= tolerance * np.maximum(first, 1e-300)
        if done.all():
            return w
        step, expected = step_within(product_at(state), np.where(done[:, None], 0.0, g), radius)
        new_f, new_g, new_state = value_slope(w + step)
        gain = f - new_f
        ratio, size = gain / np.where(expected > 0, expected, 1.0), np.linalg.norm(step, axis=1)
        radius = np.where(ratio < 0.25, 0.25 * size, np.where(ratio > 0.75, np.maximum(radius, 3 * size), radius))
        take = ~done & (gain > 1e-4 * expected)
        stuck = ~done & (expected <= 1e-14 * np.maximum(np.abs(f), 1.0))  # at the limit of the numbers
        if (done | stuck).all():
            return w
        w = np.where(take[:, None], w + step, w)
        f, g = np.where(take, new_f, f), np.where(take[:, None], new_g, g)
        state = tuple(np.where(take.reshape(-1, *[1] * (a.ndim - 1)), n, a) for n, a in zip(new_state, state, strict=True))
    warnings.warn(f"no convergence within {rounds} rounds", RuntimeWarning, stacklevel=3)
    return w


def train_linear(df: DataFrame, n: int, c: float = 1.0, loss: str = "squared_hinge", label: str = "label", vec: str = "vec", order: str = "id", rounds: int = 100, tolerance: float = 1e-4, l1: bool = False) -> Linear:
    """One-vs-rest on |w|^2 / 2 + C sum loss by a trust region (with l1, |w|_1 by train_sparse()): no bias.

    Losses are squared_hinge, hinge and logistic. A pass sums the gradients of
    all classes, with their Hessians up to DENSE features; beyond that each
    iteration of conjugate gradients is a pass that sums Hessian products. What
    reaches the driver is classes x features numbers (x features up to DENSE).
    Ends when gradients are `tolerance` of their start, or warns after `rounds`.
    """
    if l1:
        return train_sparse(df, n, c, loss, label, vec, order, rounds)[0]
    terms = LOSSES[loss]
    labels = labels_in_order(df, label, order)
    targets = labels[:1] if len(labels) == 2 else labels  # of two, one vector, and its opposite
    k, dense = len(targets), n <= DENSE
    size = 1 + n + (n * n if dense else 0)

    def statistics(current: np.ndarray) -> np.ndarray:
        def f(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            out = []
            for t, wk in zip(targets, current, strict=True):
                s = np.where(y == t, 1.0, -1.0)
                value, slope, bend = terms(s * (x @ wk))
                out += [[value.sum()], x.T @ (s * slope)] + ([((x * bend[:, None]).T @ x).ravel()] if dense else [])
            return np.concatenate(out)

        return c * sums(df, f, k * size, vec, label).reshape(k, size)

    def value_slope(w: np.ndarray):
        got = statistics(w)
        return 0.5 * (w * w).sum(1) + got[:, 0], w + got[:, 1 : 1 + n], ((got[:, 1 + n :].reshape(k, n, n),) if dense else (w,))

    def product_at(state: tuple):
        if dense:
            return lambda d: d + np.einsum("kij,kj->ki", state[0], d)

        def product(d: np.ndarray) -> np.ndarray:
            def f(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                return np.concatenate([x.T @ (terms(np.where(y == t, 1.0, -1.0) * (x @ wk))[2] * (x @ dk)) for t, wk, dk in zip(targets, state[0], d, strict=True)])

            return d + c * sums(df, f, k * n, vec, label).reshape(k, n)

        return product

    w = trust_region(np.zeros((k, n)), value_slope, product_at, tolerance, rounds)
    return Linear(labels, np.vstack([w, -w]) if len(labels) == 2 else w)


def descended(g: np.ndarray, h: np.ndarray, w: np.ndarray, passes: int = 100) -> np.ndarray:
    """The step d that minimises g d + d h d / 2 + |w + d|_1, by coordinates in turn until none moves."""
    d, hd = np.zeros(len(g)), np.zeros(len(g))
    for _ in range(passes):
        most = 0.0
        for j in range(len(g)):
            free = w[j] + d[j] - (g[j] + hd[j]) / h[j, j]
            new = np.sign(free) * max(abs(free) - 1 / h[j, j], 0.0) - w[j]
            if new != d[j]:
                hd += h[j] * (new - d[j])
                most = max(most, abs(new - d[j]) * h[j, j])
                d[j] = new
        if most <= 1e-6:
            break
    return d


#: Active features whose curvatures are summed together.
HELD = 512

#: Steps that one pass of the line search tries.
STEPS = 0.5 ** np.arange(12)


def train_sparse(df: DataFrame, n: int, c: float = 1.0, loss: str = "squared_hinge", label: str = "label", vec: str = "vec", order: str = "id", rounds: int = 100, tolerance: float = 1e-3) -> tuple[Linear, np.ndarray]:
    """One-vs-rest on |w|_1 + C sum loss, and by machine the greatest violation of its optimality condition.

    A round is three passes: slopes over all features; curvatures over the active
    ones (with a weight, or a slope that may give them one) in blocks of HELD; a
    line search over losses at STEPS. Blocks descend by coordinates on their own,
    and the line search bounds their joint step, so no round raises the objective.
    n numbers a class and half of HELD squared a block reach the driver, never n x n.
    A feature whose slope is well within the penalty leaves the active set; the
    condition, which ends the rounds, is taken over all features.
    Two labels give one vector and its opposite. Rows with a null vector or label take no part.
    """
    terms = LOSSES[loss]
    df = df.filter(F.col(vec).isNotNull() & F.col(label).isNotNull())
    labels = labels_in_order(df, label, order)
    targets = labels[:1] if len(labels) == 2 else labels
    k, w = len(targets), np.zeros((len(targets), n))
    signs = lambda y: np.stack([np.where(y == t, 1.0, -1.0) for t in targets])

    def slopes(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def f(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            s = signs(y)
            value, slope, _ = terms(s * (w @ x.T))
            return np.concatenate([value.sum(1), ((s * slope) @ x).ravel()])

        got = c * sums(df, f, k + k * n, vec, label)
        return got[:k], got[k:].reshape(k, n)

    def curvatures(w: np.ndarray, parts: list[tuple[int, np.ndarray]]) -> list[np.ndarray]:
        upper = [np.triu_indices(len(p)) for _, p in parts]
        ends = np.cumsum([len(u[0]) for u in upper])

        def f(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            bend = terms(signs(y) * (w @ x.T))[2]
            return np.concatenate([((x[:, p] * bend[t][:, None]).T @ x[:, p])[u] for (t, p), u in zip(parts, upper, strict=True)])

        out = []
        for half, u in zip(np.split(c * sums(df, f, int(ends[-1]), vec, label), ends[:-1]), upper, strict=True):
            h = np.zeros((u[0][-1] + 1,) * 2)
            h[u] = half
            out.append(h + np.triu(h, 1).T + 1e-8 * np.eye(len(h)))
        return out

    def losses(w: np.ndarray, d: np.ndarray) -> np.ndarray:
        def f(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            s = signs(y)
            at, along = s * (w @ x.T), s * (d @ x.T)
            return np.stack([terms(at + t * along)[0].sum(1) for t in STEPS], axis=1).ravel()

        return c * sums(df, f, k * len(STEPS), vec, label).reshape(k, len(STEPS))

    violation = np.full(k, np.inf)
    for _ in range(rounds if k else 0):
        value, g = slopes(w)
        off = np.where(w != 0, np.abs(g + np.sign(w)), np.maximum(np.abs(g) - 1, 0))
        violation = off.max(1)
        live = violation > tolerance
        if not live.any():
            return Linear(labels, np.vstack([w, -w]) if len(labels) == 2 else w), violation
        slack = np.minimum(0.1, violation)
        parts = []
        for t in np.flatnonzero(live):
            active = np.flatnonzero((w[t] != 0) | (np.abs(g[t]) > 1 - slack[t]))
            active = active[np.argsort(-off[t, active], kind="stable")]  # what must move most moves together
            parts += [(t, active[i : i + HELD]) for i in range(0, len(active), HELD)]
        d = np.zeros((k, n))
        for (t, p), h in zip(parts, curvatures(w, parts), strict=True):
            d[t, p] = descended(g[t, p], h, w[t, p])
        ahead = losses(w, d) + np.abs(w[:, None] + STEPS[None, :, None] * d[:, None]).sum(2)
        expected = (g * d).sum(1) + np.abs(w + d).sum(1) - np.abs(w).sum(1)
        enough = ahead <= (value + np.abs(w).sum(1))[:, None] + 0.01 * STEPS * expected[:, None]
        if not enough[live].any():
            break  # at the limit of the numbers
        w = w + np.where(enough.any(1), STEPS[enough.argmax(1)], 0.0)[:, None] * d
    if k:
        warnings.warn(f"no convergence within {rounds} rounds: violation {violation.max():.2g}", RuntimeWarning, stacklevel=2)
    return Linear(labels, np.vstack([w, -w]) if len(labels) == 2 else w), violation


def train_crammer_singer(df: DataFrame, n: int, c: float = 1.0, label: str = "label", vec: str = "vec", order: str = "id", rounds: int = 200) -> Linear:
    """The joint multi-class hinge by averaged subgradients."""
    labels = labels_in_order(df, label, order)
    k, rows = len(labels), df.count()
    w, mean, y_of = np.zeros((k, n)), np.zeros((k, n)), np.array(labels)
    for t in range(rounds):

        def f(x: np.ndarray, y: np.ndarray, w: np.ndarray = w) -> np.ndarray:
            own = (y[:, None] == y_of[None]).argmax(axis=1)
            s = x @ w.T + (np.arange(k)[None] != own[:, None])
            worst = s.argmax(axis=1)
            g = np.zeros((k, n))
            np.add.at(g, worst, x)
            np.add.at(g, own, -x)
            return g.ravel()

        g = sums(df, f, k * n, vec, label).reshape(k, n)
        w = w - (w / max(c * rows, 1) + g / rows) * 2 / np.sqrt(t + 1)
        mean += (w - mean) / (t + 1)
    return Linear(labels, mean)


def train_svr(df: DataFrame, n: int, c: float = 1.0, eps: float = 0.1, y: str = "label", vec: str = "vec", rounds: int = 100, tolerance: float = 1e-6, squared: bool = True) -> np.ndarray:
    """Weights of epsilon-insensitive regression, squared or (its corner rounded off) absolute, by a trust region."""

    def value_slope(w: np.ndarray):
        def f(x: np.ndarray, t: np.ndarray) -> np.ndarray:
            r = x @ w[0] - t
            if squared:
                over = np.maximum(np.abs(r) - eps, 0)
                value, slope, bend = over**2, 2 * over, 2.0 * (over > 0)
            else:
                value, slope, bend = hinge(1 - (np.abs(r) - eps))
                slope = -slope
            return np.concatenate([[value.sum()], x.T @ (np.sign(r) * slope), ((x * bend[:, None]).T @ x).ravel()])

        got = c * sums(df, f, 1 + n + n * n, vec, y)
        return 0.5 * (w * w).sum(1) + got[0], w + got[1 : 1 + n], (got[1 + n :].reshape(1, n, n),)

    return trust_region(np.zeros((1, n)), value_slope, lambda state: lambda d: d + np.einsum("kij,kj->ki", state[0], d), tolerance, rounds)[0]


def folds(df: DataFrame, k: int, order: str = "id") -> DataFrame:
    """df with fold: contiguous runs of rows / k, in order; the rest has fold k, which is never tested.

    Rows are dealt by ranges of the order column and staged with their range's
    number, as a second run would draw other bounds. Ranks come from the ranges'
    counts, so no task sorts all rows. Rows of equal order stand by their hash.
    """
    ranged = staged(df.repartitionByRange(order).withColumn("part_", F.spark_partition_id()), "folds")
    at = F.row_number().over(W.partitionBy("part_").orderBy(order, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])))
    counts = {r["part_"]: r["n"] for r in ranged.groupBy("part_").agg(F.count(F.lit(1)).alias("n")).collect()}
    size, before, start = sum(counts.values()) // k, {}, 0
    for p in sorted(counts):
        before[p], start = start, start + counts[p]
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("part_")) if before else F.lit(0)
    return ranged.withColumn("at_", at).withColumn("fold", F.least(F.floor((offset + F.col("at_") - 1) / max(size, 1)), F.lit(k)).cast("int")).drop("part_", "at_")


def cross_validated(df: DataFrame, k: int, fit, order: str = "id", dealt: bool = False) -> list[float]:
    """Percent right on each fold of a model fit on the others. fit(train) gives a function from test to predicted rows.

    With dealt, df is what folds() gave, staged.
    """
    from .stats import accuracy

    parts = df if dealt else staged(folds(df, k, order), "folds")
    out = []
    for f in range(k):
        predict = fit(parts.filter(F.col("fold") != f))
        out.append(accuracy(predict(parts.filter(F.col("fold") == f)), "label", "predicted").first()[0])
    return out


def linear_after_pca(n: int, components: int, c: float = 1.0, vec: str = "vec", **how):
    """For cross_validated(): PCA and linear machines, both fit on the training folds alone."""
    from . import stats

    def fit(train: DataFrame):
        mean, rows, _ = stats.pca(train, vec, n, components)
        reduced = lambda df: df.withColumn("reduced", stats.project(F.col(vec).cast("array<double>"), mean.tolist(), rows.tolist()))
        model = train_linear(staged(reduced(train), "reduced"), components, c, vec="reduced", **how)
        return lambda test: predicted(reduced(test), model, "reduced")

    return fit


def kernel_machines(vec: str = "vec", **how):
    """For cross_validated(): kernel machines."""

    def fit(train: DataFrame):
        models = train_kernel(train, vec=vec, **how)
        return lambda test: kernel_predicted(test, models, vec)

    return fit


def train_and_test(train: DataFrame, test: DataFrame, n: int, vec: str = "vec", **how) -> tuple[Linear, DataFrame]:
    """A model of train, and its accuracy on test (one row)."""
    from .stats import accuracy

    model = train_linear(train, n, vec=vec, **how)
    return model, accuracy(predicted(test, model, vec), "label", "predicted")


def best_c(df: DataFrame, n: int, start: float = 1.0, most: float = 4096.0, k: int = 5) -> tuple[float, float]:
    """C and its accuracy: doubled from start to most, until three doublings bring nothing. Folds are dealt once."""
    best, stale, c = (start, -1.0), 0, start
    parts = staged(folds(df, k), "folds")
    while c <= most and stale < 3:
        scores = cross_validated(parts, k, lambda train, c=c: lambda test, m=train_linear(train, n, c): predicted(test, m), dealt=True)
        mean = float(np.mean([s for s in scores if s is not None]))
        stale = 0 if mean > best[1] else stale + 1
        best = max(best, (c, mean), key=lambda x: (x[1], -x[0]))
        c *= 2
    return best


@dataclass(frozen=True)
class Kernel:
    """A binary C-SVC in its dual form: support vectors, signed weights, bias, and the kernel."""

    vectors: np.ndarray
    alphas: np.ndarray
    bias: float
    kind: str
    gamma: float
    degree: int = 3

    def values(self, x: np.ndarray) -> np.ndarray:
        return gram(x, self.vectors, self.kind, self.gamma, self.degree) @ self.alphas + self.bias


def gram(a: np.ndarray, b: np.ndarray, kind: str, gamma: float, degree: int = 3) -> np.ndarray:
    if kind in ("linear", "precomputed"):
        return a @ b.T
    if kind == "poly":
        return (gamma * a @ b.T) ** degree
    if kind == "rbf":
        return np.exp(-gamma * ((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T))
    raise ValueError(kind)


def smo(k: np.ndarray, y: np.ndarray, c: float = 1.0, eps: float = 1e-3, rounds: int = 100_000) -> tuple[np.ndarray, float]:
    """Dual weights and bias of a precomputed kernel: the most violating pair at a time."""
    a, g = np.zeros(len(y)), -np.ones(len(y))
    for _ in range(rounds):
        up, low = ((y > 0) & (a < c)) | ((y < 0) & (a > 0)), ((y > 0) & (a > 0)) | ((y < 0) & (a < c))
        v = -y * g
        i, j = np.where(up, v, -np.inf).argmax(), np.where(low, v, np.inf).argmin()
        if v[i] - v[j] < eps:
            break
        step = (v[i] - v[j]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        step = min(step, c - a[i] if y[i] > 0 else a[i], a[j] if y[j] > 0 else c - a[j])
        a[i] += y[i] * step
        a[j] -= y[j] * step
        g += y * step * (k[:, i] - k[:, j])
    free = (a > 1e-8) & (a < c - 1e-8)
    v = -y * g
    bias = float(v[free].mean()) if free.any() else float((v[i] + v[j]) / 2)
    return a * y, bias


def some_rows(df: DataFrame, most_rows: int, label: str, order: str) -> DataFrame:
    """At most most_rows rows, of each label its share: those whose hash is least, so not the first of a sorted table."""
    counts = {r[0]: r[1] for r in df.groupBy(F.col(label).cast("double")).agg(F.count(F.lit(1))).collect()}
    total = sum(counts.values())
    if total <= most_rows:
        return df
    share = {y: max(1, n * most_rows // total) for y, n in counts.items()}
    least = F.row_number().over(W.partitionBy(label).orderBy(F.xxhash64(order), order))
    bound = F.element_at(F.create_map(*[F.lit(float(x)) for kv in share.items() for x in kv]), F.col(label).cast("double"))
    return df.withColumn("at_", least).filter(F.col("at_") <= bound).drop("at_")


def train_kernel(df: DataFrame, c: float = 1.0, kind: str = "rbf", gamma: float | None = None, most_rows: int = 5000, label: str = "label", vec: str = "vec", order: str = "id") -> dict[float, Kernel]:
    """One-vs-rest machines by label, on at most most_rows rows, drawn by hash within each label: a Gram matrix's bound.

    kind "precomputed" takes vec as a row of the kernel matrix, its columns the
    training rows in order; then all rows are used, and more than most_rows are
    an error. kernel_duals.train_kernel_all() has no such bound.
    """
    if kind == "precomputed" and df.limit(most_rows + 1).count() > most_rows:
        raise ValueError(f"a kernel matrix of more than {most_rows} rows")
    some = df if kind == "precomputed" else some_rows(df, most_rows, label, order)
    rows = some.select(F.col(order).alias("o"), F.col(label).cast("double").alias("y"), F.col(vec).cast("array<double>").alias("x")).orderBy("o").collect()
    x, y = np.array([r.x for r in rows]), np.array([r.y for r in rows])
    if kind == "precomputed" and x.shape != (len(x), len(x)):
        raise ValueError("a precomputed kernel is square")
    g = gamma or 1 / x.shape[1]
    k = x if kind == "precomputed" else gram(x, x, kind, g)
    out = {}
    for t in dict.fromkeys(y.tolist()):
        alphas, bias = smo(k, np.where(y == t, 1.0, -1.0), c)
        live = np.ones(len(alphas), bool) if kind == "precomputed" else np.abs(alphas) > 1e-8
        out[t] = Kernel(np.eye(len(x)) if kind == "precomputed" else x[live], alphas[live], bias, kind, g)
    return out


def kernel_predicted(df: DataFrame, models: dict[float, Kernel], vec: str = "vec") -> DataFrame:
    """df with predicted: the label of the greatest value, the last on ties."""
    labels = np.array(list(models))

    @F.pandas_udf("double")
    def predict(x: pd.Series) -> pd.Series:
        m = np.stack(x.to_list())
        values = np.stack([k.values(m) for k in models.values()], axis=1)
        return pd.Series(labels[::-1][values[:, ::-1].argmax(axis=1)])

    return df.withColumn("predicted", predict(F.col(vec).cast("array<double>")))
