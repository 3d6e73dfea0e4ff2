"""Dual solvers of linear machines: a dual variable (or one for each class) a row, kept with the row.

Rows are packed into blocks. In a round each block ascends its own coordinates
in a proximal problem about common weights (the rounds are those of consensus by
the alternating direction method of multipliers); Spark adds the blocks' changes.
A block's multiplier follows from its own weights, so blocks keep nothing but
their rows' variables, and these stay feasible: the duality gap, from the same
sums, ends the rounds. What reaches the driver is weights and a few numbers a class.

A round is a table in the shared folder: a lost executor costs tasks, not rounds.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import staged
from .classifiers import Linear, labels_in_order

#: Rows of a block, which one call of a task's code holds.
BLOCK = 2048

#: A block's x and y, the common weights (k, d), those that it starts from, its variables (n, k), and the proximal term's
#: inverse weight. Gives the variables' change, the weights' change (k, d), and the loss at the common weights and the dual's own term before it, by machine.
Ascent = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, float], tuple[np.ndarray, ...]]


def order_of(rows: int, passes: int) -> Iterator[int]:
    """Rows in random orders, one after the other, the same on each run."""
    draw = np.random.default_rng(rows)
    return (i for _ in range(passes) for i in draw.permutation(rows))


def boxed(targets: np.ndarray, c: float, squared: bool, passes: int) -> Ascent:
    """Hinge machines one against the rest: 0 <= a <= C, or with squares 0 <= a and a diagonal of 1 / 2C."""
    top, diagonal = (np.inf, 0.5 / c) if squared else (c, 0.0)

    def run(x: np.ndarray, y: np.ndarray, w: np.ndarray, start: np.ndarray, a: np.ndarray, loose: float) -> tuple[np.ndarray, ...]:
        s = np.where(y[:, None] == targets, 1.0, -1.0)
        under = np.maximum(0, 1 - s * (x @ w.T))
        own, near, q = a.copy(), start.copy(), loose * (x * x).sum(1) + diagonal
        for i in order_of(len(x), passes):
            if q[i] > 0:
                new = np.clip(own[i] - (s[i] * (near @ x[i]) - 1 + diagonal * own[i]) / q[i], 0, top)
                near += (loose * (new - own[i]) * s[i])[:, None] * x[i]
                own[i] = new
        return own - a, (near - start) / loose, c * (under**2 if squared else under).sum(0), (0.5 * diagonal * a * a - a).sum(0)

    return run


def tube(c: float, eps: float, squared: bool, passes: int) -> Ascent:
    """Regression outside a tube of eps: -C <= b <= C, or with squares no bound and a diagonal of 1 / 2C."""
    top, diagonal = (np.inf, 0.5 / c) if squared else (c, 0.0)

    def run(x: np.ndarray, y: np.ndarray, w: np.ndarray, start: np.ndarray, a: np.ndarray, loose: float) -> tuple[np.ndarray, ...]:
        over = np.maximum(0, np.abs(x @ w[0] - y) - eps)
        before, own, near, q = a[:, 0], a[:, 0].copy(), start[0].copy(), loose * (x * x).sum(1) + diagonal
        for i in order_of(len(x), passes):
            if q[i] > 0:
                # The minimum of a parabola and eps |b|: a shift towards 0 by eps.
                free = own[i] - (near @ x[i] - y[i] + diagonal * own[i]) / q[i]
                new = min(max(np.sign(free) * max(abs(free) - eps / q[i], 0), -top), top)
                near += loose * (new - own[i]) * x[i]
                own[i] = new
        term = 0.5 * diagonal * before @ before - y @ before + eps * np.abs(before).sum()
        return (own - before)[:, None], (near - start[0])[None] / loose, np.array([c * (over**2 if squared else over).sum()]), np.array([term])

    return run


def level(b: np.ndarray, top: np.ndarray, q: float) -> np.ndarray:
    """The minimum of q |v|^2 / 2 + b v where v sums to 0 and v <= top: v = min(top, (beta - b) / q) for the beta that sums to 0."""
    ends = q * top + b  # from here on a class stands at its top
    order = np.argsort(ends, kind="stable")
    tops = np.concatenate([[0], np.cumsum(top[order])[:-1]])
    rest = np.cumsum(b[order][::-1])[::-1]
    beta = (rest - q * tops) / np.arange(len(b), 0, -1)
    r = np.flatnonzero(beta <= ends[order] + 1e-12 * (1 + np.abs(beta)))[0]
    return np.minimum(top, (beta[r] - b) / q)


def joint(targets: np.ndarray, c: float, passes: int) -> Ascent:
    """Crammer and Singer's machine: a row's variables sum to 0, up to C for its own class and 0 for others."""

    def run(x: np.ndarray, y: np.ndarray, w: np.ndarray, start: np.ndarray, a: np.ndarray, loose: float) -> tuple[np.ndarray, ...]:
        own_class = (y[:, None] == targets).astype(float)
        miss, scores = 1 - own_class, x @ w.T
        loss = (scores + miss).max(1) - (scores * own_class).sum(1)
        own, near, q = a.copy(), start.copy(), loose * (x * x).sum(1)
        for i in order_of(len(x), passes):
            if q[i] > 0:
                new = level(near @ x[i] + miss[i] - q[i] * own[i], c * own_class[i], q[i])
                near += loose * (new - own[i])[:, None] * x[i]
                own[i] = new
        # One machine: its classes share a gap.
        return own - a, (near - start) / loose, np.array([c * loss.sum()]), np.array([(miss * a).sum()])

    return run


def blocks(df: DataFrame, vec: str, label: str, order: str) -> DataFrame:
    """Rows in blocks of some BLOCK: x (row-major), y, as a staged table. Null vectors and labels go."""
    rows = df.filter(F.col(vec).isNotNull() & F.col(label).isNotNull())
    parts = 1 + rows.count() // BLOCK
    rows = rows.select(F.pmod(F.xxhash64(order), F.lit(parts)).alias("block"), F.col(vec).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"x": [np.concatenate(part["x"].to_list())], "y": [part["y"].to_numpy()]})

    return staged(rows.groupBy("block").applyInPandas(pack, "x array<double>, y array<double>"), "blocks")


STATE = "x array<double>, y array<double>, a array<double>, sums array<double>"


def solved(packed: DataFrame, ascent: Ascent, classes: int, machines: int, n: int, c: float, tolerance: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (classes, n) and the relative duality gaps of the machines, each at most the tolerance unless a warning says so."""

    def round_of(w: np.ndarray, start: np.ndarray, loose: float):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.itertuples(index=False):
                    y = np.asarray(row.y)
                    x = np.asarray(row.x).reshape(len(y), n)
                    a = np.asarray(row.a).reshape(len(y), classes) if len(row) > 2 else np.zeros((len(y), classes))
                    d, dw, loss, term = ascent(x, y, w, start, a, loose)
                    yield pd.DataFrame({"x": [row.x], "y": [y], "a": [(a + d).ravel()], "sums": [np.concatenate([dw.ravel(), loss, term, [(dw * dw).sum()]])]})

        return run

    sizes = packed.agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.size("y")).alias("rows")).first()
    many = sizes.blocks
    rho = np.sqrt(c * sizes.rows / many) if many else 1.0
    w, total, table, gap = np.zeros((classes, n)), np.zeros((classes, n)), packed, np.full(machines, np.inf if many else 0.0)
    start = w
    by_machine = lambda v: v.sum(1) if machines == classes else v.sum().reshape(1)
    for _ in range(rounds if many else 0):
        table = staged(table.mapInPandas(round_of(w, start, 1 / rho), STATE), "round")
        added = {r.i: r.s for r in table.select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s")).collect()}
        flat = np.array([added[i] for i in range(len(added))])
        dw, loss, term, moved = flat[: classes * n].reshape(classes, n), flat[-2 * machines - 1 : -machines - 1], flat[-machines - 1 : -1], flat[-1]
        primal, dual = 0.5 * by_machine(w * w) + loss, -(0.5 * by_machine(total * total) + term)
        gap = (primal - dual) / np.maximum(1.0, np.abs(primal))
        if (gap <= tolerance).all():
            return w, gap
        total = total + dw
        new = (many * rho * w + total) / (1 + many * rho)
        # How far blocks are from the common weights, and how far these moved, are held alike by rho.
        apart = np.sqrt(max(many * ((start - new) ** 2).sum() + 2 * ((start - new) * dw).sum() / rho + moved / rho**2, 0.0))
        shift = rho * np.sqrt(many) * np.sqrt(((new - w) ** 2).sum())
        then = rho * 2 if apart > 5 * shift else rho / 2 if shift > 5 * apart else rho
        start, w, rho = new + rho / then * (new - w), new, then
    if many:
        warnings.warn(f"no convergence within {rounds} rounds: gap {gap.max():.2g}", RuntimeWarning, stacklevel=3)
    return w, gap


def train_dual(df: DataFrame, n: int, c: float = 1.0, squared: bool = False, label: str = "label", vec: str = "vec", order: str = "id", tolerance: float = 1e-3, rounds: int = 200, passes: int = 5) -> tuple[Linear, np.ndarray]:
    """One-vs-rest machines by the hinge (or its square) over all rows, and their relative duality gaps.

    The objective is |w|^2 / 2 + C sum loss, without bias. Two labels give one
    vector and its opposite. Rows with a null vector or label take no part.
    """
    labels = labels_in_order(df.filter(F.col(label).isNotNull() & F.col(vec).isNotNull()), label, order)
    targets = np.array(labels[:1] if len(labels) == 2 else labels)
    w, gap = solved(blocks(df, vec, label, order), boxed(targets, c, squared, passes), len(targets), len(targets), n, c, tolerance, rounds)
    return Linear(labels, np.vstack([w, -w]) if len(labels) == 2 else w), gap


def train_dual_svr(df: DataFrame, n: int, c: float = 1.0, eps: float = 0.1, squared: bool = False, y: str = "label", vec: str = "vec", order: str = "id", tolerance: float = 1e-3, rounds: int = 200, passes: int = 5) -> tuple[np.ndarray, float]:
    """Weights of regression with the eps-insensitive loss (or its square), and the relative duality gap."""
    w, gap = solved(blocks(df, vec, y, order), tube(c, eps, squared, passes), 1, 1, n, c, tolerance, rounds)
    return w[0], float(gap[0])


def train_joint(df: DataFrame, n: int, c: float = 1.0, label: str = "label", vec: str = "vec", order: str = "id", tolerance: float = 1e-3, rounds: int = 200, passes: int = 5) -> tuple[Linear, float]:
    """Crammer and Singer's multi-class machine over all rows, and its relative duality gap."""
    labels = labels_in_order(df.filter(F.col(label).isNotNull() & F.col(vec).isNotNull()), label, order)
    w, gap = solved(blocks(df, vec, label, order), joint(np.array(labels), c, passes), len(labels), 1, n, c, tolerance, rounds)
    return Linear(labels, w), float(gap[0])
