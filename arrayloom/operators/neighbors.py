"""Nearest neighbours through a partitioned k-d tree.

Planes fitted on a bounded sample cut space into cells; every point is indexed.
A cell's points lie in units that a task can hold, each with a k-d tree of its
own. A query is first answered in its own cell, which bounds the distance of its
k-th neighbour; then only units whose box comes that near are asked.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import staged

#: Points of a tree's leaf, which are compared at once.
LEAF = 32


@dataclass(frozen=True)
class Planes:
    """A tree of cutting planes over a sample: node i has children 2i + 1 and 2i + 2; values up to the cut go left."""

    axis: np.ndarray
    cut: np.ndarray

    @staticmethod
    def fit(sample: np.ndarray, depth: int) -> Planes:
        """Medians along the widest axis, level by level."""
        axis, cut, held = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1), {0: sample}
        for i in range(len(axis)):
            x = held.pop(i)
            if len(x):
                axis[i] = np.ptp(x, axis=0).argmax()
                cut[i] = np.median(x[:, axis[i]])
            left = x[:, axis[i]] <= cut[i]
            held[2 * i + 1], held[2 * i + 2] = x[left], x[~left]
        return Planes(axis, cut)

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Each row's cell."""
        at = np.zeros(len(x), np.int64)
        for _ in range((len(self.axis) + 1).bit_length() - 1):
            at = 2 * at + 1 + (x[np.arange(len(x)), self.axis[at]] > self.cut[at])
        return at - len(self.axis)


class Tree:
    """A k-d tree of one unit: medians along the widest axis down to leaves, each with its box."""

    def __init__(self, x: np.ndarray, ids: np.ndarray) -> None:
        order, todo, ends = np.arange(len(x)), [(0, len(x))], []
        while todo:
            a, b = todo.pop()
            part = x[order[a:b]]
            if b - a <= LEAF or not np.ptp(part, axis=0).any():
                ends.append((a, b))
                continue
            middle = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(part[:, np.ptp(part, axis=0).argmax()], middle)]
            todo += [(a, a + middle), (a + middle, b)]
        self.x, self.ids, self.ends = x[order], ids[order], sorted(ends)
        self.low = np.array([self.x[a:b].min(0) for a, b in self.ends])
        self.high = np.array([self.x[a:b].max(0) for a, b in self.ends])

    def search(self, v: np.ndarray, k: int, bound: float) -> tuple[list[tuple[float, int]], int]:
        """The k nearest (d2, id) with d2 up to the bound, ties by id, and how many points were compared. The nearest box is searched first."""
        boxes, best, compared = away(v, self.low, self.high), [], 0  # best: a heap, the worst on top
        for leaf in np.argsort(boxes, kind="stable"):
            if boxes[leaf] > (min(bound, -best[0][0]) if len(best) == k else bound):
                break
            a, b = self.ends[leaf]
            compared += b - a
            d = ((self.x[a:b] - v) ** 2).sum(1)
            for j in np.flatnonzero(d <= bound):
                one = (-float(d[j]), -int(self.ids[a + j]))
                if len(best) < k:
                    heapq.heappush(best, one)
                elif one > best[0]:
                    heapq.heapreplace(best, one)
        return [(-d, -i) for d, i in best], compared


def away(v: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of a point from boxes. Sums run as those of points do, so that rounding can't put a point nearer than its box."""
    return (np.maximum(np.maximum(low - v, v - high), 0) ** 2).sum(-1)


def searched(k: int):
    """Cogrouped: a unit's points and the queries (q, qv, bound) sent to it."""

    def run(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(queries) and len(points):
            tree = Tree(np.stack(points["pv"].to_list()), points["p"].to_numpy())
            for q, v, bound in zip(queries["q"], queries["qv"], queries["bound"], strict=True):
                found, compared = tree.search(np.asarray(v), k, bound)
                # A row without a point carries the count.
                rows += [(q, p, d, 0) for d, p in found] + [(q, None, None, compared)]
        out = pd.DataFrame(rows, columns=["q", "p", "d2", "compared"])
        return out.astype({"p": "Int64", "d2": "float64"})

    return run


FOUND = "q long, p long, d2 double, compared long"


def indexed(points: DataFrame, sample: int = 20_000, unit: int = 20_000, most_cells: int = 1024) -> tuple[Planes, DataFrame, np.ndarray]:
    """The planes, points with their unit (cell, chunk) as a staged table, and the units' boxes.

    Planes are fitted on at most `sample` points, those whose hash is least. There are as
    many cells as units of some `unit` points are wanted, up to most_cells;
    beyond that, and where many points are equal, a cell is dealt in chunks. The
    boxes, most_cells * 2 vectors, are what the driver holds: chunks of a cell
    share its box.
    """
    p = points.select("p", F.col("pv").cast("array<double>").alias("pv"))
    some = np.array([r.pv for r in p.orderBy(F.xxhash64("p"), "p").limit(sample).select("pv").collect()])
    depth = max(0, int(np.ceil(np.log2(max(1, min(most_cells, p.count() / unit))))))
    width = some.shape[1] if len(some) else 0
    planes = Planes.fit(some.reshape(len(some), width), depth)

    def deal(batches):
        for b in batches:
            if len(b):
                yield b.assign(cell=planes.cells(np.stack(b["pv"].to_list())))

    celled = p.mapInPandas(deal, "p long, pv array<double>, cell long")
    held = staged(celled, "cells")
    chunks = held.groupBy(F.col("cell").alias("cell_")).agg((1 + F.expr(f"count(1) div {2 * unit}")).alias("chunks"))
    units = held.join(staged(chunks, "chunks"), F.col("cell") == F.col("cell_")).drop("cell_").withColumn("chunk", F.pmod(F.xxhash64("p"), "chunks"))
    edges = held.select("cell", F.posexplode("pv").alias("i", "x")).groupBy("cell", "i").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    boxes = np.full((1 << depth, 2, width), np.nan)
    for r in edges.collect():
        boxes[r.cell, :, r.i] = r.low, r.high
    return planes, units, boxes


def nearest_by_tree(queries: DataFrame, points: DataFrame, k: int = 1, work: bool = False, **how) -> DataFrame:
    """q, p, d2, rank: for each query (q, qv) the k nearest points (p, pv), ties by p, as joins.nearest gives.

    Fewer points than k give fewer rows; repeated points each count; queries
    with a null vector, or no points, give none. With work, also compared: how
    many points the query was held against. how: see indexed().
    """
    planes, units, boxes = indexed(points.filter(F.col("pv").isNotNull()), **how)
    asked = queries.filter(F.col("qv").isNotNull()).select("q", F.col("qv").cast("array<double>").alias("qv"))
    chunks = staged(units.groupBy("cell", "chunk").agg(F.count(F.lit(1)).alias("n")), "units").select("cell", "chunk")
    filled = np.flatnonzero(~np.isnan(boxes).any(axis=(1, 2))) if boxes.shape[2] else np.empty(0, np.int64)

    def at_home(batches):
        for b in batches:
            if len(b) and len(filled):
                cells = planes.cells(np.stack(b["qv"].to_list()))
                yield b.assign(cell=np.where(np.isin(cells, filled), cells, filled[0]), bound=np.inf)

    def elsewhere(batches):
        for b in batches:
            for r in b.itertuples(index=False):
                near = filled[away(np.asarray(r.qv), boxes[filled, 0], boxes[filled, 1]) <= r.bound]
                near = near[near != r.home]
                if len(near):
                    yield pd.DataFrame({"q": r.q, "qv": [r.qv] * len(near), "cell": near, "bound": r.bound})

    def ask(sent: DataFrame) -> DataFrame:
        left = sent.join(chunks, "cell").groupBy("cell", "chunk")
        return staged(left.cogroup(units.groupBy("cell", "chunk")).applyInPandas(searched(k), FOUND), "found")

    home = staged(asked.mapInPandas(at_home, "q long, qv array<double>, cell long, bound double"), "home")
    first = ask(home)
    at = F.row_number().over(Window.partitionBy("q").orderBy("d2", "p"))
    kth = first.filter("p is not null").withColumn("rank", at).filter(F.col("rank") == k).select("q", F.col("d2").alias("kth"))
    again = home.join(kth, "q", "left").select("q", "qv", F.col("cell").alias("home"), F.coalesce("kth", F.lit(float("inf"))).alias("bound"))
    second = ask(again.mapInPandas(elsewhere, "q long, qv array<double>, cell long, bound double"))
    both = first.union(second)
    out = both.filter("p is not null").withColumn("rank", at).filter(F.col("rank") <= k).select("q", "p", "d2", "rank")
    if not work:
        return out
    return out.join(both.groupBy("q").agg(F.sum("compared").alias("compared")), "q")
