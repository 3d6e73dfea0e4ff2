"""Pipelines: stages of DataFrame to DataFrame, and the usual train and predict chains."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import staged
from ..operators import classifiers, encoders, pyramids, stats

Stage = Callable[[DataFrame], DataFrame]


@dataclass
class Pipeline:
    """Stages in order. Those named in keep are staged in the shared folder, for inputs that are read again."""

    stages: list[tuple[str, Stage]]
    keep: set[str] = field(default_factory=set)

    def run(self, df: DataFrame) -> DataFrame:
        for name, stage in self.stages:
            df = stage(df)
            if name in self.keep:
                df = staged(df, name)
        return df


@dataclass
class PyramidClassifier:
    """Log-polar stacks to pinwheel features, one codebook a level, VLAD, and a linear classifier."""

    pyramid: pyramids.Pyramid
    clusters: int = 32
    c: float = 1.0
    codebook_share: float = 1.0  # of points, by hash of image and point
    seed: int = 1
    codebooks: dict[int, np.ndarray] = field(default_factory=dict)
    model: classifiers.Linear | None = None

    def encode(self, stacks: DataFrame) -> DataFrame:
        """id, label, vec: the levels' VLAD vectors joined in order."""
        points = staged(pyramids.pyramid_features(stacks, self.pyramid), "points")
        if not self.codebooks:
            share = F.pmod(F.xxhash64("id", "point"), F.lit(1000)) < int(self.codebook_share * 1000)
            for level in range(self.pyramid.levels):
                self.codebooks[level], _ = encoders.kmeans(points.filter((F.col("level") == level) & share), self.clusters, self.seed)
        parts = None
        for level, centers in self.codebooks.items():
            v = encoders.vlad(points.filter(F.col("level") == level), centers, ["id", "label"]).withColumn("level", F.lit(level))
            parts = v if parts is None else parts.unionByName(v)
        joined = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("level", "vec"))), lambda s: s["vec"]))
        return parts.groupBy("id", "label").agg(joined.alias("vec"))

    def fit(self, stacks: DataFrame) -> PyramidClassifier:
        rows = staged(self.encode(stacks), "encoded")
        width = len(rows.first()["vec"])
        self.model = classifiers.train_linear(rows, width, self.c)
        return self

    def predict(self, stacks: DataFrame) -> DataFrame:
        return classifiers.predicted(self.encode(stacks), self.model)

    def score(self, stacks: DataFrame) -> DataFrame:
        return stats.accuracy(self.predict(stacks), "label", "predicted")
