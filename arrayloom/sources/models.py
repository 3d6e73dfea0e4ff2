"""Models as Parquet tables: saved, loaded, and trained only where none is there yet.

A model is named arrays of numbers. A row holds one array's slice along its
first axis, so a model of any size is many rows, and Spark's committer writes it
whole or not at all.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from ..operators.classifiers import Kernel, Linear
from ..operators.mixtures import Ppca

SCHEMA = "part string, pos long, shape array<long>, data array<double>"


def to_arrays(model) -> dict[str, np.ndarray]:
    """The arrays of a model: a Linear, kernel machines by label, a list of Ppca, arrays in a tuple or by name."""
    if isinstance(model, Linear):
        return {"linear/labels": np.array(model.labels), "linear/weights": model.weights}
    if isinstance(model, list) and model and isinstance(model[0], Ppca):
        return {f"ppca/{i}/{name}": np.atleast_1d(getattr(m, name)) for i, m in enumerate(model) for name in ("weight", "mu", "w", "noise")}
    if isinstance(model, dict) and model and isinstance(next(iter(model.values())), Kernel):
        kinds = ("linear", "poly", "rbf", "precomputed")
        out = {}
        for i, (label, k) in enumerate(model.items()):
            out |= {f"kernel/{i}/vectors": k.vectors, f"kernel/{i}/alphas": k.alphas, f"kernel/{i}/rest": np.array([label, k.bias, kinds.index(k.kind), k.gamma, k.degree])}
        return out
    if isinstance(model, dict):
        return {f"named/{name}": np.asarray(a, dtype=float) for name, a in model.items()}
    return {f"tuple/{i}": np.asarray(a, dtype=float) for i, a in enumerate(model)}


def of_arrays(arrays: dict[str, np.ndarray]):
    """The model that to_arrays() took apart."""
    kind = next(iter(arrays)).split("/")[0]
    if kind == "linear":
        return Linear(tuple(arrays["linear/labels"].tolist()), arrays["linear/weights"])
    count = 1 + max((int(name.split("/")[1]) for name in arrays if name.split("/")[1].isdigit()), default=-1)
    if kind == "ppca":
        at = lambda i, name: arrays[f"ppca/{i}/{name}"]
        return [Ppca(float(at(i, "weight")[0]), at(i, "mu"), at(i, "w"), float(at(i, "noise")[0])) for i in range(count)]
    if kind == "kernel":
        out = {}
        for i in range(count):
            label, bias, form, gamma, degree = arrays[f"kernel/{i}/rest"].tolist()
            out[label] = Kernel(arrays[f"kernel/{i}/vectors"], arrays[f"kernel/{i}/alphas"], bias, ("linear", "poly", "rbf", "precomputed")[int(form)], gamma, int(degree))
        return out
    if kind == "named":
        return {name.split("/", 1)[1]: a for name, a in arrays.items()}
    return tuple(arrays[f"tuple/{i}"] for i in range(count))


def model_rows(model) -> list[tuple]:
    """A model's rows by SCHEMA."""
    rows = []
    for name, a in to_arrays(model).items():
        a = np.asarray(a, dtype=float)
        slices = a.reshape(len(a), -1) if a.ndim else a.reshape(1, 1)
        rows += [(name, i, list(a.shape), [float(x) for x in s]) for i, s in enumerate(slices)] or [(name, -1, list(a.shape), [])]
    return rows


def save(spark: SparkSession, model, path: str) -> None:
    """An error if there is something at path. Empty arrays and single numbers are kept as they are."""
    spark.createDataFrame(model_rows(model), SCHEMA).write.parquet(path)


def rows_of(spark: SparkSession, path: str) -> DataFrame:
    """A saved model's rows: part, pos, shape, data."""
    return spark.read.schema(SCHEMA).parquet(path)


def load(spark: SparkSession, path: str):
    """The model that save() wrote."""
    return of_rows(rows_of(spark, path))


def of_rows(table: DataFrame):
    """The model of rows by SCHEMA."""
    parts: dict[str, list] = {}
    for r in table.orderBy("part", "pos").collect():
        parts.setdefault(r["part"], []).append(r)
    return of_arrays({name: np.array([x for r in rows for x in r["data"]]).reshape(rows[0]["shape"]) for name, rows in parts.items()})


def trained_once(spark: SparkSession, path: str, train: Callable[[], object]):
    """The model at path; where there is none, train() makes it and it is saved. So a run that starts again goes on from what is done."""
    try:
        return load(spark, path)
    except AnalysisException:
        save(spark, train(), path)
        return load(spark, path)


def magnitude_stats(df: DataFrame, filter_: str, magnitude: str) -> dict[str, np.ndarray]:
    """By filter, mean and variance of magnitudes (rows of filter number and magnitude), for normalised features."""
    rows = df.groupBy(filter_).agg(F.avg(magnitude).alias("mean"), F.var_pop(magnitude).alias("var")).orderBy(filter_).collect()
    return {"filter": np.array([r[0] for r in rows], dtype=float), "mean": np.array([r["mean"] for r in rows]), "variance": np.array([r["var"] for r in rows])}


class Rounds:
    """A model's rounds of training at a path: one folder of rows a round, so that training stopped in any of them goes on.

    A round's rows carry their number, and a round with fewer isn't whole: it
    is left out, and written anew when training gets there. Whoever resumes has
    to give the same data and parameters; `about` names them, and rounds
    written under another name are an error.
    """

    def __init__(self, spark: SparkSession, path: str, about: str = "") -> None:
        self.spark, self.path, self.about = spark, path, about

    def keep(self, number: int, model) -> None:
        """Rows are counted before they are written, into one file."""
        rows = model_rows(model)
        schema = SCHEMA + ", whole long, about string"
        table = self.spark.createDataFrame([(*r, len(rows), self.about) for r in rows], schema)
        table.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/round={number}")

    def last(self) -> tuple[int, object] | None:
        """The number and model of the last whole round; None where there is none."""
        try:
            table = self.spark.read.parquet(self.path)
        except AnalysisException:
            return None
        sizes = table.groupBy("round").agg(F.count(F.lit(1)).alias("n"), F.max("whole").alias("whole"), F.max("about").alias("about"))
        found = sizes.filter(F.col("n") == F.col("whole")).orderBy(F.desc("round")).first()
        if found is None:
            return None
        if found.about != self.about:
            raise ValueError(f"the rounds at {self.path} are those of {found.about!r}, not {self.about!r}")
        return int(found["round"]), of_rows(table.filter(F.col("round") == found["round"]))
