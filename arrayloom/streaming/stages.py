"""Array stages over streams: stateless ones as they are, and running statistics with state kept by Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Fixed value: the state store that keyed state with timers needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def arrays(spark: SparkSession, path: str, schema: str, files_each: int = 8) -> DataFrame:
    """A stream of a folder's Parquet files, files_each at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)


def through(stream: DataFrame, *stages: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stages without shuffles (geometry, filters, assignments, projections) apply to streams unchanged."""
    for stage in stages:
        stream = stage(stream)
    return stream


def timed(stream: DataFrame, ts: str, late: str) -> DataFrame:
    """stream with its event time as a timestamp (one without a zone is read in the session's) and a watermark on it."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def windowed_moments(stream: DataFrame, ts: str, x: Column, window: str, late: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """By window of event time and keys: count, mean and variance; rows later than `late` are dropped."""
    w = timed(stream, ts, late).groupBy(F.window(ts, window), *keys)
    return w.agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("var"))


def running_histogram(stream: DataFrame, ts: str, bin_: Column, window: str, late: str) -> DataFrame:
    """By window and bin: counts."""
    return timed(stream, ts, late).groupBy(F.window(ts, window), bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


class Fold(StatefulProcessor):
    """A key's fold: its state, and a timer at its last event time plus `idle` milliseconds that closes it."""

    def __init__(self, keys: list[str], idle: int, start: tuple, step: Callable, result: Callable, state: str, names: list[str]) -> None:
        self.keys, self.idle, self.start, self.step, self.result, self.schema, self.names = keys, idle, start, step, result, state, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("fold", "last long, " + self.schema)

    def row(self, key: tuple, closed: bool, state: tuple) -> pd.DataFrame:
        return pd.DataFrame([(*key, closed, *self.result(state))], columns=[*self.keys, "closed", *self.names])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, *state = self.state.get() if self.state.exists() else (-(1 << 62), *self.start)
        before, state = last, tuple(state)
        for batch in rows:
            if len(batch):
                state = self.step(state, batch)
                last = max(last, int(batch["ms_"].max()))
        if last > before:
            if before + self.idle > 0 and self.state.exists():
                self.handle.deleteTimer(before + self.idle)
            self.handle.registerTimer(last + self.idle)
        self.state.update((last, *state))
        yield self.row(key, False, state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            _, *state = self.state.get()
            self.state.clear()
            yield self.row(key, True, tuple(state))

    def close(self) -> None:
        pass


def folded(stream: DataFrame, keys: dict[str, str], ts: str, late: str, idle: int, start: tuple, step: Callable[[tuple, pd.DataFrame], tuple], result: Callable[[tuple], tuple], state: str, out: str) -> DataFrame:
    """A fold over each key's rows: keys, closed, and the columns of `out`, one row for each key and batch that has rows of it.

    step(state, rows) takes a key's rows of one batch, in parts and in no order
    of time; result(state) gives the values of `out`. State lies in Spark's
    store, so a query started again from its checkpoint goes on where it was.
    A key without rows for `idle` milliseconds of event time is closed: its last
    result comes with closed = true, its state goes, and later rows start anew.
    Rows later than `late`, and those whose time is null, take no part. The
    session's state store is set to STORE. keys
    gives the types by name; `state` and `out` are schemas of plain types.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = timed(stream.filter(F.col(ts).isNotNull()), ts, late).withColumn("ms_", F.unix_millis(ts))
    names = [f.split()[0] for f in out.split(", ")]
    schema = ", ".join([*(f"{k} {t}" for k, t in keys.items()), "closed boolean", out])
    fold = Fold(list(keys), idle, start, step, result, state, names)
    return rows.groupBy(*keys).transformWithStateInPandas(fold, schema, "Append", "EventTime")


def folded_moments(stream: DataFrame, keys: dict[str, str], ts: str, x: Column, late: str, idle: int) -> DataFrame:
    """By key so far: n, mean and variance of x over all rows, without windows. Null values take no part; n = 0 gives nulls."""

    def step(state: tuple, rows: pd.DataFrame) -> tuple:
        n, mean, m2 = state
        v = rows["x_"].dropna().to_numpy(dtype=float)
        if not len(v):
            return state
        # Two groups' squares about their own means, and what lies between the means.
        gap, both = v.mean() - mean, n + len(v)
        return both, float(mean + gap * len(v) / both), float(m2 + ((v - v.mean()) ** 2).sum() + gap * gap * n * len(v) / both)

    def result(state: tuple) -> tuple:
        n, mean, m2 = state
        return (int(n), mean, m2 / n) if n else (0, np.nan, np.nan)

    return folded(stream.withColumn("x_", x.cast("double")), keys, ts, late, idle, (0, 0.0, 0.0), step, result, "n long, mean double, m2 double", "n long, mean double, var double")


def written(stream: DataFrame, path: str, checkpoint: str):
    """Started with what there is now, appended as Parquet; a restart with the same checkpoint goes on from there."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
