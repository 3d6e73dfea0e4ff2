"""Fourier transforms: relational for small grids, numpy in Arrow batches for any size."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dft2(df: DataFrame, rows: int, cols: int, inverse: bool = False) -> DataFrame:
    """(id, c, y, x, re, im) to its spectrum (id, c, ky, kx, re, im), or back.

    A separable pair of joins with tables of frequencies: each value meets cols
    frequencies, then each row sum rows of them. The inverse divides by rows * cols.
    """
    sign = 1 if inverse else -1
    n = rows * cols if inverse else 1

    def along(t: DataFrame, pos: str, freq: str, length: int, keep: list[str]) -> DataFrame:
        k = t.withColumn(freq, F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
        # k * pos is taken modulo the length, so the angle is exact.
        a = sign * 2 * math.pi * ((F.col(freq) * F.col(pos)) % length) / length
        re, im = F.cos(a) * F.col("re") - F.sin(a) * F.col("im"), F.cos(a) * F.col("im") + F.sin(a) * F.col("re")
        return k.groupBy(*keep, freq).agg(F.sum(re).alias("re"), F.sum(im).alias("im"))

    first = along(df.select("id", "c", "y", "x", "re", "im"), "x", "kx", cols, ["id", "c", "y"])
    out = along(first, "y", "ky", rows, ["id", "c", "kx"])
    return out.select("id", "c", "ky", "kx", (F.col("re") / n).alias("re"), (F.col("im") / n).alias("im"))


def convolve(df: DataFrame, kernel: DataFrame, rows: int, cols: int) -> DataFrame:
    """Circular convolution of (id, c, y, x, re, im) with kernel (y, x, re, im): transforms, a product, and back."""
    spectrum = dft2(df, rows, cols)
    k = dft2(kernel.withColumns({"id": F.lit(0), "c": F.lit(0)}), rows, cols).select("ky", "kx", F.col("re").alias("kre"), F.col("im").alias("kim"))
    product = spectrum.join(F.broadcast(k), ["ky", "kx"])  # rows * cols rows
    re, im = F.col("re") * F.col("kre") - F.col("im") * F.col("kim"), F.col("re") * F.col("kim") + F.col("im") * F.col("kre")
    back = product.select("id", "c", F.col("ky").alias("y"), F.col("kx").alias("x"), re.alias("re"), im.alias("im"))
    return dft2(back, rows, cols, inverse=True).withColumnsRenamed({"ky": "y", "kx": "x"})


def centred(df: DataFrame) -> DataFrame:
    """Values times (-1)^(x + y), which centres the spectrum."""
    s = F.when((F.col("x") + F.col("y")) % 2 == 0, 1.0).otherwise(-1.0)
    return df.withColumns({"re": F.col("re") * s, "im": F.col("im") * s})


def transformed(df: DataFrame, shape: tuple[int, ...], axes: tuple[int, ...], kind: str = "fft") -> DataFrame:
    """(id, re, im: arrays) through numpy: kind fft, ifft (over the transformed size), ifft_plain (not), or rfft of re."""
    if kind not in ("fft", "ifft", "ifft_plain", "rfft"):
        raise ValueError(kind)
    size = math.prod(shape[a] for a in axes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            z = (np.stack(b["re"].to_list()) + 1j * np.stack(b["im"].to_list())).reshape(len(b), *shape)
            ax = tuple(a + 1 for a in axes)
            if kind == "rfft":
                out = np.fft.rfftn(z.real, axes=ax)
            elif kind == "fft":
                out = np.fft.fftn(z, axes=ax)
            else:
                out = np.fft.ifftn(z, axes=ax) * (size if kind == "ifft_plain" else 1)
            out = out.reshape(len(b), -1)
            yield pd.DataFrame({"id": b["id"], "re": list(out.real), "im": list(out.imag)})

    return df.select("id", "re", "im").mapInPandas(run, "id long, re array<double>, im array<double>")
