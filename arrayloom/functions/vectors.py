"""Column functions on vectors (array<double>) and on complex numbers (struct<re, im>)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    """The sum of a vector, from the first value to the last."""
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def l2_unit(v: Column) -> Column:
    """v over its length; a zero vector as it is."""
    return F.when(norm(v) == 0, v).otherwise(F.transform(v, lambda x: x / norm(v)))


def scaled(v: Column, length: Column) -> Column:
    """v over a length taken beforehand (so that it is taken once); zeros where that is 0."""
    return F.transform(v, lambda x: F.when(length == 0, 0.0).otherwise(x / length))


def min_max(v: Column, lb: float, ub: float, low: Column, high: Column) -> Column:
    """v from low..high to lb..ub; unchanged where low equals high."""
    return F.transform(v, lambda x: F.when(high == low, x).otherwise((x - low) / (high - low) * (ub - lb) + lb))


def signed_root(v: Column) -> Column:
    """sign(x) times the root of |x|."""
    return F.transform(v, lambda x: F.signum(x) * F.sqrt(F.abs(x)))


def weighted_mean(weights: Column, v: Column) -> Column:
    return dot(weights, v) / total(weights)


def kl_to_middle(a: Column, b: Column) -> Column:
    """The sum of x ln(x / ((x + y) / 2)) over nonzero x."""
    return total(F.zip_with(a, b, lambda x, y: F.when(x == 0, 0.0).otherwise(x * F.log(x / ((x + y) / 2)))))


def decoded(c: Column) -> Column:
    """An sRGB value of 0..1 to linear light."""
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def encoded(c: Column) -> Column:
    """Linear light to sRGB."""
    return F.when(c <= 0.0031308, 12.92 * c).otherwise(1.055 * F.pow(c, F.lit(1 / 2.4)) - 0.055)


def luminance(r: Column, g: Column, b: Column, bound: float) -> Column:
    """Grey of sRGB colours of 0..bound, through linear light."""
    y = 0.2126 * decoded(r / bound) + 0.7152 * decoded(g / bound) + 0.0722 * decoded(b / bound)
    return encoded(y) * bound


def opponency(r: Column, g: Column, b: Column) -> list[Column]:
    """Red against green, blue against yellow, and their sum; 0 where the divisor is."""
    y = (r + g) / 2
    ratio = lambda p, q: F.when(p + q == 0, 0.0).otherwise((p - q) / (p + q))
    return [ratio(r, g), ratio(b, y), r + g + b]


def angle(x: Column, y: Column) -> Column:
    """The angle of (x, y) in [0, 2 pi); 0 at the origin."""
    a = F.atan2(y, x)
    return F.when((x == 0) & (y == 0), 0.0).when(a < 0, a + 2 * math.pi).otherwise(a)


def cis(phase: Column) -> tuple[Column, Column]:
    """The unit complex number of a phase."""
    return F.cos(phase), F.sin(phase)


def times(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def smaller_ratio(a: Column, b: Column) -> Column:
    """min(a / b, b / a); 0 where either is."""
    return F.when((a == 0) | (b == 0), 0.0).otherwise(F.least(a / b, b / a))
