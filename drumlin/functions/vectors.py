"""Vector expressions over array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GENERATED_DIM = 32


def square_dist(a: Column, b: Column, dim: int) -> Column:
    """Sum of squared differences, left to right: one generated expression in few dimensions,
    a fold in many, where generated code would outgrow what the compiler takes."""
    if dim > GENERATED_DIM:
        return F.aggregate(F.zip_with(a, b, lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double"))), F.lit(0.0), lambda t, v: t + v)
    total = None
    for i in range(dim):
        d = a[i].cast("double") - b[i].cast("double")
        total = d * d if total is None else total + d * d
    return F.lit(0.0) if total is None else total


def dist(a: Column, b: Column, dim: int) -> Column:
    return F.sqrt(square_dist(a, b, dim))


def in_range(goal: Column, x: Column, radius: Column) -> Column:
    return F.abs(goal - x) <= radius


def norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda t, v: t + v.cast("double") * v.cast("double")))


def normalize(x: Column) -> Column:
    """x / |x|; the zero vector stays as it is."""
    return F.element_at(F.transform(F.array(norm(x)), lambda n: F.transform(x, lambda v: F.when(n > 0, v.cast("double") / n).otherwise(v.cast("double")))), 1)


def quantize(x: Column, bin_width: float) -> Column:
    """floor(v / bin) * bin + bin / 2 for each coordinate; bin <= 0 changes nothing."""
    if bin_width <= 0:
        return x
    b = float(bin_width)
    return F.transform(x, lambda v: F.floor(v.cast("double") / b).cast("double") * b + b / 2)


def cast_cloud(x: Column, dtype: str) -> Column:
    return F.transform(x, lambda v: v.cast(dtype))
