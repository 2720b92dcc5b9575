"""Arithmetic on arrays of double, as higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """Length one; the zero vector stays zero."""
    n = norm(v)
    # the norm stands outside the lambda, where it is told once a row and not once an element
    return F.when(n == 0, v).otherwise(F.zip_with(v, F.array_repeat(n, F.size(v)), lambda x, y: x / y))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def mean_by(rows: DataFrame, keys: list[str], vec: str, out: str = "mean") -> DataFrame:
    """Element-wise mean per group, all partial sums map-side: one row a dimension and group is shuffled."""
    parts = rows.select(*keys, F.posexplode(vec).alias("_k", "_x")).groupBy(*keys, "_k").agg(F.avg("_x").alias("_m"))
    return parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_m"))), lambda s: s["_m"]).alias(out))


def drift(a: Column, b: Column) -> Column:
    """Greatest absolute difference of two vectors."""
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def mixture(row: Column) -> Column:
    """Scaled to sum one; a row of zeros stays."""
    total = F.aggregate(row, F.lit(0.0), lambda s, x: s + x)
    return F.when(total <= 0, row).otherwise(F.transform(row, lambda x: x / total))
