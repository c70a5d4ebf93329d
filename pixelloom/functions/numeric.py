"""Rounding, clamping and ordered picks, as the raster operators need them."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Nearest integer, halves toward plus infinity (Spark's round goes away from zero)."""
    return F.floor(x + F.lit(0.5)).cast("int")


def clamp(x: Column, low, high) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def clamp_byte(x: Column) -> Column:
    return clamp(half_up(x), 0, 255)


def store_byte(x: Column) -> Column:
    """What a clamped byte array stores: halves go to even."""
    return clamp(F.bround(x), 0, 255).cast("int")


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def pick(values: str, at: Column, groups: list[str]):
    """Of rows sorted by `values` within groups, the one with index `at` (from 0; may use the column _n, the count)."""

    def of(df):
        w = Window.partitionBy(*groups)
        ranked = df.withColumns({"_i": F.row_number().over(w.orderBy(values)) - 1, "_n": F.count(F.lit(1)).over(w)})
        return ranked.where(F.col("_i") == at).drop("_i", "_n")

    return of


def upper_middle() -> Column:
    """Index of the upper median, for pick()."""
    return F.floor(F.col("_n") / 2)


def percentile_95() -> Column:
    return F.least(F.col("_n") - 1, F.floor(F.col("_n") * 0.95))


def snap_32(v: Column) -> Column:
    return F.greatest(F.lit(32), F.floor(v / 32 + 0.5).cast("int") * 32)
