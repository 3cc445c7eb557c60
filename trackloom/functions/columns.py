"""Column expressions that several operators use. NULL stands for what is missing; NaN never does."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """NULL for NaN and infinite values."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def wrapped(angle: Column) -> Column:
    """In [-pi, pi); an angle that rounding puts just under -pi comes out as pi."""
    return angle - 2 * math.pi * F.floor((angle + math.pi) / (2 * math.pi))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def listed(c: Column) -> Column:
    """Aggregate: the values of a group that are not null, ascending."""
    return F.array_sort(F.collect_list(c))


def mean_of(values: Column) -> Column:
    return ratio(F.aggregate(values, F.lit(0.0), lambda a, v: a + v), F.size(values))


def sd_of(values: Column) -> Column:
    """Population standard deviation of an array."""
    m = mean_of(values)
    return F.sqrt(ratio(F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)), F.size(values)))


def central(values: Column, share: float) -> Column:
    """The central share of an ascending array; all of it if it has fewer than five values."""
    n = F.size(values)
    low = F.floor(n * (0.5 - share / 2)).cast("int")
    high = F.least(F.floor(n * (0.5 + share / 2)).cast("int") + 1, n)
    return F.when((n < 5) | F.lit(share >= 1), values).otherwise(F.slice(values, low + 1, high - low))


def correlation(a: str, b: str) -> Column:
    """Aggregate: Pearson's r of the rows that have both; NULL where one is constant."""
    x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
    return ratio(F.covar_pop(a, b), F.stddev_pop(x) * F.stddev_pop(y))


def circular_r(sin: Column, cos: Column) -> Column:
    """Resultant length from mean sine and cosine."""
    return F.sqrt(sin * sin + cos * cos)


def average_rank(order: Column, partition: list[Column]) -> Column:
    """Rank from 1 with ties averaged."""
    from pyspark.sql import Window

    first = F.rank().over(Window.partitionBy(*partition).orderBy(order))
    return first + (F.count("*").over(Window.partitionBy(*partition, order)) - 1) / 2
