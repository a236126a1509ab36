"""Cross-sectional statistics within partitions. Nulls stay null and take no part."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def clip(x: Column, low: Column, high: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def winsorize(x: str, by: list[str], low: float = 0.01, high: float = 0.99) -> Column:
    """Clipped at linearly interpolated quantiles of the partition."""
    w = Window.partitionBy(*by)
    return clip(F.col(x), F.percentile(x, F.lit(low)).over(w), F.percentile(x, F.lit(high)).over(w))


def zscore(x: Column, by: list[str]) -> Column:
    """Population z-score; zero where the spread is zero. A null key is a partition of its own."""
    w = Window.partitionBy(*by)
    spread = F.stddev_pop(x).over(w)
    return F.when(x.isNotNull(), F.when(spread > 1e-12, (x - F.avg(x).over(w)) / spread).otherwise(0.0))


def doubled_rank(x: Column, by: list[str]) -> Column:
    """Twice the rank from one, ties averaged: a whole number."""
    low = F.rank().over(Window.partitionBy(*by, x.isNull()).orderBy(x))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, x))
    return F.when(x.isNotNull(), 2 * low + ties - 1)


def average_rank(x: Column, by: list[str]) -> Column:
    """Rank from one, ties averaged."""
    return doubled_rank(x, by) / 2


def pct_rank_01(x: Column, by: list[str]) -> Column:
    n = F.count(x).over(Window.partitionBy(*by))
    return F.when(x.isNotNull(), F.when(n == 1, 0.5).otherwise(F.try_divide(average_rank(x, by) - 1, n - 1)))


def decile(p: Column) -> Column:
    return F.least(F.lit(9), F.greatest(F.lit(0), F.floor(p * 10))).cast("int")


def median_impute(x: str, by: list[str]) -> Column:
    return F.coalesce(F.col(x), F.percentile(x, F.lit(0.5)).over(Window.partitionBy(*by)), F.lit(0.0))


def bucket_small(score: str, ticker: str, by: list[str]) -> Column:
    """As bucket, but names without a score are not counted and have none, and fewer than three are all in Q1."""
    named = F.col(score).isNotNull()
    n = F.count(score).over(Window.partitionBy(*by))
    i = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), F.col(ticker))) - 1
    third, fifth = F.floor(i * 3 / n), F.floor(i * 5 / n)
    place = F.when(n < 3, F.lit(0)).when(n < 50, 2 * third).otherwise(fifth) + 1
    return F.when(named, F.concat(F.lit("Q"), place.cast("string")))


def bucket(score: str, ticker: str, by: list[str]) -> Column:
    """Q1 the highest: under 3 names none, under 50 terciles (Q1, Q3, Q5), else quintiles; i*k/n of the rank, stable by ticker."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    i = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(ticker))) - 1
    third, fifth = F.expr("0") + F.floor(i * 3 / n), F.floor(i * 5 / n)
    return F.when(n < 3, None).when(n < 50, F.concat(F.lit("Q"), (2 * third + 1).cast("string"))).otherwise(F.concat(F.lit("Q"), (fifth + 1).cast("string")))
