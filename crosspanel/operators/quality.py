"""Data-quality checks as small result tables: one row per check with the number of offending rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def failures(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, bad): rows for which each condition fails or is null, in one pass."""
    row = df.agg(*[F.count(F.when(F.coalesce(ok, F.lit(False)), None).otherwise(1)).alias(name) for name, ok in checks.items()])
    return row.unpivot([], list(checks), "check", "bad")


def check_columns(df: DataFrame, required: list[str], forbidden: list[str] = ()) -> DataFrame:
    """(column, problem): required columns that df lacks and forbidden ones that it has."""
    wrong = [(c, "missing") for c in required if c not in df.columns] + [(c, "forbidden") for c in forbidden if c in df.columns]
    return df.sparkSession.createDataFrame(wrong, "column string, problem string")


def check_counts(df: DataFrame, expected: DataFrame, keys: list[str], conditions: dict[str, Column]) -> DataFrame:
    """(check, found, expected, ok): rows, distinct keys and rows of each condition, in one pass over df, beside the one
    row of expected, whose columns are rows, keys and the names of the conditions (a column that is absent: not ok)."""
    names = ["rows", "keys", *conditions]
    found = df.agg(F.count("*").alias("rows"), F.countDistinct(*keys).alias("keys"), *[F.count(F.when(ok, 1)).alias(n) for n, ok in conditions.items()])
    told = expected.select(*[(F.col(n).cast("long") if n in expected.columns else F.lit(None).cast("long")).alias(n) for n in names])
    both = found.unpivot([], names, "check", "found").join(told.unpivot([], names, "check", "expected"), "check")  # a row for each check
    return both.withColumn("ok", F.coalesce(F.col("found") == F.col("expected"), F.lit(False)))


def return_coverage(df: DataFrame, returns: list[str]) -> DataFrame:
    """(horizon, rows, non_null, share, status): blocked without any return, partial with some, else complete."""
    row = df.agg(F.count("*").alias("rows"), *[F.count(r).alias(r) for r in returns])
    long = row.unpivot(["rows"], returns, "horizon", "non_null")
    status = F.when(F.col("non_null") == 0, "blocked").when(F.col("non_null") < F.col("rows"), "partial").otherwise("complete")
    return long.select("horizon", "rows", "non_null", F.try_divide("non_null", "rows").alias("share"), status.alias("status"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def constant_panels(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.countDistinct(value).alias("distinct_values")).filter("n > 1 and distinct_values < 2")


def absolute_paths(df: DataFrame) -> DataFrame:
    """Rows any of whose values, nested ones too, looks like an absolute path."""
    return df.filter(F.rlike(F.to_json(F.struct(*df.columns)), F.lit(r'"(/(home|Users|root|tmp|var|mnt)/|[A-Za-z]:\\\\)')))


def fingerprint(df: DataFrame) -> DataFrame:
    """n, digest: independent of the order of rows and of partitions."""
    h = F.xxhash64(*sorted(df.columns))
    return df.agg(F.count("*").alias("n"), F.concat_ws("-", F.hex(F.bit_xor(h)), F.hex(F.sum(F.pmod(h, F.lit(1 << 31))))).alias("digest"))


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    counted = [df.agg(F.lit(c).alias("feature"), F.count(c).alias("non_null"), F.avg(F.col(c).isNotNull().cast("double")).alias("share")) for c in columns]
    return reduce(DataFrame.unionByName, counted)


def summary_row(df: DataFrame, columns: list[str], by_count: dict[str, Column] | None = None) -> DataFrame:
    """One row in one pass: rows, <column>_coverage, and a count for each named condition."""
    shares = [F.avg(F.col(c).isNotNull().cast("double")).alias(f"{c}_coverage") for c in columns]
    counts = [F.count(F.when(ok, 1)).alias(name) for name, ok in (by_count or {}).items()]
    return df.agg(F.count("*").alias("rows"), *shares, *counts)
