"""Approximate membership on past dates from a current list and change events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.operators.asof import asof


def membership_on_dates(current: DataFrame, changes: DataFrame, dates: DataFrame) -> DataFrame:
    """current (ticker), changes (ticker, date, kind added/removed, seq), dates (date) -> (date, ticker) of members.

    Walking back from now, the earliest change after a date decides: added means out before it, removed means in.
    Without one the current state holds. Of changes on a day the one of the lowest seq comes first; dates are few.
    """
    known = current.select("ticker").unionByName(changes.select("ticker")).distinct()
    probes = known.crossJoin(F.broadcast(dates.select("date").distinct()))
    nxt = asof(probes, changes.select("ticker", F.col("date").alias("_at"), "kind", "seq"), ["ticker"], "date", "_at", ["kind"], strict=True, forward=True, order=["seq"])
    now = current.select("ticker", F.lit(True).alias("_now")).distinct()
    state = nxt.join(now, "ticker", "left")
    return state.filter((F.col("kind") == "removed") | (F.col("kind").isNull() & F.col("_now"))).select("date", "ticker")


#: Missing features that a member of the broad universe may have; the clean one has none.
BROAD = 2


def with_null_count(matrix: DataFrame, features: list[str]) -> DataFrame:
    return matrix.withColumn("feature_null_count", sum((F.col(f).isNull().cast("int") for f in features), F.lit(0)))


def universe_filter(matrix: DataFrame, universe: str) -> DataFrame:
    """Rows of the clean or broad universe by feature_null_count."""
    return matrix.filter(F.col("feature_null_count") <= {"clean": 0, "broad": BROAD}[universe])


def by_universe(matrix: DataFrame) -> DataFrame:
    """matrix with universe: a row for each universe that it is in, so that one job serves all of them."""
    names = F.array_compact(F.array(F.when(F.col("feature_null_count") <= BROAD, "broad"), F.when(F.col("feature_null_count") <= 0, "clean")))
    return matrix.withColumn("universe", F.explode(names))


def universe_counts(matrix: DataFrame, date: str = "date") -> DataFrame:
    n = lambda most: F.count(F.when(F.col("feature_null_count") <= most, 1))
    return matrix.groupBy(date).agg(n(BROAD).alias("broad_count"), n(0).alias("clean_count"))
