"""Bucket portfolios: weights, turnover, costs, returns and performance, as aggregations over holdings tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.operators.xsec import bucket


def equal_weights(scores: DataFrame, by: list[str]) -> DataFrame:
    """scores (by, ticker, score) -> the same with bucket and weight 1/n inside the bucket; none below three names."""
    out = scores.filter("score is not null").withColumn("bucket", bucket("score", "ticker", by)).filter("bucket is not null")
    return out.withColumn("weight", 1.0 / F.count(F.lit(1)).over(Window.partitionBy(*by, "bucket")))


def sector_neutral_weights(scores: DataFrame, by: list[str]) -> DataFrame:
    """Buckets inside each sector of three names and more; sectors weigh alike in a bucket, names alike in a sector."""
    some = scores.filter("score is not null and sector is not null")
    out = some.withColumn("bucket", bucket("score", "ticker", [*by, "sector"])).filter("bucket is not null")
    out = out.withColumn("_sectors", F.size(F.collect_set("sector").over(Window.partitionBy(*by)))).filter("_sectors >= 2")
    here = Window.partitionBy(*by, "bucket")
    weight = 1.0 / F.size(F.collect_set("sector").over(here)) / F.count(F.lit(1)).over(Window.partitionBy(*by, "bucket", "sector"))
    out = out.withColumn("weight", weight)
    return out.withColumn("weight", F.col("weight") / F.sum("weight").over(here)).drop("_sectors")


def turnover(holdings: DataFrame, by: list[str], date: str = "date") -> DataFrame:
    """by, date, turnover: the sum of weights at first, later half the absolute change from the group's date before."""
    now = holdings.select(*by, date, "ticker", "weight").withColumn("_k", F.dense_rank().over(Window.partitionBy(*by).orderBy(date)))
    before = now.select(*by, "ticker", (F.col("_k") + 1).alias("_k"), F.col("weight").alias("_before"))
    dates = now.select(*by, "_k", date).distinct()
    both = now.drop(date).join(before, [*by, "_k", "ticker"], "full").join(dates, [*by, "_k"])
    moved = F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("_before", F.lit(0.0))))
    return both.groupBy(*by, date, "_k").agg(moved.alias("_moved")).select(*by, date, F.when(F.col("_k") == 1, F.col("_moved")).otherwise(F.col("_moved") / 2).alias("turnover"))


def apply_costs(monthly: DataFrame, bps: list[float]) -> DataFrame:
    levels = monthly.sparkSession.createDataFrame([(float(b),) for b in bps], "cost_bps double")
    return monthly.crossJoin(F.broadcast(levels)).withColumn("net_return", F.col("gross_return") - F.col("turnover") * F.col("cost_bps") / 1e4)


def wealth(returns: DataFrame, by: list[str], date: str = "date", ret: str = "ret") -> DataFrame:
    run = Window.partitionBy(*by).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    grown = returns.filter(F.col(ret).isNotNull()).withColumn("wealth", F.product(1 + F.col(ret)).over(run))
    return grown.withColumn("drawdown", F.col("wealth") / F.max("wealth").over(run) - 1)


def performance(returns: DataFrame, by: list[str], date: str = "date", ret: str = "ret") -> DataFrame:
    """months, cumulative, annualised, volatility, sharpe, max_drawdown (the running top starts at the first wealth)."""
    total = F.max_by("wealth", date)
    spread = F.stddev_pop(ret)
    return wealth(returns, by, date, ret).groupBy(*by).agg(
        F.count("*").alias("months"), (total - 1).alias("cumulative"), F.when(total > 0, F.pow(total, 12 / F.count("*")) - 1).alias("annualised"),
        (spread * 12**0.5).alias("volatility"), F.when(spread > 1e-12, F.avg(ret) / spread * 12**0.5).alias("sharpe"), F.min("drawdown").alias("max_drawdown"))
