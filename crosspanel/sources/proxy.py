"""The driver tables as the library's long tables: securities, prices, facts, filings, signals and returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crosspanel.functions.coerce import settle
from crosspanel.operators.asof import asof


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def securities(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.col("s_suppkey").alias("ticker"), F.col("r_name").alias("sector"), F.col("n_name").alias("sub_industry"), F.col("s_acctbal").alias("market_cap"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    raw, adjusted = F.avg(F.col("l_extendedprice") / F.col("l_quantity")), F.avg(F.col("l_extendedprice") * (1 - F.col("l_discount")) / F.col("l_quantity"))
    return l.groupBy(F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("date")).agg(settle(raw).alias("raw_close"), settle(adjusted).alias("adjusted_close"))


def rebalance_dates(p: DataFrame) -> DataFrame:
    return p.groupBy(F.trunc("date", "month").alias("month")).agg(F.max("date").alias("date"))


def grid(p: DataFrame) -> DataFrame:
    """Every rebalance date for every ticker; dates are a few hundred."""
    return p.select("ticker").distinct().crossJoin(F.broadcast(rebalance_dates(p).select("date")))


def price_returns(p: DataFrame, months: tuple[int, ...] = (1, 3, 6, 12)) -> DataFrame:
    """date, ticker, adjusted price as of the date, and its return over each number of months."""
    events = p.select("ticker", F.col("date").alias("_at"), "adjusted_close")
    probes = grid(p).select("ticker", "date", F.explode(F.array(F.lit(0), *[F.lit(m) for m in months])).alias("k"))
    probes = probes.withColumn("probe", F.add_months("date", -F.col("k")))
    seen = asof(probes, events, ["ticker"], "probe", "_at", ["adjusted_close"])
    wide = seen.groupBy("ticker", "date").agg(*[F.max(F.when(F.col("k") == k, F.col("adjusted_close"))).alias(f"p{k}") for k in (0, *months)])
    out = wide.filter("p0 is not null").select("ticker", "date", F.col("p0").alias("adjusted_price"), *[settle(F.try_divide("p0", f"p{m}") - 1).alias(f"return_{m}m") for m in months])
    return out.withColumn("momentum_12_1", settle(F.try_divide(1 + F.col("return_12m"), 1 + F.col("return_1m")) - 1))


def step_returns(p: DataFrame) -> DataFrame:
    """date, ticker, ret: first price after the rebalance date to first price after the next one; null past the end."""
    dates = rebalance_dates(p).select("date").withColumn("next_date", F.lead("date").over(Window.partitionBy().orderBy("date")))  # a row a month
    events = p.select("ticker", F.col("date").alias("_at"), "adjusted_close")
    probes = p.select("ticker").distinct().crossJoin(F.broadcast(dates))
    entry = asof(probes, events, ["ticker"], "date", "_at", ["adjusted_close"], strict=True, forward=True).withColumnRenamed("adjusted_close", "entry")
    both = asof(entry, events, ["ticker"], "next_date", "_at", ["adjusted_close"], strict=True, forward=True).withColumnRenamed("adjusted_close", "exit")
    return both.select("ticker", "date", F.when(F.col("next_date").isNotNull(), settle(F.try_divide("exit", "entry") - 1)).alias("ret"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, ticker, sector, market_cap, score (three-month return), ret (next step)."""
    p = prices(spark, sf_dir)
    scores = price_returns(p, (3, 12, 1)).select("ticker", "date", F.col("return_3m").alias("score"))
    return scores.filter("score is not null").join(step_returns(p), ["ticker", "date"]).join(securities(spark, sf_dir).select("ticker", "sector", "market_cap"), "ticker")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly facts of each supplier: field revenue or tax, value, end (quarter), filed 45 days later, candidate rank."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    quarter = F.trunc("l_shipdate", "quarter")
    sums = l.groupBy(F.col("l_suppkey").alias("ticker"), quarter.alias("start"), (F.ascii("l_returnflag") - 65).alias("rank")).agg(settle(F.sum("l_extendedprice")).alias("revenue"), settle(F.sum(F.col("l_extendedprice") * F.col("l_tax"))).alias("tax"))
    long = sums.unpivot(["ticker", "start", "rank"], ["revenue", "tax"], "field", "value")
    end = F.date_sub(F.add_months("start", 3), 1)
    return long.withColumn("end", end).withColumn("filed", F.date_add("end", 45))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("ticker"), F.to_date("o_orderdate").alias("filed"), F.col("o_orderpriority").alias("form"), F.col("o_orderkey").alias("accession"), F.col("o_totalprice").alias("value"), F.col("o_orderstatus").alias("tier"))
