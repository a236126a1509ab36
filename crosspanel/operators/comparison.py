"""Comparison of signals and strategies: status tables, readiness, gaps between return series, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.operators import portfolio
from crosspanel.operators.xsec import bucket_small

DECOMPOSITIONS = ["global", "within_sector", "across_sector"]


def signal_comparison(summary: DataFrame, expected: DataFrame, least_months: int = 12) -> DataFrame:
    """summary (signal, decomposition, months, mean_ic) against the expected signals: a column for each decomposition, and a status.

    expected is a list of names and small by nature; the summary has three rows a signal.
    """
    wide = summary.groupBy("signal").pivot("decomposition", DECOMPOSITIONS).agg(F.first("mean_ic").alias("mean_ic"), F.first("months").alias("months"))
    seen = wide.withColumn("_seen", F.lit(1))
    lacking = F.array_contains(F.array(*[F.col(f"{d}_months").isNull() for d in DECOMPOSITIONS]), True)
    status = F.when(F.col("_seen").isNull(), "missing_signal").when(lacking, "blocked_missing_decomposition").when(F.col("global_months") < least_months, "diagnostic_insufficient_history").otherwise("available")
    return expected.join(seen, "signal", "left").withColumn("status", status).drop("_seen")


def diagnostic_status(panel: DataFrame, returns: list[str], least_months: int = 12) -> DataFrame:
    """One row: paired rows of each return column, blockers, and the first return column that has any."""
    paired = [F.count(F.when(F.col("score").isNotNull() & F.col(r).isNotNull(), 1)).alias(f"{r}_paired") for r in returns]
    one = panel.agg(F.countDistinct("date").alias("months"), F.countDistinct("sector").alias("sectors"), *paired)
    none = [F.when(F.col(f"{r}_paired") == 0, F.lit(f"no_coverage_{r}")) for r in returns]
    overlap = F.greatest(*[F.col(f"{r}_paired") for r in returns], F.lit(0)) == 0
    blockers = F.array_compact(F.array(F.when(overlap, F.lit("no_overlap")), *none, F.when(F.col("months") < least_months, F.lit("short_history")), F.when(F.col("sectors") < 2, F.lit("few_sectors"))))
    primary = F.coalesce(*[F.when(F.col(f"{r}_paired") > 0, F.lit(r)) for r in returns])
    return one.withColumns({"primary_return": primary, "blockers": F.array_join(blockers, ",")})


def outperformance(a: DataFrame, b: DataFrame, by: list[str], date: str = "date") -> DataFrame:
    """Series a and b (by, date, ret) on common dates: hit rate, gaps, and whether a beats b by both."""
    both = a.select(*by, date, F.col("ret").alias("ra")).join(b.select(*by, date, F.col("ret").alias("rb")), [*by, date]).filter("ra is not null and rb is not null")
    total = lambda c: F.product(1 + F.col(c))
    n = F.count("*")
    annual = lambda c: F.when(total(c) > 0, F.pow(total(c), 12 / n) - 1)
    gaps = both.groupBy(*by).agg(n.alias("months"), F.avg((F.col("ra") > F.col("rb")).cast("double")).alias("hit_rate"), (annual("ra") - annual("rb")).alias("annual_gap"), (total("ra") - total("rb")).alias("cumulative_gap"))
    return gaps.withColumn("beats", (F.col("annual_gap") > 0) & (F.col("hit_rate") > 0.5))


def holdings_report(held: DataFrame, turnovers: DataFrame, by: list[str], bps: list[float]) -> DataFrame:
    """A row per name and cost level: cost = turnover of the bucket x rate x weight, net = ret - cost."""
    rows = held.join(turnovers, [*by, "date"]).withColumn("cost_bps", F.explode(F.array(*[F.lit(float(b)) for b in bps])))
    cost = F.col("turnover") * F.col("cost_bps") / 1e4 * F.col("weight")
    return rows.withColumn("cost", cost).withColumn("net_return", F.col("ret") - F.col("cost"))


def audited(panel: DataFrame, by: list[str], bps: list[float]) -> DataFrame:
    """panel (by, date, ticker, sector, score, ret) through both weightings: mode, by, date, bucket, cost_bps, gross_return, turnover, net_return, names."""
    modes = [("unconstrained", portfolio.equal_weights), ("sector_neutral", portfolio.sector_neutral_weights)]
    out = None
    for mode, weigh in modes:
        held = weigh(panel, [*by, "date"])
        key = [*by, "bucket"]
        gross = held.filter("ret is not null").groupBy(*key, "date").agg((F.sum(F.col("weight") * F.col("ret")) / F.sum("weight")).alias("gross_return"), F.count("*").alias("names"))
        net = portfolio.apply_costs(gross.join(portfolio.turnover(held, key), [*key, "date"]), bps).withColumn("mode", F.lit(mode))
        out = net if out is None else out.unionByName(net)
    return out


def label_audit(panel: DataFrame, by: list[str], bps: list[float]) -> DataFrame:
    """Buckets of each cross-section bought new: turnover is one, so the cost of a name is rate x weight. Small cross-sections are all Q1."""
    held = panel.withColumn("bucket", bucket_small("score", "ticker", by)).filter("bucket is not null")
    held = held.withColumn("weight", 1.0 / F.count(F.lit(1)).over(Window.partitionBy(*by, "bucket")))
    levels = panel.sparkSession.createDataFrame([(float(b),) for b in bps], "cost_bps double")
    rows = held.filter("ret is not null").crossJoin(F.broadcast(levels))
    return rows.groupBy(*by, "bucket", "cost_bps").agg(
        F.count("*").alias("names"), F.sum(F.col("weight") * F.col("ret")).alias("gross_return"),
        F.sum(F.col("weight") * F.col("ret") - F.col("weight") * F.col("cost_bps") / 1e4).alias("net_return"))
