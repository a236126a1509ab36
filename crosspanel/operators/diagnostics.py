"""Signal diagnostics: decomposition by sector and rank information coefficients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.operators.xsec import doubled_rank


def decompose(signals: DataFrame, by: list[str]) -> DataFrame:
    """score -> sector_score (mean of the sector; a null sector is one) and within_score, the rest."""
    mean = F.avg("score").over(Window.partitionBy(*by, "sector"))
    sectors = F.size(F.collect_set("sector").over(Window.partitionBy(*by)))
    status = F.when(F.count("sector").over(Window.partitionBy(*by)) == 0, "blocked_missing_sector").when(sectors < 2, "blocked_insufficient_sector_coverage").otherwise("available")
    return signals.filter("score is not null").withColumns({"sector_score": mean, "within_score": F.col("score") - mean, "sector_status": status})


def exact_corr(x: str, y: str) -> Column:
    """Correlation of two columns of whole numbers (doubled ranks): sums are exact, so neither the order of rows nor their
    partitions change it, and a zero is zero. Null for a constant side."""
    whole = lambda e: F.sum(e.cast("decimal(20,0)"))
    a, b, n = F.col(x), F.col(y), F.count("*").cast("decimal(10,0)")
    spread = lambda v: (n * whole(v * v) - whole(v) * whole(v)).cast("double")
    return F.try_divide((n * whole(a * b) - whole(a) * whole(b)).cast("double"), F.sqrt(spread(a) * spread(b)))


def spearman(pairs: DataFrame, by: list[str], x: str, y: str, keep: list[Column] | None = None) -> DataFrame:
    """by, n, rank_ic over pairs without nulls (and aggregates to keep); rank_ic is null for a constant side."""
    full = pairs.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = full.withColumns({"_x": doubled_rank(F.col(x), by), "_y": doubled_rank(F.col(y), by)})
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), exact_corr("_x", "_y").alias("rank_ic"), *(keep or []))


def rank_ic(panel: DataFrame, by: list[str], returns: list[str] | None = None) -> DataFrame:
    """panel (by, sector, score, returns) -> by, horizon, decomposition (global, within_sector, across_sector), n, rank_ic,
    sector_count (null for across_sector) and sector_status.

    The panel is read once: a window over each sector gives its mean score, and one row of each sector stands for it in
    across_sector, with its mean score and return over the rows that have both. horizon names the column of returns.
    """
    returns = returns or ["ret"]
    split = decompose(panel, by)
    long = split.withColumn("_r", F.explode(F.array(*[F.struct(F.lit(r).alias("horizon"), F.col(r).cast("double").alias("ret")) for r in returns])))
    long = long.select(*by, "sector", "score", "within_score", "sector_status", "_r.horizon", "_r.ret")
    sector = Window.partitionBy(*by, "horizon", "sector")
    both = F.when(F.col("ret").isNotNull() & F.col("sector").isNotNull(), F.col("score"))
    one = F.row_number().over(sector.orderBy(F.col("ret").isNull()))  # a row of the sector that has a return, if any has
    long = long.withColumns({"_one": one, "_mean": F.avg(both).over(sector), "_ret": F.avg(F.when(both.isNotNull(), F.col("ret"))).over(sector)})
    pair = lambda name, x, y, s: F.struct(F.lit(name).alias("decomposition"), x.alias("_s"), y.alias("_y"), s.alias("_sector"))
    rows = F.array(
        pair("global", F.col("score"), F.col("ret"), F.col("sector")),
        pair("within_sector", F.col("within_score"), F.col("ret"), F.col("sector")),
        pair("across_sector", F.when(F.col("_one") == 1, F.col("_mean")), F.col("_ret"), F.lit(None).cast("string")),
    )
    each = long.select(*by, "horizon", "sector_status", F.explode(rows).alias("_p")).select(*by, "horizon", "sector_status", "_p.*")
    count = F.when(F.col("decomposition") != "across_sector", F.size(F.collect_set("_sector"))).alias("sector_count")
    return spearman(each, [*by, "horizon", "decomposition"], "_s", "_y", [count, F.min("sector_status").alias("sector_status")])


def newey_west_t(values: Column) -> Column:
    """t-statistic of the mean of an array in time order, lag floor(4 (n/100)^(2/9)), Bartlett weights; null below two."""
    n = F.size(values).cast("double")
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / n
    dev = F.transform(values, lambda v: v - mean)
    lag = F.floor(4 * F.pow(n / 100, F.lit(2 / 9))).cast("int")

    def gamma(k: Column) -> Column:
        later = F.slice(dev, k + 1, F.greatest(F.size(values) - k, F.lit(0)))
        return F.aggregate(F.zip_with(F.slice(dev, 1, F.greatest(F.size(values) - k, F.lit(0))), later, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v) / n

    weighted = F.aggregate(F.sequence(F.lit(1), F.greatest(lag, F.lit(1))), F.lit(0.0), lambda a, k: a + F.when(k <= lag, 2 * (1 - k / (lag + 1)) * gamma(k)).otherwise(0.0))
    variance = gamma(F.lit(0)) + weighted
    return F.when((n >= 2) & (variance > 0), mean / F.sqrt(variance / n))


def ic_summary(ic: DataFrame, by: list[str], date: str = "date") -> DataFrame:
    some = ic.filter("rank_ic is not null")
    series = F.transform(F.array_sort(F.collect_list(F.struct(date, "rank_ic"))), lambda r: r["rank_ic"])
    return some.groupBy(*by).agg(
        F.count("*").alias("months"), F.avg("rank_ic").alias("mean_ic"), F.percentile("rank_ic", F.lit(0.5)).alias("median_ic"),
        F.stddev_pop("rank_ic").alias("std_ic"), newey_west_t(series).alias("newey_west_t"), F.avg((F.col("rank_ic") > 0).cast("double")).alias("positive_share"))


def sector_ic_summary(ic: DataFrame, by: list[str]) -> DataFrame:
    """ic (by, date, n, rank_ic) -> by, months with a rank_ic, its mean, median and positive share, mean n of all months."""
    return ic.groupBy(*by).agg(
        F.count("rank_ic").alias("months"), F.avg("rank_ic").alias("mean_ic"), F.percentile("rank_ic", F.lit(0.5)).alias("median_ic"),
        F.avg((F.col("rank_ic") > 0).cast("double")).alias("positive_share"), F.avg("n").alias("mean_n"))
