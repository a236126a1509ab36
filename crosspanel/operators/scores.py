"""Composite scores: signed features standardised, averaged in blocks and over blocks, and linear scores of fixed parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.operators import parts
from crosspanel.operators.xsec import clip, zscore

# Features of each block with the sign that counts as good.
BLOCKS = {
    "value": {"fcf_to_ev": 1, "ebit_to_ev": 1, "ebitda_to_ev": 1, "book_to_market": 1, "earnings_yield": 1, "fcf_yield": 1},
    "quality": {"gross_profitability_assets": 1, "roic": 1, "roe": 1, "operating_margin": 1, "cash_conversion": 1, "cash_earnings_gap": 1},
    "momentum": {"momentum_12_1": 1, "price_return_6m": 1, "price_return_1m": -1},
    "investment": {"asset_growth_1y": -1, "capex_growth": -1, "working_capital_growth": -1, "issuance_yield": -1, "buyback_yield": 1},
    "accruals": {"cash_earnings_gap": 1, "accruals": -1, "working_capital_accruals": -1},
    "balance_sheet": {"net_debt_to_ebitda": -1, "interest_coverage": 1, "current_ratio": 1, "debt_to_equity": -1},
}
# The additive score; investment counts against a name.
ADDITIVE = {"fcf_to_ev": 1, "gross_profitability_assets": 1, "roic": 1, "momentum_12_1": 1, "asset_growth_1y": -1}


def _unpivoted(panel: DataFrame, keys: list[str], signs: dict[str, int]) -> DataFrame:
    features = [f for f in signs if f in panel.columns]
    return panel.unpivot(keys, [F.col(f).cast("double").alias(f) for f in features], "feature", "x")


def block_scores(panel: DataFrame, by: list[str], key: str = "ticker", blocks: dict[str, dict[str, int]] = BLOCKS, within: str | None = None) -> DataFrame:
    """(by, key, block, score, feature_count): mean of the signed z-scores at hand, winsorised at 1 and 99 percent.

    within names a column, the sector say, in whose groups (nulls are one) the signed z-scores are standardised once more.
    Features that the panel lacks are left out. The statistics of a partition are one small row each (quantiles, then
    moments), joined back; no window holds a whole partition, so `by` may be empty for statistics of the whole panel.
    """
    signs = {f: s for features in blocks.values() for f, s in features.items()}
    long = _unpivoted(panel, [*by, key], signs).filter("x is not null")
    at = [*by, "feature"]
    ends = long.groupBy(*at).agg(F.percentile("x", F.lit(0.01)).alias("_lo"), F.percentile("x", F.lit(0.99)).alias("_hi"))
    cut = long.join(ends, at).withColumn("x", clip(F.col("x"), F.col("_lo"), F.col("_hi")))
    moments = cut.groupBy(*at).agg(F.avg("x").alias("_mean"), F.stddev_pop("x").alias("_std"))
    z = cut.join(moments, at).withColumn("z", F.when(F.col("_std") > 1e-12, (F.col("x") - F.col("_mean")) / F.col("_std")).otherwise(0.0))
    names = F.create_map(*[F.lit(v) for f in signs for v in (f, "|".join(b for b, features in blocks.items() if f in features))])
    placed = z.withColumn("block", F.explode(F.split(names[F.col("feature")], r"\|")))
    sign = F.create_map(*[F.lit(v) for b, features in blocks.items() for f, s in features.items() for v in (f"{b}.{f}", s)])[F.concat_ws(".", "block", "feature")]
    if within:
        groups = placed.join(panel.select(*by, key, within), [*by, key])
        at = [*by, within, "block", "feature"]
        moments = groups.groupBy(*at).agg(F.avg("z").alias("_zm"), F.stddev_pop("z").alias("_zs"))
        placed = _joined(groups.drop("_mean", "_std"), moments, at).withColumn("z", F.when(F.col("_zs") > 1e-12, (F.col("z") - F.col("_zm")) / F.col("_zs")).otherwise(0.0))
    return placed.groupBy(*by, key, "block").agg(F.avg(F.col("z") * sign).alias("score"), F.count("*").alias("feature_count"))


def composite(scores: DataFrame, by: list[str], key: str = "ticker") -> DataFrame:
    """(by, key, composite, block_count): mean over the blocks at hand."""
    return scores.groupBy(*by, key).agg(F.avg("score").alias("composite"), F.count("score").alias("block_count"))


def _joined(panel: DataFrame, stats: DataFrame, by: list[str]) -> DataFrame:
    """panel with the statistics of its key (nulls are a key); of the whole panel they are one row."""
    if not by:
        return panel.crossJoin(F.broadcast(stats))
    left, right = panel.alias("l"), stats.alias("r")
    both = left.join(right, reduce(Column.__and__, [F.col(f"l.{b}").eqNullSafe(F.col(f"r.{b}")) for b in by]))
    return both.select("l.*", *[F.col(f"r.{c}") for c in stats.columns if c not in by])


def median_imputed(panel: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Nulls become the partition's median, or zero where all are null; medians by running counts, so no task holds a partition."""
    both = _joined(panel, parts.quantiles(panel, by, columns, [0.5]), by)
    return both.select(*[F.coalesce(c, f"{c}_0", F.lit(0.0)).alias(c) if c in columns else F.col(c) for c in panel.columns])


def size_buckets(panel: DataFrame, cap: str, by: list[str]) -> DataFrame:
    """panel with size_bucket: terciles small, mid, large of positive sizes if three are distinct; else known or unknown."""
    sized = panel.withColumn("_cap", F.when(F.col(cap) > 0, F.col(cap).cast("double")))
    kinds = sized.select(*by, "_cap").distinct().groupBy(*by).agg(F.count("_cap").alias("_kinds"))
    both = _joined(_joined(sized, parts.quantiles(sized, by, ["_cap"], [1 / 3, 2 / 3]), by), kinds, by)
    size = F.when(F.col("_cap").isNull(), "unknown").when(F.col("_kinds") < 3, "known").when(F.col("_cap") <= F.col("_cap_0"), "small").when(F.col("_cap") <= F.col("_cap_1"), "mid").otherwise("large")
    return both.withColumn("size_bucket", size).select(*panel.columns, "size_bucket")


def additive_score(panel: DataFrame, by: list[str], impute: bool, signs: dict[str, int] = ADDITIVE) -> DataFrame:
    """panel with additive: the signed z-scores summed; null where one is missing, unless medians are filled in first."""
    signs = {f: s for f, s in signs.items() if f in panel.columns}
    full = median_imputed(panel, list(signs), by) if impute else panel
    return full.withColumn("additive", sum((zscore(F.col(f), by) * s for f, s in signs.items()), F.lit(0.0)))


def standardized(panel: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """The columns winsorised at 1 and 99 percent, nulls filled with the clipped median, as z-scores; all-null ones are zero.

    Quantiles come from running counts and moments from one aggregation, both joined back: no window over a partition.
    """
    cut = _joined(panel, parts.quantiles(panel, by, columns, [0.01, 0.5, 0.99]), by)
    filled = {c: F.coalesce(clip(F.col(c), F.col(f"{c}_0"), F.col(f"{c}_2")), clip(F.col(f"{c}_1"), F.col(f"{c}_0"), F.col(f"{c}_2")), F.lit(0.0)) for c in columns}
    full = cut.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in panel.columns])
    moments = full.groupBy(*by).agg(*[m for c in columns for m in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    z = {c: F.when(F.col(f"_s_{c}") > 1e-12, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0) for c in columns}
    return _joined(full, moments, by).select(*[z[c].alias(c) if c in z else F.col(c) for c in panel.columns])


def linear_score(intercept: float, terms: dict[str, tuple[float, float, float, float]]) -> Column:
    """terms: column -> (coefficient, median, mean, scale); a missing value counts as the median."""
    parts = [(F.coalesce(F.col(c), F.lit(median)) - mean) / (scale or 1.0) * weight for c, (weight, median, mean, scale) in terms.items()]
    return sum(parts, F.lit(intercept))


def without_degenerate(scores: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """Rows of the partitions with two finite and two distinct scores at least."""
    w = Window.partitionBy(*by)
    finite = F.when(F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf")), F.col(score))
    return scores.withColumns({"_lo": F.min(finite).over(w), "_hi": F.max(finite).over(w)}).filter("_lo < _hi").drop("_lo", "_hi")


def score_history(panel: DataFrame, by: list[str], models: dict[str, Column], factors: list[str]) -> DataFrame:
    """panel (by, ticker, eligible, features) -> (by, ticker, signal, score), long: fixed models on each row, and per partition the z-score of each raw factor.

    Rows that are not eligible and null scores go; so do partitions of fewer than two distinct scores of a signal.
    """
    some = panel.filter("eligible")
    made = [F.struct(F.lit(n).alias("signal"), m.alias("score")) for n, m in models.items()] + [F.struct(F.lit(f).alias("signal"), zscore(F.col(f), by).alias("score")) for f in factors]
    long = some.select(*by, "ticker", F.array(*made).alias("_s")).select(*by, "ticker", F.explode("_s").alias("_e")).select(*by, "ticker", "_e.signal", "_e.score")
    return without_degenerate(long.filter("score is not null"), [*by, "signal"])
