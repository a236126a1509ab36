"""Surrogate models as distributed jobs: labels, training frames, repeated folds and bootstraps by Gram matrices, reports.

Least squares needs only sums of products, so all folds of all seeds come from one aggregation; the systems solved
afterwards are as small as the number of features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.operators import parts
from crosspanel.operators.diagnostics import spearman
from crosspanel.operators.xsec import pct_rank_01


def aggregate_labels(rows: DataFrame, label: str, keep: list[str]) -> DataFrame:
    """rows (ticker, weight, label, clean) -> a row per ticker: weighted mean over positive weights, counts, clean share, smallest kept attributes."""
    used = (F.col("weight") > 0) & F.col(label).isNotNull()
    w = F.when(used, F.col("weight"))
    return rows.groupBy("ticker").agg(
        F.try_divide(F.sum(w * F.col(label)), F.sum(w)).alias("label"), F.count("*").alias("rows"), F.count(F.when(used, 1)).alias("used"),
        F.avg(F.col("clean").cast("double")).alias("clean_rate"), F.avg("weight").alias("mean_weight"), *[F.min(k).alias(k) for k in keep])


def training_frame(labels: DataFrame, features: DataFrame) -> DataFrame:
    return labels.join(features, "ticker", "left").withColumn("log_market_cap", F.when(F.col("market_cap") > 0, F.ln("market_cap")))


def coverage_of(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, non_null, share) in one pass."""
    one = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in columns])
    return one.unpivot(["_n"], columns, "feature", "non_null").select("feature", "non_null", F.try_divide("non_null", "_n").alias("share"))


def available(df: DataFrame, columns: list[str]) -> DataFrame:
    return coverage_of(df, columns).filter("non_null > 0").select("feature")


def compatible(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    return available(a, columns).join(available(b, columns), "feature", "left_semi")


def design(numeric: list[str], sectors: list[str]) -> Column:
    """The row's vector: one, the numbers (null as zero: standardise first), and dummies of all sectors but the first."""
    dummies = [F.when(F.coalesce("sector", F.lit("Unknown")) == s, 1.0).otherwise(0.0) for s in sorted(sectors)[1:]]
    return F.array(F.lit(1.0), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numeric], *dummies)


def grams(rows: DataFrame, by: list[str], size: int, weight: Column | None = None) -> DataFrame:
    """rows (by, x array of that size, y) -> by, g: the sums of products of (x, y) as an upper triangle, and n."""
    w = weight if weight is not None else F.lit(1.0)
    v = [F.get("x", F.lit(i)) for i in range(size)] + [F.col("y")]
    sums = [F.sum(w * v[i] * v[j]) for i in range(size + 1) for j in range(i, size + 1)]
    return rows.filter("y is not null").groupBy(*by).agg(F.array(*sums).alias("g"), F.sum(w).alias("n"))


def solved(gram: DataFrame, by: str, size: int, ridge: float = 0.0) -> DataFrame:
    """gram rows -> by, beta: the solution of least norm; a ridge spares the constant."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = np.triu_indices(size + 1)
        for b in batches:
            out = []
            for g in b["g"]:
                m = np.zeros((size + 1, size + 1))
                m[at] = g
                m = m + np.triu(m, 1).T
                a = m[:size, :size] + ridge * np.diag([0.0] + [1.0] * (size - 1))
                out.append((np.linalg.pinv(a, rcond=1e-10, hermitian=True) @ m[:size, size]).tolist())
            yield b.drop(columns=["g", "n"]).assign(beta=out)

    return gram.mapInPandas(run, f"{by}, beta array<double>")


def dot(x: Column, beta: Column) -> Column:
    return F.aggregate(F.zip_with(x, beta, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)


def least_squares(rows: DataFrame, size: int, ridge: float = 0.0) -> DataFrame:
    """rows with fitted and residual; rows without y take no part in the fit but are fitted."""
    beta = solved(grams(rows.withColumn("_all", F.lit(0)), ["_all"], size), "_all int", size, ridge)
    out = rows.crossJoin(F.broadcast(beta.select("beta"))).withColumn("fitted", dot(F.col("x"), F.col("beta"))).drop("beta")  # one row
    return out.withColumn("residual", F.col("y") - F.col("fitted"))


def _seeded(rows: DataFrame, seeds: int, k: int) -> DataFrame:
    each = rows.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    return each.withColumn("fold", F.pmod(F.xxhash64("ticker", "seed"), F.lit(k)).cast("int"))


def oof_predictions(rows: DataFrame, size: int, seeds: int = 50, k: int = 5, ridge: float = 0.0) -> DataFrame:
    """rows (ticker, x, y) -> ticker, seed, fold, y, predicted: each row by the model of the other folds.

    The Gram matrix of a training set is the total's less the fold's. Models are seeds x k small rows and are broadcast.
    """
    each = _seeded(rows.filter("y is not null"), seeds, k)
    part = grams(each, ["seed", "fold"], size)
    cells = range((size + 1) * (size + 2) // 2)
    total = [F.sum(F.get("g", F.lit(i))).over(Window.partitionBy("seed")) for i in cells]
    rest = part.withColumn("g", F.array(*[t - F.get("g", F.lit(i)) for i, t in enumerate(total)]))
    beta = solved(rest, "seed int, fold int", size, ridge)
    return each.join(F.broadcast(beta), ["seed", "fold"]).select("ticker", "seed", "fold", "y", dot(F.col("x"), F.col("beta")).alias("predicted"), "beta")


def repeated_cv(oof: DataFrame) -> DataFrame:
    """(seed, fold, n, rank_ic) of out-of-fold predictions; null for constant sides."""
    return spearman(oof, ["seed", "fold"], "predicted", "y")


def bootstrap_oob(rows: DataFrame, size: int, samples: int, ridge: float = 0.0) -> DataFrame:
    """(sample, n, rank_ic) on the rows a sample left out; row counts are Poisson(1) by hash, so no sample is drawn on the driver."""
    each = rows.filter("y is not null").withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    u = F.pmod(F.xxhash64("ticker", "sample", F.lit("boot")), F.lit(1 << 30)) / (1 << 30)
    cuts, total, term = [], 0.0, float(np.exp(-1))
    for i in range(8):
        total += term
        cuts.append(total)
        term /= i + 1
    count = sum((F.when(u >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    each = each.withColumn("w", count)
    beta = solved(grams(each, ["sample"], size, F.col("w").cast("double")), "sample int", size, ridge)
    left = each.filter("w = 0").join(F.broadcast(beta), "sample").withColumn("predicted", dot(F.col("x"), F.col("beta")))
    return spearman(left, ["sample"], "predicted", "y").filter("n >= 2")


def top_rates(oof: DataFrame) -> DataFrame:
    """(ticker, appearances, hits, rate): how often a ticker is in its seed's top quarter, ceil(n/4), ties by ticker."""
    by = Window.partitionBy("seed")
    hit = F.row_number().over(by.orderBy(F.col("predicted").desc(), "ticker")) <= F.ceil(F.count(F.lit(1)).over(by) / 4)
    return oof.withColumn("hit", hit.cast("int")).groupBy("ticker").agg(F.count("*").alias("appearances"), F.sum("hit").alias("hits"), F.avg("hit").alias("rate"))


def overlap_stability(rates: DataFrame) -> DataFrame:
    """One row: mean rate of the top quarter of tickers by rate, of equal rates as many as the quarter has room for."""
    counts = parts.value_counts(rates, [], -F.col("rate"))
    taken = F.least(F.col("times"), F.greatest(F.ceil(F.col("n") / 4) - F.col("before"), F.lit(0)))
    return counts.agg(F.try_divide(F.sum(-F.col("_x") * taken), F.sum(taken)).alias("stability"))


def fit_metrics(rows: DataFrame, by: list[str], y: str, predicted: str) -> DataFrame:
    """by, n, rank_ic, r2 and mae on percentiles of both sides."""
    some = rows.filter(F.col(y).isNotNull() & F.col(predicted).isNotNull())
    p = some.withColumns({"_y": pct_rank_01(F.col(y), by), "_p": pct_rank_01(F.col(predicted), by)})
    gap = F.col("_y") - F.col("_p")
    return p.groupBy(*by).agg(F.count("*").alias("n"), F.corr("_y", "_p").alias("rank_ic"), (1 - F.try_divide(F.sum(gap * gap), F.var_pop("_y") * F.count("*"))).alias("r2"), F.avg(F.abs(gap)).alias("mae"))


def coefficient_signs(oof: DataFrame, names: list[str], expected: dict[str, int] | None = None) -> DataFrame:
    """(feature, positive, negative, zero shares, expected_sign, expected_share, sign_flip, size, strength) over the models.

    expected names the sign (1, -1 or 0) that a feature should have (others: null); a feature flips if models disagree on it;
    strength goes by the share of the largest mean size: .67 and .33.
    """
    models = oof.select("seed", "fold", "beta").dropDuplicates(["seed", "fold"])
    one = models.select(F.posexplode(F.slice("beta", 2, len(names))).alias("i", "b")).withColumn("feature", F.get(F.array(*[F.lit(n) for n in names]), F.col("i")))
    share = lambda ok: F.avg(ok.cast("double"))
    s = one.groupBy("feature").agg(share(F.col("b") > 1e-12).alias("positive"), share(F.col("b") < -1e-12).alias("negative"), share(F.abs("b") <= 1e-12).alias("zero"), F.abs(F.avg("b")).alias("size"))
    sign = F.coalesce(*[F.when(F.col("feature") == f, v) for f, v in (expected or {}).items()], F.lit(None).cast("int"))
    s = s.withColumn("expected_sign", sign)
    s = s.withColumns({"expected_share": F.when(sign > 0, F.col("positive")).when(sign < 0, F.col("negative")).when(sign == 0, F.col("zero")), "sign_flip": (F.col("positive") > 0) & (F.col("negative") > 0)})
    relative = F.try_divide("size", F.max("size").over(Window.partitionBy()))  # a row per feature
    return s.withColumn("strength", F.when(relative >= 0.67, "strong").when(relative >= 0.33, "medium").when(F.col("size") > 0, "weak").otherwise("ignored"))


def match_summary(features: DataFrame, labels: DataFrame, known_broken: list[str] | None = None, oldest_year: int = 2024) -> DataFrame:
    """(ticker, reason) over both sides; reason is null for usable pairs, else the first that applies.

    features (ticker, error, fiscal_year), labels (ticker, flags, upside).
    """
    both = features.withColumn("_f", F.lit(1)).join(labels.withColumn("_l", F.lit(1)), "ticker", "full")
    reason = F.when(F.col("_f").isNull(), "missing_features").when(F.col("error").isNotNull(), "feature_error").when(F.col("fiscal_year") < oldest_year, "stale_fiscal_year")
    if known_broken:
        reason = reason.when(F.col("ticker").isin(known_broken), "known_broken")
    reason = reason.when(F.col("_l").isNull(), "missing_report").when(F.array_contains("flags", "stale_price"), "stale_price").when(F.col("upside").isNull(), "missing_upside")
    return both.select("ticker", reason.alias("reason"))


def ranking_surprises(rows: DataFrame, others: list[str], k: int = 10) -> DataFrame:
    """rows (ticker, actual, predicted and others: percentiles) -> (kind, ticker, gap).

    over and under: of the k highest and k lowest predictions, those whose actual percentile is at most .35 or at least
    .65, each a top-k, not a window; models_apart: for each other model every ticker that is apart by .35 or more.
    """
    gap = (F.col("predicted") - F.col("actual")).alias("gap")
    over = parts.first_rows(rows, [F.col("predicted").desc(), F.col("ticker")], k).filter("actual <= 0.35").select(F.lit("over").alias("kind"), "ticker", gap)
    out = over.unionByName(parts.first_rows(rows, [F.col("predicted"), F.col("ticker")], k).filter("actual >= 0.65").select(F.lit("under").alias("kind"), "ticker", gap))
    for other in others:
        far = rows.withColumn("gap", F.col("predicted") - F.col(other)).filter("abs(gap) >= 0.35")
        out = out.unionByName(far.select(F.lit(f"models_apart:{other}").alias("kind"), "ticker", "gap"))
    return out


def prediction_report(fitted: DataFrame, oof: DataFrame) -> DataFrame:
    """(ticker, observed, fit and cross-validated percentiles, residual, nulls): cross-validated means over the seeds; nulls of them."""
    cv = oof.groupBy("ticker").agg(F.avg("predicted").alias("cv"))
    rows = parts.ranked(fitted.join(cv, "ticker", "left"), [], {"observed_pct": "y", "fit_pct": "fitted", "cv_pct": "cv"})
    nulls = sum((F.col(c).isNull().cast("int") for c in ("y", "fitted", "cv")), F.lit(0))
    return rows.select("ticker", "observed_pct", "fit_pct", "cv_pct", "residual", nulls.alias("nulls"))
