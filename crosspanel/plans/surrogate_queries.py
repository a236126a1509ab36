"""Queries on surrogate models of labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosspanel.functions.coerce import settle
from crosspanel.operators import elastic, parts, scores, trees
from crosspanel.operators import surrogate as O
from crosspanel.plans.fact_queries import DERIVED, FEATURES, derived
from crosspanel.plans.registry import R, query
from crosspanel.sources import proxy

_LAB = "lab AS (SELECT o_custkey % 100 AS ticker, o_orderpriority AS form, o_totalprice / 1e5 - 1 AS label, CASE o_orderstatus WHEN 'F' THEN 1e0 WHEN 'O' THEN 5e-1 ELSE 0e0 END AS weight, o_orderkey % 3 <> 0 AS clean FROM orders)"
_AGG = f"{_LAB}, agg AS (SELECT ticker, sum(weight * label) / nullif(sum(weight), 0) AS label, count(*) AS rows, count(*) FILTER (WHERE weight > 0) AS used, avg(CAST(clean AS INTEGER)) AS clean_rate, avg(weight) AS mean_weight, min(form) AS form FROM lab GROUP BY 1)"
NUMERIC = ["roe", "operating_margin", "asset_turnover"]


#: Features that the second frame has no values of.
_NOT_THERE = ["roic", "current_ratio"]


def _labels(spark, sf):
    o, w = proxy.table(spark, sf, "orders"), F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 0.5).otherwise(0.0)
    rows = o.select((F.col("o_custkey") % 100).alias("ticker"), F.col("o_orderpriority").alias("form"), (F.col("o_totalprice") / 1e5 - 1).alias("label"), w.alias("weight"), (F.col("o_orderkey") % 3 != 0).alias("clean"))
    return O.aggregate_labels(rows, "label", ["form"])


@query(f"WITH {_AGG} SELECT ticker, {R('label')} AS label, rows, used, {R('clean_rate')} AS clean_rate, {R('mean_weight')} AS mean_weight, form FROM agg")
def aggregate_labels(spark, sf):
    return _labels(spark, sf).withColumns({c: settle(F.col(c)) for c in ("label", "clean_rate", "mean_weight")})


@query(f"WITH {_AGG}, {FEATURES} SELECT ticker, {R('label')} AS label, sector, {R('ln(market_cap)')} AS log_market_cap, roe FROM agg LEFT JOIN feat USING (ticker)")
def training_frame(spark, sf):
    t = O.training_frame(_labels(spark, sf), derived(spark, sf))
    return t.select("ticker", settle(F.col("label")).alias("label"), "sector", settle(F.col("log_market_cap")).alias("log_market_cap"), "roe")


@query(f"WITH {FEATURES}, n AS (SELECT count(*) AS n FROM feat) {' UNION ALL '.join(f'SELECT {chr(39)}{c}{chr(39)} AS feature, count({c}) AS non_null, {R(f'count({c}) * 1.0 / count(*)')} AS share FROM feat' for c in DERIVED)}")
def feature_coverage(spark, sf):
    return O.coverage_of(derived(spark, sf), DERIVED).withColumn("share", settle(F.col("share")))


@query(f"WITH {FEATURES} SELECT feature FROM ({' UNION ALL '.join(f'SELECT {chr(39)}{c}{chr(39)} AS feature, count({c}) AS a, {0 if c in _NOT_THERE else f'count({c})'} AS b FROM feat' for c in DERIVED)}) WHERE a > 0 AND b > 0")
def compatible_features(spark, sf):
    d = derived(spark, sf)
    return O.compatible(d, d.withColumns({c: F.lit(None).cast("double") for c in _NOT_THERE}), DERIVED)


def _rows(spark, sf):
    """(ticker, x, y): standardised features with sector dummies. The sector list is one row per region."""
    d = scores.standardized(derived(spark, sf), NUMERIC, [])
    sectors = [r[0] for r in proxy.table(spark, sf, "region").select("r_name").collect()]
    t = O.training_frame(_labels(spark, sf).withColumnRenamed("label", "y"), d).filter("roe is not null")
    # A row a ticker, read by several steps of each model.
    return parts.checkpointed(t.select("ticker", O.design(NUMERIC, sectors).alias("x"), "y")), len(NUMERIC) + len(sectors)


@query()
def multi_factor_residuals(spark, sf):
    """Least squares on features and sector dummies; tested against numpy."""
    rows, size = _rows(spark, sf)
    return O.least_squares(rows, size).select("ticker", settle(F.col("fitted")).alias("fitted"), settle(F.col("residual")).alias("residual"))


def _oof(spark, sf):
    rows, size = _rows(spark, sf)
    return O.oof_predictions(rows, size, seeds=50, k=5, ridge=1.0)


@query()
def repeated_cv(spark, sf):
    """Folds by hash: tested against numpy."""
    return O.repeated_cv(_oof(spark, sf)).select("seed", "fold", "n", settle(F.col("rank_ic")).alias("rank_ic"))


@query()
def bootstrap_oob(spark, sf):
    """Samples by hash."""
    rows, size = _rows(spark, sf)
    return O.bootstrap_oob(rows, size, 1000, ridge=1.0).select("sample", "n", settle(F.col("rank_ic")).alias("rank_ic"))


@query()
def overlap_stability(spark, sf):
    return O.overlap_stability(O.top_rates(_oof(spark, sf))).select(settle(F.col("stability")).alias("stability"))


@query()
def coefficient_signs(spark, sf):
    s = O.coefficient_signs(_oof(spark, sf), NUMERIC, {"roe": 1, "operating_margin": 1, "asset_turnover": -1})
    return s.select("feature", "positive", "negative", "zero", "expected_sign", "expected_share", "sign_flip", settle(F.col("size")).alias("size"), "strength")


@query()
def prediction_report(spark, sf):
    rows, size = _rows(spark, sf)
    p = O.prediction_report(O.least_squares(rows, size, ridge=1.0), _oof(spark, sf))
    return p.select("ticker", *[settle(F.col(c)).alias(c) for c in ("observed_pct", "fit_pct", "cv_pct", "residual")], "nulls")


def _sql_pct(x, w=""):
    return f"(rank() OVER ({w} ORDER BY {x}) - 1 + (count(*) OVER (PARTITION BY {w.replace('PARTITION BY ', '') + ', ' if w else ''}{x}) - 1) / 2.0) / (count(*) OVER ({w}) - 1)"


@query(f"""WITH t AS (SELECT o_orderstatus AS tier, {_sql_pct('o_totalprice', 'PARTITION BY o_orderstatus')} AS y, {_sql_pct('o_orderkey', 'PARTITION BY o_orderstatus')} AS p FROM orders)
  SELECT tier, count(*) AS n, {R('corr(y, p)')} AS rank_ic, {R('1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))')} AS r2, {R('avg(abs(y - p))')} AS mae FROM t GROUP BY 1""")
def fit_metrics(spark, sf):
    o = proxy.table(spark, sf, "orders").withColumn("tier", F.col("o_orderstatus"))
    return O.fit_metrics(o, ["tier"], "o_totalprice", "o_orderkey").select("tier", "n", *[settle(F.col(c)).alias(c) for c in ("rank_ic", "r2", "mae")])


@query("""WITH f AS (SELECT s_suppkey AS ticker, CASE WHEN s_acctbal < 0 THEN 'negative balance' END AS error, 2020 + s_suppkey % 7 AS fy FROM supplier),
  l AS (SELECT c_custkey + 5 AS ticker, c_mktsegment = 'BUILDING' AS stale, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS upside FROM customer)
  SELECT coalesce(f.ticker, l.ticker) AS ticker, CASE WHEN f.ticker IS NULL THEN 'missing_features' WHEN error IS NOT NULL THEN 'feature_error' WHEN fy < 2024 THEN 'stale_fiscal_year' WHEN l.ticker IS NULL THEN 'missing_report' WHEN stale THEN 'stale_price' WHEN upside IS NULL THEN 'missing_upside' END AS reason
  FROM f FULL JOIN l ON f.ticker = l.ticker""")
def match_summary(spark, sf):
    s, c = proxy.table(spark, sf, "supplier"), proxy.table(spark, sf, "customer")
    f = s.select(F.col("s_suppkey").alias("ticker"), F.when(F.col("s_acctbal") < 0, "negative balance").alias("error"), (2020 + F.col("s_suppkey") % 7).alias("fiscal_year"))
    l = c.select((F.col("c_custkey") + 5).alias("ticker"), F.array(F.when(F.col("c_mktsegment") == "BUILDING", "stale_price").otherwise("none")).alias("flags"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("upside"))  # noqa: E741
    return O.match_summary(f, l)


_PCTS = f"pc AS (SELECT s_suppkey AS ticker, {_sql_pct('s_acctbal')} AS actual, {_sql_pct('hash_key')} AS predicted, {_sql_pct('s_suppkey')} AS other FROM (SELECT *, (s_suppkey * 37) % 1009 AS hash_key FROM supplier))"


@query(f"""WITH {_PCTS}, k AS (SELECT *, row_number() OVER (ORDER BY predicted DESC, ticker) AS t, row_number() OVER (ORDER BY predicted, ticker) AS l FROM pc)
  SELECT 'over' AS kind, ticker, {R('predicted - actual')} AS gap FROM k WHERE t <= 10 AND actual <= 0.35 UNION ALL SELECT 'under', ticker, {R('predicted - actual')} FROM k WHERE l <= 10 AND actual >= 0.65 UNION ALL SELECT 'models_apart:other', ticker, {R('predicted - other')} FROM k WHERE abs(predicted - other) >= 0.35""")
def ranking_surprises(spark, sf):
    s = proxy.table(spark, sf, "supplier")
    rows = s.select(F.col("s_suppkey").alias("ticker"), "s_acctbal", ((F.col("s_suppkey") * 37) % 1009).alias("key"))
    return O.ranking_surprises(parts.ranked(rows, [], {"actual": "s_acctbal", "predicted": "key", "other": "ticker"}), ["other"]).withColumn("gap", settle(F.col("gap")))


# The features of the trees, and the signs that predictions keep to.
TREE_FEATURES = {"fcf_to_ev": 1, "gross_profitability_assets": 1, "asset_growth_1y": -1, "roe": 1, "operating_margin": 0}


def _training(spark, sf):
    return O.training_frame(_labels(spark, sf), derived(spark, sf))


@query()
def tree_fit(spark, sf):
    """Boosted trees on the panel's features; tested against numpy."""
    t = _training(spark, sf)
    model = trees.fit(t, list(TREE_FEATURES), "label", "ticker", TREE_FEATURES)
    return t.select("ticker", settle(trees.predicted(model)).alias("prediction"))


def _elastic(spark, sf):
    t, sectors = _training(spark, sf), [r[0] for r in proxy.table(spark, sf, "region").select("r_name").collect()]  # a row a region
    dummies = {f"sector_{s}": F.when(F.coalesce("sector", F.lit("Unknown")) == s, 1.0).otherwise(0.0) for s in sorted(sectors)[1:]}
    t = t.withColumns(dummies)
    return t, elastic.fit(t, [*NUMERIC, *dummies], "label", "ticker")


@query()
def elastic_net(spark, sf):
    """Predictions of the net chosen by cross-validation; its conditions are tested."""
    t, model = _elastic(spark, sf)
    return t.select("ticker", settle(model.score()).alias("prediction"))


@query()
def elastic_net_path(spark, sf):
    _, model = _elastic(spark, sf)
    return model.path(spark).select("l1_ratio", settle(F.col("alpha")).alias("alpha"), settle(F.col("error")).alias("error"), "chosen")


@query()
def linear_params(spark, sf):
    """Coefficients, medians, means and scales for scoring elsewhere."""
    _, model = _elastic(spark, sf)
    return model.parameters(spark).select("feature", *[settle(F.col(c)).alias(c) for c in ("coefficient", "median", "mean", "scale")])
