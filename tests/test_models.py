"""Surrogates against numpy, scores and facts by hand, and every SQL-backed query against DuckDB on the smallest tables."""

import datetime as dt

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from crosspanel.operators import facts, membership, scores, surrogate
from crosspanel.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = np.column_stack([np.ones(60), rng.normal(size=(60, 2))])
    y = x @ [0.5, 1.0, -2.0] + rng.normal(size=60) * 0.1
    return x, y, spark.createDataFrame([(i, [float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "ticker long, x array<double>, y double")


def test_least_squares(rows):
    x, y, df = rows
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    got = [r.fitted for r in surrogate.least_squares(df, 3).orderBy("ticker").collect()]
    assert np.allclose(got, x @ beta)


def test_rank_deficient_fit_has_least_norm(spark):
    df = spark.createDataFrame([(i, [1.0, float(i), float(i)], float(2 * i)) for i in range(5)], "ticker long, x array<double>, y double")
    beta = surrogate.solved(surrogate.grams(df.withColumn("g0", F.lit(0)), ["g0"], 3), "g0 int", 3).first().beta
    assert np.allclose(beta, [0, 1, 1], atol=1e-6)


def test_folds_leave_out_their_rows(rows):
    x, y, df = rows
    got = surrogate.oof_predictions(df, 3, seeds=2, k=4).toPandas()
    assert len(got) == 120
    for (_, _), g in got.groupby(["seed", "fold"]):
        out = np.zeros(60, bool)
        out[g["ticker"]] = True
        beta = np.linalg.lstsq(x[~out], y[~out], rcond=None)[0]
        assert np.allclose(g["predicted"], x[g["ticker"]] @ beta, atol=1e-8)


def test_bootstrap_leaves_a_third_out(rows):
    got = surrogate.bootstrap_oob(rows[2], 3, 40).toPandas()
    assert len(got) == 40 and 0.3 < got["n"].mean() / 60 < 0.45 and got["rank_ic"].min() > 0.8


def test_blocks_share_a_feature_with_both_signs(spark):
    df = spark.createDataFrame([("A", 1.0, None), ("B", 3.0, 2.0)], "ticker string, cash_earnings_gap double, accruals double")
    got = {(r.ticker, r.block): (round(r.score, 6), r.feature_count) for r in scores.block_scores(df, []).collect()}
    assert got == {("A", "quality"): (-1.0, 1), ("B", "quality"): (1.0, 1), ("A", "accruals"): (-1.0, 1), ("B", "accruals"): (0.5, 2)}


def test_prior_filing_falls_back_to_years(spark):
    d = dt.date
    rows = [("A", "f1", "f1", d(2025, 5, 1), d(2025, 3, 31), 2025, "10-Q", 1.0), ("A", "f2", "f2", d(2025, 6, 1), d(2025, 3, 31), 2025, "10-Q", 2.0), ("A", "f3", "f3", d(2026, 2, 1), None, 2026, "10-K", 3.0)]
    df = spark.createDataFrame(rows, "ticker string, filing string, accn string, filed date, period_end date, fy int, form string, v double")
    got = {r.accn: r.prior_v for r in facts.with_prior_filing(df, ["v"]).collect()}
    assert got == {"f1": None, "f2": None, "f3": 2.0}


def test_eligible_from_the_day_of_addition(spark):
    d = dt.date
    panel = spark.createDataFrame([("A", d(2025, 1, 1)), ("A", d(2025, 2, 1)), ("B", d(2025, 1, 1))], "ticker string, date date")
    changes = spark.createDataFrame([(d(2025, 2, 1), "A", "added")], "date date, ticker string, kind string")
    got = {(r.ticker, r.date.month): r.eligible for r in membership.add_date_filter(panel, changes).collect()}
    assert got == {("A", 1): False, ("A", 2): True, ("B", 1): True}


def test_empty_result_replaces_nothing(spark, tmp_path):
    df = spark.range(3)
    assert membership.replace_unless_empty(df, str(tmp_path / "t")) and not membership.replace_unless_empty(df.limit(0), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3


@pytest.mark.parametrize("name", ["selected_facts", "pit_matrix", "corpus_requests", "block_scores", "holdings", "dcf_values", "validate_responses", "membership_gap", "ranking_surprises"])
def test_rows_of_duckdb(spark, name):
    db = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), db.execute(catalog.ORACLES[name]).df()
    key = lambda df: sorted(tuple("~" if v is None or v != v else f"{v:.5f}" if isinstance(v, float) else str(v)[:10] if hasattr(v, "year") else str(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
    assert key(got) == key(want)


def test_every_ticker_apart_is_a_surprise(spark):
    rows = spark.createDataFrame([(i, 0.5, p, q) for i, (p, q) in enumerate([(0.9, 0.1), (0.1, 0.8), (0.2, 0.6), (0.5, 0.5), (0.7, 0.3), (0.4, None)])], "ticker int, actual double, predicted double, other double")
    got = [(r.kind, r.ticker, round(r.gap, 6)) for r in surrogate.ranking_surprises(rows, ["other"]).collect()]
    assert sorted(got) == [("models_apart:other", 0, 0.8), ("models_apart:other", 1, -0.7), ("models_apart:other", 2, -0.4), ("models_apart:other", 4, 0.4)]
