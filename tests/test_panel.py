"""Hand-computed cases of the panel operators, and a few registered queries against DuckDB."""

import datetime as dt

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosspanel.functions import coerce
from crosspanel.operators import diagnostics, facts, portfolio, quality, text, universe, valuation, xsec
from crosspanel.operators.asof import asof
from crosspanel.plans import registry

SF = "/root/testdata/sf0.001"


def day(text):
    return dt.date.fromisoformat(text)


def test_asof_is_strict_after(spark):
    prices = spark.createDataFrame([("A", day("2026-03-22"), 10.0), ("A", day("2026-04-22"), 12.0), ("A", day("2026-04-23"), 15.0)], "ticker string, at date, price double")
    probes = spark.createDataFrame([("A", day("2026-03-21")), ("A", day("2026-04-22")), ("B", day("2026-04-22"))], "ticker string, date date")
    after = {(r[0], r[1]): r[2] for r in asof(probes, prices, ["ticker"], "date", "at", ["price"], strict=True, forward=True).collect()}
    upto = {(r[0], r[1]): r[2] for r in asof(probes, prices, ["ticker"], "date", "at", ["price"]).collect()}
    before = {(r[0], r[1]): r[2] for r in asof(probes, prices, ["ticker"], "date", "at", ["price"], strict=True).collect()}
    assert after == {("A", day("2026-03-21")): 10.0, ("A", day("2026-04-22")): 15.0, ("B", day("2026-04-22")): None}
    assert upto["A", day("2026-04-22")] == 12.0 and before["A", day("2026-04-22")] == 10.0


def test_decomposition(spark):
    rows = [(1, "a", "Tech", 1.0), (1, "b", "Tech", 3.0), (1, "c", "Energy", 10.0), (1, "d", "Energy", 14.0)]
    out = diagnostics.decompose(spark.createDataFrame(rows, "date int, ticker string, sector string, score double"), ["date"]).orderBy("ticker").collect()
    assert [r["within_score"] for r in out] == [-1, 1, -2, 2] and {r["sector_status"] for r in out} == {"available"}


def test_ranks_and_deciles(spark):
    df = spark.createDataFrame([(x,) for x in (10.0, 20.0, 30.0, 40.0, 50.0)], "x double").withColumn("g", F.lit(1))
    out = df.withColumn("p", xsec.pct_rank_01(F.col("x"), ["g"])).withColumn("d", xsec.decile(F.col("p"))).orderBy("x").collect()
    assert [r["p"] for r in out] == [0, 0.25, 0.5, 0.75, 1] and [r["d"] for r in out] == [0, 2, 5, 7, 9]


def test_buckets_are_not_ntile(spark):
    df = spark.range(52).select(F.lit(1).alias("g"), F.col("id").cast("string").alias("ticker"), F.col("id").cast("double").alias("score"))
    sizes = dict(df.withColumn("b", xsec.bucket("score", "ticker", ["g"])).groupBy("b").count().collect())
    assert sizes == {"Q1": 11, "Q2": 10, "Q3": 11, "Q4": 10, "Q5": 10}


def test_sector_neutral_and_turnover(spark):
    rows = [(1, "A", "Tech", 3.0), (1, "B", "Tech", 2.0), (1, "C", "Tech", 1.0), (1, "D", "Energy", 6.0), (1, "E", "Energy", 5.0), (1, "F", "Energy", 4.0)]
    held = portfolio.sector_neutral_weights(spark.createDataFrame(rows, "date int, ticker string, sector string, score double"), ["date"])
    assert sorted((r["ticker"], r["weight"]) for r in held.filter("bucket = 'Q1'").collect()) == [("A", 0.5), ("D", 0.5)]
    moved = spark.createDataFrame([("Q1", 1, "A", 1.0), ("Q1", 2, "B", 1.0)], "bucket string, date int, ticker string, weight double")
    assert {r["date"]: r["turnover"] for r in portfolio.turnover(moved, ["bucket"]).collect()} == {1: 1.0, 2: 1.0}


def test_implied_rate_solves(spark):
    df = spark.createDataFrame([([10.0, 10.0, 110.0], 100.0), ([1.0], -1.0), ([], 5.0)], "flows array<double>, target double")
    got = [r[0] for r in df.select(valuation.implied_rate(F.col("flows"), F.col("target"))).collect()]
    assert got[0] == pytest.approx(0.1, abs=1e-9) and got[1:] == [None, None]


def test_membership_walks_back(spark):
    now = spark.createDataFrame([("A",), ("C",), ("D",)], "ticker string")
    changes = spark.createDataFrame([("C", day("2025-06-30"), "added", 1), ("X", day("2025-06-30"), "removed", 1), ("D", day("2026-06-30"), "added", 2), ("B", day("2026-06-30"), "removed", 2)], "ticker string, date date, kind string, seq int")
    dates = spark.createDataFrame([(day("2024-12-31"),), (day("2025-12-31"),)], "date date")
    got = {}
    for r in universe.membership_on_dates(now, changes, dates).collect():
        got.setdefault(str(r["date"]), set()).add(r["ticker"])
    assert got == {"2024-12-31": {"A", "B", "X"}, "2025-12-31": {"A", "B", "C"}}


def test_amounts(spark):
    df = spark.createDataFrame([("0.5%",), ("15%",), ("0.08",), ("1.5",), ("150%",), ("(3)",), ("n/a",)], "x string")
    ratio = [r[0] for r in df.select(coerce.parse_amount(F.col("x"), ratio=True)).collect()]
    assert ratio[:5] == pytest.approx([0.005, 0.15, 0.08, 0.015, 1.5]) and ratio[6] is None
    assert df.select(coerce.parse_amount(F.col("x"))).collect()[5][0] == -3


def test_fingerprint_ignores_order(spark):
    df = spark.range(100).withColumn("v", F.rand(1))
    assert quality.fingerprint(df).collect() == quality.fingerprint(df.orderBy(F.col("id").desc()).repartition(7)).collect()


@pytest.mark.parametrize("name", ["asof_price_le", "step_returns", "rank_ic", "turnover", "membership_on_date"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "supplier", "nation", "region", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours, theirs = registry.QUERIES[name](spark, SF).toPandas(), con.sql(registry.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    cols = sorted(ours.columns)
    text = lambda d: sorted(d[cols].astype(str).replace({"<NA>": "nan", "None": "nan"}).agg(lambda r: "|".join(x.removesuffix(".0").removesuffix(" 00:00:00") for x in r), axis=1))
    assert text(ours) == text(theirs)


def test_rates_of_flows_with_several_sign_changes(spark):
    df = spark.createDataFrame([([-43.0, -16.0, 100.0, -30.0, 2.0], 26.0), ([40.0, 88.0, -42.0, -27.0, -48.0], 42.0)], "flows array<double>, target double")
    got = [r[0] for r in df.select(valuation.implied_rate(F.col("flows"), F.col("target"))).collect()]
    assert got == pytest.approx([-0.092, 0.349], abs=5e-4)


def test_words_and_links(spark):
    df = spark.createDataFrame([("15%", "[a](https://x.org/1)", "C++ and c++ but not cxx")], "x string, link string, t string")
    r = df.select(coerce.parse_amount(F.col("x")), coerce.md_link_url(F.col("link")), coerce.md_link_url(F.lit("see [a](https://x.org) there")), text.keyword_count(F.col("t"), ["c++"])).collect()[0]
    assert list(r) == [pytest.approx(0.15), "https://x.org/1", "see [a](https://x.org) there", 2]


def test_facts_of_whole_periods_in_one_unit(spark):
    rows = [("10-K", "FY", "2024-01-01", "2024-12-31", True, "USD"), ("10-K", "FY", "2024-10-01", "2024-12-31", True, "EUR"), ("10-Q", "Q2", "2024-01-01", "2024-06-30", True, "USD"), ("10-Q", "Q2", "2024-04-01", "2024-06-30", True, "CAD"), ("10-Q", "Q1", None, "2024-03-31", False, "EUR"), ("20-F", "FY", None, "2024-12-31", True, "EUR"), ("8-K", "Q1", None, "2024-03-31", False, "USD")]
    df = spark.createDataFrame([(1, "revenue", i, *r) for i, r in enumerate(rows)], "ticker int, tag string, id int, form string, fp string, start string, end string, is_duration boolean, unit string")
    of = lambda x: sorted(r["id"] for r in x.collect())
    assert of(facts.annual_facts(df)) == [0] and of(facts.quarterly_facts(df)) == [3, 4]
    assert of(facts.preferred_unit(df, ["JPY", "EUR", "USD"])) == [1, 4, 5] and of(facts.preferred_unit(df, ["JPY"])) == list(range(7))


def test_tied_facts_do_not_depend_on_the_order_of_rows(spark):
    day, filed = dt.date(2020, 12, 31), dt.date(2021, 2, 14)
    tied = [(1, "revenue", 5.0, day, filed, "1-4", 4), (1, "capex", -9.0, day, filed, "1-6", 6), (1, "capex", -3.0, day, filed, "1-6", 6), (2, "revenue", 7.0, day, filed, "2-b", 4), (2, "revenue", 8.0, day, filed, "2-a", 4)]
    for rows in (tied, tied[::-1]):
        f = spark.createDataFrame(rows, "ticker long, field string, value double, end date, filed date, accn string, rank int").coalesce(1)
        got = {(r.ticker, r.field): (r.value, r.accn) for r in facts.select_facts(f, facts.anchor_facts(f)).collect()}
        assert got == {(1, "revenue"): (5.0, "1-4"), (1, "capex"): (-3.0, "1-6"), (2, "revenue"): (7.0, "2-b")}


def test_small_buckets_and_column_checks(spark):
    df = spark.createDataFrame([("a", "x", 3.0), ("a", "y", None), ("b", "p", 1.0), ("b", "q", 2.0), ("b", "r", 3.0), ("b", "s", None)], "g string, ticker string, score double")
    got = {r["ticker"]: r["b"] for r in df.select("ticker", xsec.bucket_small("score", "ticker", ["g"]).alias("b")).collect()}
    assert got == {"x": "Q1", "y": None, "r": "Q1", "q": "Q3", "p": "Q5", "s": None}
    assert sorted(map(tuple, quality.check_columns(df, ["g", "no"], ["score"]).collect())) == [("no", "missing"), ("score", "forbidden")]


@pytest.mark.parametrize("parts", [1, 3, 8, 13])
def test_rank_correlations_do_not_depend_on_partitions(spark, parts):
    """Bit for bit: ranks are whole numbers and their sums exact; a correlation of zero is zero."""
    rng = np.random.default_rng(4)
    data = [(d, i, f"s{i % 5}", float(rng.integers(0, 6)), float(rng.integers(0, 5))) for d in range(12) for i in range(40)] + [(99, i, f"s{i}", float(x), float(y)) for i, (x, y) in enumerate([(1, 2), (2, 5), (3, 3), (4, 1), (5, 4)])]
    panel = spark.createDataFrame(data, "date int, ticker int, sector string, score double, ret double")
    key = lambda df: sorted((r.date, r.decomposition, r.n, r.rank_ic, r.sector_count, r.sector_status) for r in df.collect())
    want = key(diagnostics.rank_ic(panel.coalesce(1), ["date"]))
    assert key(diagnostics.rank_ic(panel.repartition(parts), ["date"])) == want
    assert [r[3] for r in want if r[:2] == (99, "global")] == [0.0]
    scipy = pd.DataFrame(data, columns=["date", "t", "s", "score", "ret"]).groupby("date").apply(lambda g: g["score"].rank().corr(g["ret"].rank()), include_groups=False)
    assert all(r[3] == pytest.approx(scipy[r[0]], abs=1e-12) for r in want if r[1] == "global")


def test_rank_ic_of_several_returns(spark):
    panel = spark.createDataFrame([(1, i, None, float(i), float(-i), None) for i in range(5)], "date int, ticker int, sector string, score double, ret_1m double, ret_3m double")
    got = {(r.horizon, r.decomposition): (r.n, r.rank_ic, r.sector_count, r.sector_status) for r in diagnostics.rank_ic(panel, ["date"], ["ret_1m", "ret_3m"]).collect()}
    assert got == {("ret_1m", "global"): (5, -1.0, 0, "blocked_missing_sector"), ("ret_1m", "within_sector"): (5, -1.0, 0, "blocked_missing_sector")}
