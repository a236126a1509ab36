"""Inputs of reports: year maps, missing figures, prices and costs, sector templates, universes."""

import pytest
from pyspark.sql import functions as F

from crosspanel.functions import coerce
from crosspanel.operators import diagnostics, universe
from crosspanel.operators import reports as O
from crosspanel.operators.valuation import present_value

MAPS = "id int, base map<int,double>, other map<int,double>, years array<int>"


def test_year_maps(spark):
    rows = [(1, {2018: 1.0, 2019: 5.0, 2021: 2.0}, {2022: 9.0, 2030: 7.0}, [2020, 2021, 2022, 2023]), (2, {}, {2020: 3.0}, [2020]), (3, {2025: 4.0}, {}, [2020, 2021]), (4, {2020: 4.0}, {}, [])]
    df = spark.createDataFrame(rows, MAPS).orderBy("id")
    filled, merged = coerce.fill_years(F.col("base"), F.col("years"), F.lit(0.5)), coerce.merge_years(F.col("base"), F.col("other"), F.col("years"))
    got = [(r[0], r[1]) for r in df.select(filled, merged).collect()]
    assert got[0] == ({2020: 0.5, 2021: 2.0, 2022: 2.0, 2023: 2.0}, {2020: 1.0, 2021: 2.0, 2022: 9.0, 2023: 2.0})
    assert got[1] == ({2020: 0.5}, None)
    assert got[2] == ({2020: 0.5, 2021: 0.5}, {2020: 4.0, 2021: 4.0})
    assert got[3] == ({}, {})


def test_templates_costs_and_missing_fields(spark):
    names = ["Application Software", "Oil & Gas", "Multi-Utilities", "Health Care", "Banks", "", None, "Cloud chips"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id int, name string").orderBy("id")
    assert [r[0] for r in df.select(coerce.sector_template(F.col("name"))).collect()] == ["software", "energy", "utilities", "healthcare", "general", "general", "general", "software"]
    cost = coerce.llm_cost(F.col("tier"), F.col("p"), F.col("c"), F.col("r"))
    paid = spark.createDataFrame([("cheap", 1_000_000, 2_000_000, 0), ("full", 100, 10, 30), ("other", 1, 1, 1), ("full", None, 1_000_000, None)], "tier string, p long, c long, r long")
    assert [r[0] for r in paid.select(cost).collect()] == [2.7, 0.00085, None, 15.0]
    assert [r[0] for r in df.select(coerce.missing_fields(["id", "name"])).collect()] == [[]] * 6 + [["name"], []]


RECORD = "id int, revenue double, operating_income double, operating_margin double, shares double, raw_close double, current_price double, report_price double, da double, capex double, cash double, total_debt double"


def test_mechanical_label(spark):
    rows = [
        (1, 1000.0, 150.0, None, 10.0, 100.0, 90.0, 80.0, 20.0, -30.0, 50.0, 200.0), (2, 1000.0, None, 0.15, 10.0, None, 100.0, None, None, None, None, None), (3, 1000.0, 150.0, None, 10.0, 0.0, None, 100.0, 1.0, 1.0, 1.0, 1.0),
        (4, 0.0, None, None, None, None, None, None, 1.0, 1.0, 1.0, 1.0), (5, 1000.0, 150.0, None, 10.0, 100.0, None, None, 0.0, 0.0, 5000.0, 0.0)]
    got = {r.id: r for r in O.mechanical_label(spark.createDataFrame(rows, RECORD)).collect()}
    flows = [1000 * 1.03**i * (0.15 * 0.79 + 0.02 - 0.03) for i in range(1, 6)]
    flows[-1] *= 1 + 1.025 / (0.09 - 0.025)
    worth = spark.createDataFrame([(flows, got[1].mechanical_irr)], "f array<double>, r double").select(present_value(F.col("f"), F.col("r"))).first()[0]
    assert worth == pytest.approx(1150, rel=1e-6) and got[1].target_ev == 1150 and got[1].mechanical_flags == [] and got[1].price_source == "raw_close_price"
    assert got[2].mechanical_irr is not None and got[2].mechanical_flags == sorted(["raw_price_unavailable", "mechanical_price_asof_unverified", *[f"missing_{n}_mechanical" for n in ("da", "capex", "cash", "debt")]])
    assert got[3].mechanical_irr is None and got[3].mechanical_flags == ["missing_mechanical_price", "raw_price_unavailable", "report_price_ignored_for_mechanical_dcf"]
    assert got[4].mechanical_flags == sorted(["missing_price", *[f"missing_mechanical_{n}" for n in ("operating_income", "price", "revenue", "shares_outstanding")]])
    assert got[5].mechanical_irr is None and got[5].mechanical_flags == ["mechanical_dcf_error"]


def test_universes_and_sector_summary(spark):
    m = universe.with_null_count(spark.createDataFrame([(1, 1.0, 1.0, 1.0), (1, None, None, 1.0), (1, None, None, None), (2, 1.0, None, 1.0)], "date int, a double, b double, c double"), ["a", "b", "c"])
    assert sorted(map(tuple, universe.universe_counts(m).collect())) == [(1, 2, 1), (2, 1, 0)]
    assert (universe.universe_filter(m, "clean").count(), universe.universe_filter(m, "broad").count()) == (1, 3)
    ic = spark.createDataFrame([("x", 10, 0.5), ("x", 20, -0.1), ("x", 30, None), ("x", 40, 0.0), ("y", 5, None)], "sector string, n long, rank_ic double")
    got = {r.sector: tuple(r)[1:] for r in diagnostics.sector_ic_summary(ic, ["sector"]).collect()}
    assert got["x"] == pytest.approx((3, 0.4 / 3, 0.0, 1 / 3, 25.0)) and got["y"] == (0, None, None, None, 5.0)
