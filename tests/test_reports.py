"""Valuation reports against plain Python: projections, taxes with losses, terminal values, rates, flags."""

import json
import math

import pytest
from pyspark.sql import functions as F

from crosspanel.operators import reports as O
from crosspanel.sources import files

YEARS = "array<struct<growth:double,ebit_margin:double,da:double,capex:double,nwc:double>>"
SCHEMA = f"id int, years {YEARS}, revenue0 double, nwc0 double, nol double, tax_rate double, nol_utilization double, wacc double, terminal_growth double, method string, exit_multiple double, net_debt_override double, debt double, cash double, investments double, shares double, price double"
FORECAST = [(0.1, -0.05, 0.03, 0.04, 0.1), (0.2, 0.1, 0.03, 0.04, 0.12), (0.05, 0.2, 0.02, 0.05, 0.1)]


def row(i, method="gordon_growth", wacc=0.1, growth=0.02, multiple=None, override=None, investments=0.0, years=FORECAST):
    return (i, years, 1000.0, 90.0, 20.0, 0.21, 0.8, wacc, growth, method, multiple, override, 300.0, 100.0, investments, 50.0, 20.0)


def flows():
    revenue, held, losses, out = 1000.0, 90.0, 20.0, []
    for growth, margin, da, capex, nwc in FORECAST:
        revenue *= 1 + growth
        profit = revenue * margin
        used = min(losses, profit * 0.8) if profit > 0 else 0.0
        tax = (profit - used) * 0.21 if profit > 0 else 0.0
        losses += -used if profit > 0 else -profit
        out.append((profit - tax + revenue * da - revenue * capex - (revenue * nwc - held), profit + revenue * da))
        held = revenue * nwc
    return out


def test_values_by_each_method(spark):
    rows = [row(1), row(2, "exit_multiple", multiple=8.0), row(3, "average", multiple=8.0), row(4, wacc=0.02), row(5, "average"), row(6, years=[])]
    got = {r.id: r for r in O.valued(spark.createDataFrame(rows, SCHEMA)).collect()}
    f = flows()
    pv = sum(x / 1.1 ** (i + 1) for i, (x, _) in enumerate(f))
    gordon, leave = f[-1][0] * 1.02 / 0.08, f[-1][1] * 8
    for i, end in ((1, gordon), (2, leave), (3, (gordon + leave) / 2)):
        assert got[i].ev == pytest.approx(pv + end / 1.1**3)
        assert got[i].per_share == pytest.approx((pv + end / 1.1**3 - 200) / 50)
        assert got[i].upside == pytest.approx(got[i].per_share / 20 - 1)
    assert got[4].error == "growth_not_below_wacc" and got[4].ev is None
    assert got[5].error == "missing_exit_multiple" and got[6].ev is None


def test_investments_inside_an_override_count_once(spark):
    rows = [row(1, override=150.0, investments=50.0), row(2, override=200.0, investments=50.0), row(3, investments=50.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    adjust = O.investments_adjustment(*[F.col(c) for c in ("investments", "net_debt_override", "debt", "cash")])
    assert {r[0]: r[1] for r in df.select("id", adjust).collect()} == {1: 0.0, 2: 50.0, 3: 50.0}


def test_rate_discounts_flows_to_the_target(spark):
    r = O.ai_irr(O.valued(spark.createDataFrame([row(1), row(2, years=[])], SCHEMA))).orderBy("id").collect()
    f = [x for x, _ in flows()]
    f[-1] += f[-1] * 1.02 / 0.08
    assert sum(x / (1 + r[0].ai_irr) ** (i + 1) for i, x in enumerate(f)) == pytest.approx(50 * 20 + 200, rel=1e-6)
    assert r[0].irr_flags == [] and r[1].irr_flags == ["missing_ai_irr", "missing_scenario"]


def test_mechanical_rate_and_missing_inputs(spark):
    rows = [("A", 1000.0, 0.2, 0.03, 0.04, 0.1, 1500.0, 100.0, None), ("B", None, 0.2, 0.03, 0.04, 0.1, 1500.0, 100.0, 10.0)]
    df = spark.createDataFrame(rows, "ticker string, revenue double, operating_margin double, da_pct double, capex_pct double, nwc_pct double, market_cap double, total_debt double, cash double")
    a, b = O.mechanical_irr(df).orderBy("ticker").collect()
    revenue, f = 1000.0, []
    for _ in range(5):
        f.append(revenue * 1.03 * (0.2 * 0.79 - 0.01) - revenue * 0.03 * 0.1)
        revenue *= 1.03
    f[-1] += f[-1] * 1.025 / 0.065
    assert sum(x / (1 + a.mechanical_irr) ** (i + 1) for i, x in enumerate(f)) == pytest.approx(1600, rel=1e-6)
    assert a.mechanical_flags == ["missing_cash"]
    assert b.mechanical_irr is None and b.mechanical_flags == ["missing_critical_input"]


def test_scenarios_merge_over_the_base(spark):
    df = spark.createDataFrame([(1, 0.1, 0.02, (None, 0.03), (0.12, None))], "id int, wacc double, g double, bull struct<wacc:double,g:double>, bear struct<wacc:double,g:double>")
    got = {r.scenario: (r.wacc, r.g) for r in O.scenario_inputs(df, ["wacc", "g"]).collect()}
    assert got == {"base": (0.1, 0.02), "bull": (0.1, 0.03), "bear": (0.12, 0.02)}


def test_shape_flags(spark):
    df = spark.createDataFrame([(1, [0.01, 0.02, 0.03, 0.04, 0.05, 0.06]), (2, [0.1, 0.4]), (3, []), (4, [0.011, 0.02, 0.031, 0.04, 0.05, 0.06])], "id int, v array<double>")
    got = {r[0]: (r[1], bool(r[2])) for r in df.select("id", O.is_round(F.col("v")), O.jumps(F.col("v"), 0.25)).collect()}
    assert got == {1: (True, False), 2: (False, True), 3: (False, False), 4: (False, False)}


def test_years_and_normalised_inputs(spark):
    df = spark.createDataFrame([({2026: 0.1}, {2027: 0.2}), (None, None)], "a map<int,double>, b map<int,double>")
    got = [r[0] for r in df.select(O.forecast_years(F.col("a"), F.col("b"), last_year=F.lit(2024), declared=F.lit(3))).collect()]
    assert got == [[2026, 2027], [2025, 2026, 2027]]
    raw = spark.createDataFrame([("0%", None, "", "9%", "$1,000", "10"), ("25%", "3%", "50%", None, "5", "1")], "tax_rate string, terminal_growth string, nol_utilization string, wacc string, revenue string, shares string")
    a, b = O.normalize_inputs(raw).collect()
    assert (a.tax_rate, a.terminal_growth, a.nol_utilization, a.flags, a.reason) == (0.0, 0.02, 0.8, ["default_terminal_growth"], None)
    assert math.isclose(b.tax_rate, 0.25) and b.reason == "missing_wacc"


def test_prior_claims_come_before_the_shares(spark):
    plain = spark.createDataFrame([row(1)], SCHEMA)
    claims = plain.withColumns({"minority_interest": F.lit(30.0), "preferred_equity": F.lit(None).cast("double")})
    a, b = (O.ai_irr(O.valued(x)).collect()[0] for x in (plain, claims))
    assert b.equity == pytest.approx(a.equity - 30) and b.target_ev == pytest.approx(a.target_ev + 30) and b.ai_irr < a.ai_irr


def test_parsing_tries_later_braces(spark):
    body = '{"choices": [{"message": {"content": "see {not json} then {\\"a\\": {\\"b\\": 1}} end"}}]}'
    r = files.clean_llm_content(spark.createDataFrame([(1, body)], "response_id long, body string")).collect()[0]
    assert json.loads(r.object) == {"a": {"b": 1}} and r.failure is None and r.warnings == ["leading_text"]


def test_policy_and_weight_of_flags(spark):
    from crosspanel.operators import valuation

    flags = {1: [], 2: ["stale_price", "margin_reversal"], 3: ["stale_price", "terminal_value_dominates"], 4: ["ev_negative", "stale_price"], 5: ["unheard_of"]}
    df = spark.createDataFrame(list(flags.items()), "k int, flags array<string>")
    got = {r.k: (r.p, r.w) for r in df.select("k", valuation.flag_policy(F.col("flags")).alias("p"), valuation.label_weight(F.col("flags"), valuation.EXCLUDE, valuation.DOWNWEIGHT).alias("w")).collect()}
    assert got == {
        1: ({}, 1.0), 2: ({"stale_price": "downweight", "margin_reversal": "warning"}, 0.5), 3: ({"stale_price": "downweight", "terminal_value_dominates": "downweight"}, pytest.approx(1 / 3)),
        4: ({"ev_negative": "exclude", "stale_price": "downweight"}, 0.0), 5: ({"unheard_of": "warning"}, 1.0)}
