"""Reports as JSON text: defaults, explicit zeros, years, reasons and merged scenarios."""

import json

import pytest
from pyspark.sql import functions as F

from crosspanel.functions.coerce import parse_amount
from crosspanel.operators import report_inputs as O
from crosspanel.operators import reports

PLAIN = {"historical": {"revenue": {"2025": 100}, "ebit": {"2025": 10}}, "forecast": {"revenue_growth": {"2026": 0.1}}, "assumptions": {"wacc": 0.09, "diluted_shares": 10}}


def changed(**more):
    out = json.loads(json.dumps(PLAIN))
    for path, value in more.items():
        at = out
        *above, last = path.split("__")
        for p in above:
            at = at.setdefault(p, {})
        at[last] = value
    return out


REPORTS = {
    "plain": PLAIN,
    "zeros": changed(assumptions__tax_rate=0.0, assumptions__terminal_growth="0%", assumptions__nol_utilization_pct=0),
    "declared": changed(forecast={}, forecast_years="3", historical__revenue={"2023": "90", "2024": "1,000"}, historical__ebit={"2024": "(50)", "2025": 1}, historical__capex={"2024": 20}),
    "margin": changed(assumptions__target_ebit_margin="15%", forecast__da_pct_sales={"2027": 3, "2026": "n/a"}),
    "scenarios": changed(scenarios={"bull": {"forecast": {"revenue_growth": {"2028": "20%"}}, "assumptions": {"wacc": "8%", "tax_rate": 0}}, "bear": {"forecast": {"ebit_margin": {"2026": "-5%"}}}}, forecast__revenue_growth={"2026": 0.1, "2027": 0.05}),
    "no_history": changed(historical={}),
    "no_overlap": changed(historical__ebit={"2019": 3}),
    "many": changed(historical__revenue={"25": 1, "2025": "lots"}, assumptions={"wacc": "0", "diluted_shares": True, "terminal_method": "guess"}, forecast=[1], scenarios={"bull": 3}),
    "no_object": [1, 2],
}


@pytest.fixture(scope="module")
def normal(spark):
    rows = [(k, json.dumps(v)) for k, v in REPORTS.items()] + [("broken", "{no"), ("null", None)]
    df = O.normalized(spark.createDataFrame(rows, "report_id string, payload string"))
    df.cache()
    return df


def test_defaults_years_and_zeros(normal):
    got = {r.report_id: r for r in O.split(normal)[0].collect()}
    assert set(got) == {"plain", "zeros", "declared", "margin", "scenarios"}
    p = got["plain"]
    assert (p.base.tax_rate, p.base.terminal_growth, p.base.nol_utilization_pct, p.base.terminal_method, p.flags) == (0.21, 0.02, 0.8, "average", ["default_tax_rate", "default_terminal_growth"])
    assert p.years == [2026] and p.forecast.ebit_margin == {2026: pytest.approx(0.1)} and p.forecast.da_pct_sales == {2026: 0.0}
    z = got["zeros"]
    assert (z.base.tax_rate, z.base.terminal_growth, z.base.nol_utilization_pct, z.flags) == (0.0, 0.0, 0.0, [])
    d = got["declared"]
    assert d.years == [2025, 2026, 2027] and d.forecast.ebit_margin[2027] == pytest.approx(-0.05) and d.forecast.capex_pct_sales[2025] == pytest.approx(0.02)
    m = got["margin"]
    assert m.years == [2026, 2027] and m.forecast.ebit_margin == {2026: 0.15, 2027: 0.15} and m.forecast.da_pct_sales == {2026: 0.0, 2027: 0.03}


def test_all_reasons_are_told(normal):
    good, bad = O.split(normal)
    got = {r.report_id: r.reasons for r in bad.collect()}
    assert got["no_history"] == ["missing_historical_revenue", "missing_historical_ebit"] and got["no_overlap"] == ["no_common_year"]
    assert got["no_object"][0] == got["broken"][0] == got["null"][0] == "not_an_object"
    assert set(got["many"]) == {
        "not_an_object:forecast", "not_an_object:scenarios.bull", "missing_historical_revenue", "missing_wacc", "missing_diluted_shares", "bad_year:historical.revenue.25", "bad_number:historical.revenue.2025",
        "bad_number:assumptions.diluted_shares", "bad_terminal_method:assumptions"}
    assert good.count() + len(got) == len(REPORTS) + 2


def test_scenarios_merge_over_the_base(normal):
    s = O.scenarios(O.split(normal)[0].filter("report_id = 'scenarios'"))
    got = {r.scenario: r for r in s.collect()}
    assert got["base"].years == [2026, 2027] and got["bull"].years == [2026, 2027, 2028]
    assert got["bull"].forecast.revenue_growth == {2026: 0.1, 2027: 0.05, 2028: 0.2} and got["bull"].forecast.ebit_margin[2028] == pytest.approx(0.1)
    assert got["bear"].forecast.ebit_margin == {2026: -0.05, 2027: pytest.approx(0.1)}
    assert (got["bull"].base.wacc, got["bull"].base.tax_rate, got["bear"].base.wacc, got["bear"].base.tax_rate) == (0.08, 0.0, 0.09, 0.21)
    valued = {r.scenario: r for r in reports.valued(O.for_projection(s)).collect()}
    assert valued["bull"].error == "missing_exit_multiple" and len(valued["bull"].projection.years) == 3
    assert valued["base"].projection.years[0].fcff == pytest.approx(110 * 0.1 * 0.79)


def test_amounts(spark):
    texts = {"0.5%": 0.005, "15%": 0.15, "0.08": 0.08, "1.5": 0.015, "150%": 1.5, "(2%)": -0.02, "$1,2x": 0.12, "-": None, "abc": None}
    got = {r.t: r.v for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", parse_amount(F.col("t"), ratio=True).alias("v")).collect()}
    assert got == {t: v if v is None else pytest.approx(v) for t, v in texts.items()}


def test_texts_are_read_once_in_batches(spark):
    """Not expression by expression, each level of a text anew."""
    df = O.normalized(spark.createDataFrame([("plain", json.dumps(PLAIN))], "report_id string, payload string"))
    for used in (O.split(df)[0].select("report_id", "base.wacc", "flags"), O.split(df)[1].select("report_id", "reasons"), O.scenarios(O.split(df)[0]).select("report_id", "scenario", "forecast")):
        plan = used._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "from_json" not in plan and "lambda" not in plan


def test_amounts_of_batches_are_those_of_columns(spark):
    from crosspanel.operators import report_json

    texts = ["5%", "0.08", "1.5", "(2%)", "$1,2x", "n/a ", "--", "nan", "$nan", "-inf", "1e3", "2f", "0x1p3", "%)", "(5% )", "5%)\n", "5x%", "()", "(3", "", ".5", "5.", "1e400", "1 2", "\t7", "1e", "٣", "infx", "0.1234567890123456789", True, [5]]
    rows = [(i, t if isinstance(t, str) else json.dumps(t)) for i, t in enumerate(texts)]
    got = spark.createDataFrame(rows, "i int, t string").select("i", parse_amount(F.col("t"), True).alias("r"), parse_amount(F.col("t")).alias("p")).orderBy("i").collect()
    for t, g in zip(texts, got, strict=True):
        assert [repr(report_json.amount(t, ratio) or None) for ratio in (True, False)] == [repr(g.r or None), repr(g.p or None)], t


def test_loose_json_is_read_as_before(spark):
    """Keys written twice (the first counts), single quotes, JSON within texts, what follows the object, lists for objects."""
    plain = json.dumps(PLAIN)
    texts = {
        "twice": plain.replace('"2026": 0.1', '"2026": 0.1, "2026": 0.7, "2027": "x", "2027": 0.2').replace('"wacc": 0.09', '"wacc": "8%", "wacc": "x"'), "single": plain.replace('"', "'"), "more": f" {plain} x",
        "within": json.dumps(PLAIN | {"assumptions": json.dumps(PLAIN["assumptions"])}), "cut": plain[:-3], "list": json.dumps(PLAIN | {"forecast": [1]}), "plus": plain.replace("0.09", "+INF")}
    got = {r.report_id: r for r in O.normalized(spark.createDataFrame(list(texts.items()), "report_id string, payload string")).collect()}
    assert got["twice"].reasons == ["bad_number:forecast.revenue_growth.2027"]
    assert [got[k].base.wacc for k in ("single", "more", "within", "plus")] == [0.09, 0.09, 0.09, float("inf")] and got["within"].forecast.revenue_growth == {2026: 0.1}
    assert got["cut"].reasons[0] == "not_an_object" and got["list"].reasons == ["not_an_object:forecast"]


def test_many_declared_years(spark):
    long = json.dumps(changed(forecast={}, forecast_years="20,000"))
    got = O.normalized(spark.createDataFrame([("long", long)], "report_id string, payload string")).select(F.size("years"), F.array_max("years"), F.size("bear.years")).first()
    assert list(got) == [20000, 22025, 20000]
