"""Queries on reports as JSON text, written from the orders and their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.functions.coerce import settle
from crosspanel.operators import report_inputs as O
from crosspanel.operators import reports as V
from crosspanel.plans.registry import R, query
from crosspanel.sources import proxy


def payloads(spark, sf) -> DataFrame:
    """(report_id, payload): lines are forecast years from 2026; some gaps, wrong figures, missing and clashing parts."""
    o, l, k = proxy.table(spark, sf, "orders"), proxy.table(spark, sf, "lineitem"), F.col("o_orderkey")
    i = F.row_number().over(V.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_discount", "l_tax"))
    line = l.withColumn("i", i).withColumn("y", (F.col("i") + 2025).cast("string"))
    percent = lambda x: F.concat(F.round(x * 100).cast("int").cast("string"), F.lit("%"))
    line = line.select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_quantity") <= 40, F.struct("y", percent(F.col("l_discount")))).alias("growth"), F.struct("y", percent(F.col("l_tax"))).alias("margin"))
    by_year = lambda e: F.map_from_entries(F.array_sort(F.collect_list(e))).alias(e)
    entries = line.groupBy("o_orderkey").agg(by_year("growth"), by_year("margin"), F.count("*").alias("n"))
    text = lambda *pairs: F.map_from_arrays(F.array(*[F.lit(p[0]) if isinstance(p[0], str) else p[0] for p in pairs]), F.array(*[p[1].cast("string") for p in pairs]))
    some = lambda ok, value: F.when(ok, value)
    total = F.col("o_totalprice")
    ebit = F.when(k % 11 == 0, text(("2025", F.lit("n/a")))).when(k % 13 == 0, text(("2023", total * 0.1))).otherwise(text(("2024", total * 0.08), ("2025", total * 0.1)))
    history = F.struct(text(("2024", total), ("2025", total * 1.25)).alias("revenue"), ebit.alias("ebit"), text(("2025", total * 0.05)).alias("capex"))
    wacc = F.when(k % 7 == 0, "n/a").when(k % 17 == 0, "about ten").otherwise(F.concat((F.lit(6) + k % 5).cast("string"), F.lit("%")))
    figures = F.struct(wacc.alias("wacc"), F.concat(F.lit("1,0"), (k % 90 + 10).cast("string")).alias("diluted_shares"), some(k % 2 == 0, F.lit("21%")).alias("tax_rate"), some(k % 3 == 0, F.lit("0")).alias("terminal_growth"), some(k % 4 == 0, F.lit("(5)")).alias("cash"))
    bull = F.struct(F.struct(text(("2027", F.lit("30%"))).alias("revenue_growth")).alias("forecast"), F.struct(some(k % 2 == 0, F.lit("5%")).alias("wacc")).alias("assumptions"))
    bear = F.struct(F.struct(text((F.concat((F.col("n") + 2026).cast("string")), F.lit("(2%)"))).alias("revenue_growth")).alias("forecast"))
    forecast = F.struct(F.when(k % 19 == 0, F.map_concat("growth", F.create_map(F.lit("next"), F.lit("1%")))).otherwise(F.col("growth")).alias("revenue_growth"), F.col("margin").alias("ebit_margin"))
    payload = F.to_json(F.struct(k.cast("string").alias("ticker"), history.alias("historical"), some(k % 23 != 0, forecast).alias("forecast"), figures.alias("assumptions"), F.struct(bull.alias("bull"), bear.alias("bear")).alias("scenarios")))
    return o.join(entries, "o_orderkey").select(k.alias("report_id"), payload.alias("payload"))


_LINES = """lines AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_discount, l_tax) AS i, l_quantity, round(l_discount * 100) / 100 AS g, round(l_tax * 100) / 100 AS m FROM lineitem),
o AS (SELECT o_orderkey AS k, o_totalprice, (SELECT count(*) FROM lines WHERE lines.k = o_orderkey) AS n FROM orders WHERE o_orderkey IN (SELECT k FROM lines)),
why AS (SELECT k, list_filter([CASE WHEN k % 11 = 0 THEN 'missing_historical_ebit' END, CASE WHEN k % 11 <> 0 AND k % 13 = 0 THEN 'no_common_year' END, CASE WHEN k % 7 = 0 OR k % 17 = 0 THEN 'missing_wacc' END,
  CASE WHEN k % 19 = 0 AND k % 23 <> 0 THEN 'bad_year:forecast.revenue_growth.next' END, CASE WHEN k % 7 <> 0 AND k % 17 = 0 THEN 'bad_number:assumptions.wacc' END], lambda x: x IS NOT NULL) AS reasons FROM o),
u AS (SELECT o.* FROM o JOIN why USING (k) WHERE len(reasons) = 0)"""
_BASE = f"""{_LINES}, given AS (SELECT k, 2025 + i AS year, CASE WHEN l_quantity <= 40 THEN g END AS g, m FROM lines JOIN u USING (k) WHERE k % 23 <> 0),
base AS (SELECT k, year, coalesce(last_value(g IGNORE NULLS) OVER (PARTITION BY k ORDER BY year), 0) AS growth, m AS margin FROM given
  UNION ALL SELECT k, y, 0, 8e-2 FROM u CROSS JOIN range(2026, 2031) v(y) WHERE k % 23 = 0),
ends AS (SELECT k, max(year) AS top, max_by(growth, year) AS growth, max_by(margin, year) AS margin FROM base GROUP BY 1),
sc AS (SELECT k, 'base' AS scenario, year, growth, margin FROM base
  UNION ALL SELECT k, 'bull', year, CASE WHEN year = 2027 THEN 3e-1 ELSE growth END, margin FROM base
  UNION ALL SELECT k, 'bull', 2027, 3e-1, margin FROM ends WHERE top < 2027
  UNION ALL SELECT base.k, 'bear', year, CASE WHEN year = n + 2026 THEN -2e-2 ELSE growth END, margin FROM base JOIN u USING (k)
  UNION ALL SELECT ends.k, 'bear', n + 2026, -2e-2, margin FROM ends JOIN u USING (k) WHERE n + 2026 > top)"""


def _rows(spark, sf):
    return O.normalized(payloads(spark, sf))


@query(f"WITH {_LINES} SELECT k AS report_id, list_aggregate(reasons, 'string_agg', ';') AS reasons FROM why WHERE len(reasons) > 0")
def quarantined_reports(spark, sf):
    """Reports that cannot be used, with all reasons."""
    _, bad = O.split(_rows(spark, sf))
    return bad.select("report_id", F.array_join("reasons", ";").alias("reasons"))


@query(f"""WITH {_LINES} SELECT k AS report_id, CAST(CASE WHEN k % 23 = 0 THEN 5 ELSE n END AS INTEGER) AS years, {R('6e-2 + (k % 5) / 1e2')} AS wacc, 2.1e-1 AS tax_rate, CASE WHEN k % 3 = 0 THEN 0e0 ELSE 2e-2 END AS terminal_growth,
  1e3 + k % 90 + 1e1 AS shares, CASE WHEN k % 4 = 0 THEN -5e0 ELSE 0e0 END AS cash, concat_ws(',', CASE WHEN k % 2 <> 0 THEN 'default_tax_rate' END, CASE WHEN k % 3 <> 0 THEN 'default_terminal_growth' END) AS flags FROM u""")
def normalized_reports(spark, sf):
    good, _ = O.split(_rows(spark, sf))
    return good.select("report_id", F.size("years").alias("years"), settle(F.col("base.wacc")).alias("wacc"), "base.tax_rate", "base.terminal_growth", F.col("base.diluted_shares").alias("shares"), "base.cash", F.array_join("flags", ",").alias("flags"))


@query(f"""WITH {_BASE} SELECT k AS report_id, scenario, CAST(year AS INTEGER) AS year, {R('growth')} AS growth, {R('margin')} AS margin, 4e-2 AS capex,
  {R("CASE WHEN scenario = 'bull' AND k % 2 = 0 THEN 5e-2 ELSE 6e-2 + (k % 5) / 1e2 END")} AS wacc FROM sc""")
def scenario_forecasts(spark, sf):
    """A row for each scenario and year, gaps filled and overrides merged."""
    good, _ = O.split(_rows(spark, sf))
    of = [F.map_values(f"forecast.{d}").alias(n) for d, n in (("revenue_growth", "growth"), ("ebit_margin", "margin"), ("capex_pct_sales", "capex"))]  # in the order of years
    s = O.scenarios(good).select("report_id", "scenario", F.col("base.wacc").alias("wacc"), F.explode(F.arrays_zip(F.col("years").alias("year"), *of)).alias("y"))
    return s.select("report_id", "scenario", "y.year", *[settle(F.col(f"y.{n}")).alias(n) for n in ("growth", "margin", "capex")], settle(F.col("wacc")).alias("wacc"))
