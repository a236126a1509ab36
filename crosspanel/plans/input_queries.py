"""Queries on inputs of reports: year maps, missing figures, prices, costs, sector templates, universes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.functions import coerce
from crosspanel.functions.coerce import settle
from crosspanel.operators import diagnostics, universe
from crosspanel.operators import reports as O
from crosspanel.plans.fact_queries import FEATURES, derived
from crosspanel.plans.registry import PANEL, R, query, ranked
from crosspanel.sources import proxy

_FIRST, _LAST, _DEFAULT = 1999, 2002, 0.025
_YEARS = f"""y AS (SELECT l_orderkey AS report_id, CAST(year(l_shipdate) AS INTEGER) AS year, max(l_discount) AS base, max(l_tax) FILTER (WHERE l_returnflag = 'R') AS other FROM lineitem GROUP BY 1, 2),
  f AS (SELECT report_id, arg_min(base, year) AS first FROM y GROUP BY 1),
  g AS (SELECT report_id, CAST(t.year AS INTEGER) AS year, first, base, other, last_value(base IGNORE NULLS) OVER (PARTITION BY report_id ORDER BY t.year ROWS UNBOUNDED PRECEDING) AS held
    FROM f CROSS JOIN (SELECT unnest(range({_FIRST}, {_LAST + 1})) AS year) t LEFT JOIN y USING (report_id, year))"""


def _year_maps(spark, sf) -> DataFrame:
    """A row for each order: discounts (base) and some taxes (other) by year of its lines, and the years asked for."""
    tax = F.when(F.col("l_returnflag") == "R", F.col("l_tax"))
    y = proxy.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("report_id"), F.year("l_shipdate").alias("year")).agg(F.max("l_discount").alias("base"), F.max(tax).alias("other"))
    by_year = lambda c: F.map_filter(F.map_from_entries(F.collect_list(F.struct("year", c))), lambda _, v: v.isNotNull()).alias(c)
    return y.groupBy("report_id").agg(by_year("base"), by_year("other")).withColumn("years", F.sequence(F.lit(_FIRST), F.lit(_LAST)))


@query(f"WITH {_YEARS} SELECT report_id, year, coalesce(held, {_DEFAULT}) AS value FROM g")
def fill_years(spark, sf):
    m = _year_maps(spark, sf)
    return m.select("report_id", F.explode(coerce.fill_years(F.col("base"), F.col("years"), F.lit(_DEFAULT))).alias("year", "value"))


@query(f"WITH {_YEARS} SELECT report_id, year, coalesce(other, held, first) AS value FROM g")
def merge_years(spark, sf):
    m = _year_maps(spark, sf)
    return m.select("report_id", F.explode(coerce.merge_years(F.col("base"), F.col("other"), F.col("years"))).alias("year", "value"))


_RAW = ["roe", "ev", "market_cap", "sector"]


@query(f"""WITH {FEATURES} SELECT ticker, array_to_string(list_filter([{', '.join(f"CASE WHEN {n} IS NULL THEN '{n}' END" for n in _RAW)}], lambda x: x IS NOT NULL), ',') AS missing FROM feat""")
def missing_fields(spark, sf):
    return derived(spark, sf).select("ticker", F.array_join(coerce.missing_fields(_RAW), ",").alias("missing"))


@query("""SELECT o_orderkey AS report_id, CASE WHEN o_orderstatus = 'F' THEN round(o_custkey * 20 / 1e6 * 2e-1 + (o_orderkey % 500 + o_orderkey % 90) * 20 / 1e6 * 1.25e0, 6)
    WHEN o_orderstatus = 'O' THEN round(o_custkey * 20 / 1e6 * 2.5e0 + (o_orderkey % 500 + o_orderkey % 90) * 20 / 1e6 * 1.5e1, 6) END AS cost FROM orders""")
def llm_cost(spark, sf):
    k = F.col("o_orderkey")
    tier = F.when(F.col("o_orderstatus") == "F", "cheap").when(F.col("o_orderstatus") == "O", "full").otherwise("other")
    return proxy.table(spark, sf, "orders").select(k.alias("report_id"), coerce.llm_cost(tier, F.col("o_custkey") * 20, k % 500 * 20, k % 90 * 20).alias("cost"))


_HOLDS = " ".join(f"WHEN {' OR '.join(f"contains(t, '{''.join(x for x in n if x.isalnum())}')" for n in names)} THEN '{key}'" for key, names in coerce.SECTOR_NAMES.items())


@query(f"""WITH s AS (SELECT 'part' AS kind, p_partkey AS id, p_name AS name FROM part UNION ALL SELECT 'customer', c_custkey, c_mktsegment FROM customer UNION ALL SELECT 'document', doc_id, text FROM documents),
  n AS (SELECT kind, id, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS t FROM s) SELECT kind, id, CASE {_HOLDS} ELSE 'general' END AS template FROM n""")
def sector_template(spark, sf):
    named = lambda t, kind, key, name: proxy.table(spark, sf, t).select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"), F.col(name).alias("name"))
    s = named("part", "part", "p_partkey", "p_name").unionByName(named("customer", "customer", "c_custkey", "c_mktsegment")).unionByName(named("documents", "document", "doc_id", "text"))
    return s.select("kind", "id", coerce.sector_template(F.col("name")).alias("template"))


@query("""WITH r AS (SELECT o_orderkey AS k, o_totalprice AS revenue, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice * 1e-1 WHEN o_orderkey % 14 = 0 THEN o_totalprice * 1.2e-1 END AS income, CASE WHEN o_orderkey % 11 <> 0 THEN 1e2 END AS shares,
    CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 1e2 END AS raw, CASE WHEN o_orderkey % 5 < 3 THEN o_totalprice / 1.2e2 END AS current, CASE WHEN o_orderkey % 2 = 0 THEN 1e0 END AS report, CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice * 5e-2 END AS cash FROM orders),
  q AS (SELECT *, coalesce(raw, current) AS price FROM r), u AS (SELECT *, income IS NOT NULL AND shares IS NOT NULL AND price IS NOT NULL AS usable FROM q)
  SELECT k AS report_id, CASE WHEN raw > 0 THEN 'raw_close_price' WHEN current > 0 THEN 'legacy_edgar_current_price' END AS price_source, floor(CASE WHEN usable THEN (price * shares + revenue * 1e-1 - coalesce(cash, 0)) / revenue END * 1e6 + 0.5001234567) / 1e6 AS target_by_revenue,
    array_to_string(list_sort(list_filter([CASE WHEN raw IS NULL AND current > 0 THEN 'mechanical_price_asof_unverified' END, CASE WHEN usable AND cash IS NULL THEN 'missing_cash_mechanical' END, CASE WHEN usable AND k % 17 = 0 THEN 'missing_da_mechanical' END,
      CASE WHEN income IS NULL THEN 'missing_mechanical_operating_income' END, CASE WHEN price IS NULL THEN 'missing_mechanical_price' END, CASE WHEN shares IS NULL THEN 'missing_mechanical_shares_outstanding' END, CASE WHEN price IS NULL AND report IS NULL THEN 'missing_price' END,
      CASE WHEN raw IS NULL AND (current > 0 OR report > 0) THEN 'raw_price_unavailable' END, CASE WHEN price IS NULL AND report > 0 THEN 'report_price_ignored_for_mechanical_dcf' END], lambda x: x IS NOT NULL)), ',') AS flags FROM u""")
def mechanical_label(spark, sf):
    """Price, flags and enterprise value of the mechanical label; every usable row has a rate here, else a flag shows it."""
    k, total = F.col("o_orderkey"), F.col("o_totalprice")
    r = proxy.table(spark, sf, "orders").select(
        k.alias("report_id"), total.alias("revenue"), F.when(k % 7 != 0, total * 0.1).alias("operating_income"), F.when(k % 14 == 0, 0.12).alias("operating_margin"), F.when(k % 11 != 0, 100.0).alias("shares"), F.when(k % 3 == 0, total / 100).alias("raw_close"),
        F.when(k % 5 < 3, total / 120).alias("current_price"), F.when(k % 2 == 0, 1.0).alias("report_price"), F.when(k % 17 != 0, total * 0.02).alias("da"), (-total * 0.03).alias("capex"), F.when(k % 13 != 0, total * 0.05).alias("cash"), (total * 0.1).alias("total_debt"))
    m = O.mechanical_label(r)
    return m.select("report_id", "price_source", settle(F.col("target_ev") / F.col("revenue")).alias("target_by_revenue"), F.array_join("mechanical_flags", ",").alias("flags"))


@query(f"WITH {PANEL}, ic AS (SELECT * FROM {ranked('panel', 'date, sector')}) SELECT sector, count(rank_ic) AS months, {R('avg(rank_ic)')} AS mean_ic, {R('quantile_cont(rank_ic, 0.5)')} AS median_ic, {R('avg(CASE WHEN rank_ic > 0 THEN 1.0 WHEN rank_ic IS NOT NULL THEN 0.0 END)')} AS positive_share, {R('avg(n)')} AS mean_n FROM ic GROUP BY 1")
def sector_ic_summary(spark, sf):
    ic = diagnostics.spearman(proxy.panel(spark, sf), ["date", "sector"], "score", "ret")
    s = diagnostics.sector_ic_summary(ic, ["sector"])
    return s.select("sector", "months", *[settle(F.col(c)).alias(c) for c in ("mean_ic", "median_ic", "positive_share", "mean_n")])


_NULLS = "CAST(score IS NULL AS INTEGER) + CAST(ret IS NULL AS INTEGER) + CAST(market_cap <= 0 AS INTEGER) + CAST(ticker % 9 = 0 AS INTEGER)"


@query(f"WITH {PANEL} SELECT date, count(*) FILTER (WHERE {_NULLS} <= 2) AS broad_count, count(*) FILTER (WHERE {_NULLS} = 0) AS clean_count FROM panel GROUP BY 1")
def universe_counts(spark, sf):
    p = proxy.panel(spark, sf).withColumns({"cap": F.when(F.col("market_cap") > 0, F.col("market_cap")), "other": F.when(F.col("ticker") % 9 != 0, 1.0)})
    return universe.universe_counts(universe.with_null_count(p, ["score", "ret", "cap", "other"]))
