"""Queries on valuation reports: an order is a report, its lines are the years of the forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.functions.coerce import settle
from crosspanel.operators import reports as O
from crosspanel.operators.asof import asof
from crosspanel.plans.fact_queries import FEATURES, derived
from crosspanel.plans.registry import PRICES, SECURITIES, R, query
from crosspanel.sources import proxy

REPORTS = """lines AS (SELECT l_orderkey AS report_id, count(*) AS n, min(l_discount) AS least FROM lineitem GROUP BY 1),
reports AS (SELECT o_orderkey AS report_id, o_custkey AS ticker, o_orderstatus AS tier, CAST(o_orderdate AS DATE) AS date, o_totalprice AS revenue0, o_totalprice * 1e-1 AS nwc0,
  CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice * 2e-2 ELSE 0e0 END AS nol, 2.1e-1 AS tax_rate, 8e-1 AS nol_utilization, 4e-2 + (o_orderkey % 10) / 1e2 AS wacc, 2e-2 + (o_orderkey % 4) / 1e2 AS terminal_growth,
  CASE o_orderkey % 3 WHEN 0 THEN 'gordon_growth' WHEN 1 THEN 'exit_multiple' ELSE 'average' END AS method, CASE WHEN o_orderkey % 7 <> 0 THEN 8e0 END AS exit_multiple,
  CASE WHEN o_orderkey % 6 = 0 THEN o_totalprice * 5e-2 END AS net_debt_override, o_totalprice * 2e-1 AS debt, o_totalprice * 1e-1 AS cash, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice * 5e-2 ELSE 0e0 END AS investments,
  CASE WHEN o_orderkey % 8 = 0 THEN o_totalprice * 3e-2 ELSE 0e0 END AS minority_interest, CASE WHEN o_orderkey % 9 = 0 THEN o_totalprice * 2e-2 ELSE 0e0 END AS preferred_equity,
  1e1 + o_orderkey % 100 AS shares, o_totalprice / (2e1 + o_orderkey % 90) AS price FROM orders)"""


def reports(spark, sf) -> DataFrame:
    """Same columns as REPORTS, with the forecast as `years`; orders without lines have an empty forecast."""
    o, l, c, k = proxy.table(spark, sf, "orders"), proxy.table(spark, sf, "lineitem"), F.col, F.col("o_orderkey")
    year = F.struct("l_linenumber", "l_partkey", (c("l_discount") * 2 - 0.05).alias("growth"), (c("l_tax") * 3 - 0.04).alias("ebit_margin"), F.lit(0.03).alias("da"), F.lit(0.04).alias("capex"), F.lit(0.1).alias("nwc"))
    years = l.groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(year)), lambda y: F.struct(*[y[f].alias(f) for f in ("growth", "ebit_margin", "da", "capex", "nwc")])).alias("years"))
    total, zero = c("o_totalprice"), F.lit(0.0)
    return o.join(years, "o_orderkey").select(
        k.alias("report_id"), c("o_custkey").alias("ticker"), c("o_orderstatus").alias("tier"), F.to_date("o_orderdate").alias("date"), "years", total.alias("revenue0"), (total * 0.1).alias("nwc0"),
        F.when(k % 5 == 0, total * 0.02).otherwise(zero).alias("nol"), F.lit(0.21).alias("tax_rate"), F.lit(0.8).alias("nol_utilization"), (0.04 + (k % 10) / 100).alias("wacc"), (0.02 + (k % 4) / 100).alias("terminal_growth"),
        F.when(k % 3 == 0, "gordon_growth").when(k % 3 == 1, "exit_multiple").otherwise("average").alias("method"), F.when(k % 7 != 0, 8.0).alias("exit_multiple"), F.when(k % 6 == 0, total * 0.05).alias("net_debt_override"),
        (total * 0.2).alias("debt"), (total * 0.1).alias("cash"), F.when(k % 4 == 0, total * 0.05).otherwise(zero).alias("investments"), F.when(k % 8 == 0, total * 0.03).alias("minority_interest"), F.when(k % 9 == 0, total * 0.02).alias("preferred_equity"), (10.0 + k % 100).alias("shares"), (total / (20.0 + k % 90)).alias("price"))


_RECURSIVE = f"""WITH RECURSIVE {REPORTS}, yrs AS (SELECT l_orderkey AS report_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_discount, l_tax) AS i, l_discount * 2 - 5e-2 AS growth, l_tax * 3 - 4e-2 AS margin FROM lineitem),
proj AS (SELECT report_id, CAST(0 AS BIGINT) AS i, revenue0 AS revenue, nwc0 AS nwc, nol, 1e0 AS factor, 0e0 AS fcff, 0e0 AS ebitda, 0e0 AS pv FROM reports
  UNION ALL SELECT report_id, i, revenue, revenue * 1e-1, CASE WHEN ebit > 0 THEN nol - used ELSE nol - ebit END, factor, f, ebit + revenue * 3e-2, pv + f * factor FROM (
    SELECT *, ebit - CASE WHEN ebit > 0 THEN (ebit - used) * 2.1e-1 ELSE 0 END + revenue * 3e-2 - revenue * 4e-2 - (revenue * 1e-1 - nwc) AS f FROM (
      SELECT *, CASE WHEN ebit > 0 THEN least(nol, ebit * 8e-1) ELSE 0 END AS used FROM (
        SELECT p.report_id, y.i, p.revenue * (1 + y.growth) AS revenue, p.nwc, p.nol, p.factor / (1 + r.wacc) AS factor, p.pv, p.revenue * (1 + y.growth) * y.margin AS ebit
        FROM proj p JOIN yrs y ON y.report_id = p.report_id AND y.i = p.i + 1 JOIN reports r ON r.report_id = p.report_id)))),
ends AS (SELECT * FROM proj WHERE i > 0 QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY i DESC) = 1),
tv AS (SELECT r.*, e.pv, e.factor, CASE WHEN method <> 'exit_multiple' AND NOT wacc > terminal_growth THEN 'growth_not_below_wacc' WHEN method <> 'gordon_growth' AND exit_multiple IS NULL THEN 'missing_exit_multiple' END AS error,
  CASE method WHEN 'gordon_growth' THEN g WHEN 'exit_multiple' THEN x ELSE (g + x) / 2 END AS raw_terminal
  FROM ends e JOIN reports r USING (report_id), LATERAL (SELECT e.fcff * (1 + r.terminal_growth) / nullif(r.wacc - r.terminal_growth, 0) AS g, e.ebitda * r.exit_multiple AS x)),
val0 AS (SELECT *, CASE WHEN error IS NULL THEN raw_terminal * factor END AS tpv FROM tv), val1 AS (SELECT *, pv + tpv AS ev, coalesce(net_debt_override, debt - cash) AS nd,
  CASE WHEN coalesce(abs(net_debt_override - (debt - cash - investments)) <= greatest(1, abs(investments) * 1e-2) AND abs(net_debt_override - (debt - cash)) > greatest(1, abs(investments) * 1e-2), false) THEN 0 ELSE investments END AS inv FROM val0),
val AS (SELECT *, ev - nd + inv - minority_interest - preferred_equity AS equity, (ev - nd + inv - minority_interest - preferred_equity) / shares AS per_share FROM val1)"""


def _valued(spark, sf):
    return O.valued(reports(spark, sf))


@query(f"{_RECURSIVE} SELECT report_id, error, {R('pv / revenue0')} AS pv, {R('ev / revenue0')} AS ev, {R('per_share / price')} AS relative_value, {R('tpv / nullif(ev, 0)')} AS terminal_share FROM val")
def dcf_values(spark, sf):
    v = _valued(spark, sf)
    return v.select("report_id", "error", *[settle(x).alias(n) for n, x in (("pv", F.col("projection.pv") / F.col("revenue0")), ("ev", F.col("ev") / F.col("revenue0")), ("relative_value", F.col("per_share") / F.col("price")), ("terminal_share", F.col("terminal_share")))])


@query("""WITH o AS (SELECT o_orderkey AS report_id, 4e-2 + (o_orderkey % 10) / 1e2 AS w, 2e-2 + (o_orderkey % 4) / 1e2 AS g, o_orderkey AS k FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))
  SELECT report_id, 'base' AS scenario, floor(w * 1e6 + 0.5001234567) / 1e6 AS wacc, floor(g * 1e6 + 0.5001234567) / 1e6 AS terminal_growth FROM o
  UNION ALL SELECT report_id, 'bull', floor(CASE WHEN k % 2 = 0 THEN w - 1e-2 ELSE w END * 1e6 + 0.5001234567) / 1e6, floor(g * 1e6 + 0.5001234567) / 1e6 FROM o
  UNION ALL SELECT report_id, 'bear', floor((w + 2e-2) * 1e6 + 0.5001234567) / 1e6, floor(CASE WHEN k % 3 = 0 THEN 0 ELSE g END * 1e6 + 0.5001234567) / 1e6 FROM o""")
def scenario_inputs(spark, sf):
    return _scenarios(spark, sf).select("report_id", "scenario", settle(F.col("wacc")).alias("wacc"), settle(F.col("terminal_growth")).alias("terminal_growth"))


def _scenarios(spark, sf):
    k, none = F.col("report_id"), F.lit(None).cast("double")
    bull = F.struct(F.when(k % 2 == 0, F.col("wacc") - 0.01).alias("wacc"), none.alias("terminal_growth"))
    bear = F.struct((F.col("wacc") + 0.02).alias("wacc"), F.when(k % 3 == 0, 0.0).alias("terminal_growth"))
    return O.scenario_inputs(reports(spark, sf).withColumns({"bull": bull, "bear": bear}), ["wacc", "terminal_growth"])


#: The three scenarios of a report as reports of their own, numbered 3 x report_id + 0, 1, 2.
_SCENARIOS = _RECURSIVE.replace("reports AS (SELECT o_orderkey", "reports0 AS (SELECT o_orderkey").replace(
    ", yrs AS (SELECT l_orderkey AS report_id,", """, reports AS (SELECT r.* REPLACE (report_id * 3 + s AS report_id,
  CASE WHEN s = 1 AND report_id % 2 = 0 THEN wacc - 1e-2 WHEN s = 2 THEN wacc + 2e-2 ELSE wacc END AS wacc, CASE WHEN s = 2 AND report_id % 3 = 0 THEN 0e0 ELSE terminal_growth END AS terminal_growth) FROM reports0 r CROSS JOIN range(3) v(s)),
yrs AS (SELECT l_orderkey * 3 + s AS report_id,""").replace("PARTITION BY l_orderkey ORDER BY", "PARTITION BY l_orderkey, s ORDER BY").replace("AS margin FROM lineitem)", "AS margin FROM lineitem CROSS JOIN range(3) v(s))")


@query(f"""{_SCENARIOS}, p AS (SELECT report_id // 3 AS report_id, max(per_share) FILTER (WHERE report_id % 3 = 0) AS base, max(per_share) FILTER (WHERE report_id % 3 = 1) AS bull, max(per_share) FILTER (WHERE report_id % 3 = 2) AS bear FROM val GROUP BY 1)
  SELECT report_id, {R('base')} AS base, {R('bull')} AS bull, {R('bear')} AS bear, coalesce(bear > base, false) OR coalesce(base > bull, false) AS scenario_order_violated FROM p""")
def scenario_order(spark, sf):
    """Values of the three scenarios and whether they are out of order; the projection is held against SQL by dcf_values."""
    v = O.valued(_scenarios(spark, sf)).groupBy("report_id").pivot("scenario", O.MODES).agg(F.first("per_share"))
    return v.select("report_id", *[settle(F.col(m)).alias(m) for m in O.MODES], O.out_of_order(F.col("bear"), F.col("base"), F.col("bull")).alias("scenario_order_violated"))


@query()
def ai_irr(spark, sf):
    """A root search: tested by discounting at the rate found."""
    r = O.ai_irr(_valued(spark, sf))
    return r.select("report_id", settle(F.col("ai_irr")).alias("ai_irr"), F.array_join("irr_flags", ",").alias("irr_flags"))


def _mechanical(spark, sf):
    d = derived(spark, sf)
    ratios = d.withColumns({"da_pct": F.lit(0.02), "capex_pct": F.col("capex_intensity"), "nwc_pct": F.lit(None).cast("double"), "revenue": F.col("market_cap") / 2, "total_debt": F.col("ev") - F.col("market_cap"), "cash": F.lit(0.0)})
    return O.mechanical_irr(ratios.select("ticker", "sector", "market_cap", "revenue", "operating_margin", "da_pct", "capex_pct", "nwc_pct", "total_debt", "cash"))


@query()
def mechanical_irr(spark, sf):
    """A root search: tested by discounting at the rate found."""
    m = _mechanical(spark, sf)
    return m.select("ticker", settle(F.col("mechanical_irr")).alias("mechanical_irr"), F.array_join("mechanical_flags", ",").alias("flags"))


_FLAG = lambda pairs: "array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN {ok} THEN '{n}' END" for n, ok in pairs) + "], lambda x: x IS NOT NULL)), ',')"
_SANITY = [
    ("missing_price", "price IS NULL OR price <= 0"), ("nonpositive_ai_value", "per_share IS NULL OR per_share <= 0"), ("ev_negative", "coalesce(ev <= 0, false)"), ("terminal_value_dominates", "coalesce(abs(tpv / nullif(ev, 0)) > 0.85, false)"),
    ("share_count_outlier", "shares IS NULL OR shares <= 0"), ("missing_wacc", "wacc IS NULL OR wacc <= 0"), ("wacc_terminal_spread_too_small", "coalesce(wacc - terminal_growth <= 0.01, false)"), ("missing_comps", "report_id % 9 = 0"),
    ("forecast_discontinuity", "jump")]


def _flagged(spark, sf):
    c = F.col
    margins = F.transform("years", lambda y: y["ebit_margin"])
    flags = O.sanity_flags(c("price"), c("per_share"), c("upside"), c("ev"), c("terminal_share"), c("shares"), c("shares"), c("wacc"), c("terminal_growth"), c("report_id") % 9, forecast_discontinuity=F.coalesce(O.jumps(margins, 0.155), F.lit(False)))
    return _valued(spark, sf).withColumn("flags", flags)


@query(f"""{_RECURSIVE}, js AS (SELECT report_id, abs(margin - lag(margin) OVER (PARTITION BY report_id ORDER BY i)) > 0.155 AS j FROM yrs), jj AS (SELECT report_id, coalesce(bool_or(j), false) AS jump FROM js GROUP BY 1)
  SELECT report_id, {_FLAG(_SANITY)} AS flags FROM val JOIN jj USING (report_id)""")
def sanity_flags(spark, sf):
    return _flagged(spark, sf).select("report_id", F.array_join("flags", ",").alias("flags"))


@query("""WITH y AS (SELECT l_orderkey AS report_id, count(*) AS n, count(*) FILTER (WHERE abs(l_discount * 100 - round(l_discount * 100)) < 1e-9) AS whole, count(*) FILTER (WHERE abs(l_discount * 20 - round(l_discount * 20)) < 1e-9) AS fives,
    bool_or(l_tax * 3 - 4e-2 < 0) AS neg, bool_or(l_tax * 3 - 4e-2 > 0) AS pos FROM lineitem GROUP BY 1),
  r AS (SELECT report_id, o_orderkey % 11 AS price, 4e-2 + (o_orderkey % 20) / 1e2 AS wacc, (o_orderkey % 7) / 1e2 AS growth, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS margin, o_orderkey % 5 AS comps, n, whole, fives, neg, pos FROM y JOIN orders ON o_orderkey = report_id)
  SELECT report_id, n >= 6 AND whole >= 0.85 * n AS is_round, array_to_string(list_filter([CASE WHEN price = 0 THEN 'stale_price' END, CASE WHEN wacc > 0.205 THEN 'wacc_outlier' END, CASE WHEN growth > 0.055 THEN 'terminal_growth_outlier' END,
    CASE WHEN (margin > 0 AND neg) OR (margin < 0 AND pos) THEN 'margin_reversal' END, CASE WHEN comps < 3 THEN 'missing_comps' END, CASE WHEN fives * 2 > n THEN 'suspiciously_round' END], lambda x: x IS NOT NULL), ',') AS flags FROM r""")
def collection_flags(spark, sf):
    k = F.col("report_id")
    r = reports(spark, sf)
    discounts = F.transform("years", lambda y: (y["growth"] + 0.05) / 2)
    wacc = F.round(0.04 + (k % 20) / 100, 6)
    flags = O.collection_flags(k % 11, wacc, F.round((k % 7) / 100, 6), F.when(k % 2 == 0, 1.0).otherwise(-1.0), F.transform("years", lambda y: y["ebit_margin"]), F.transform("years", lambda y: y["growth"]), k % 5, F.lit(False), F.lit(0.0), discounts)
    return r.select("report_id", O.is_round(discounts).alias("is_round"), F.array_join(flags, ",").alias("flags"))


@query("""SELECT o_orderkey AS report_id, CASE WHEN o_orderkey % 4 = 0 THEN 0.21 ELSE (o_orderkey % 30) / 1e2 END AS tax_rate, CASE WHEN o_orderkey % 5 = 0 THEN 0.02 ELSE (o_orderkey % 4) / 1e2 END AS terminal_growth,
    CASE WHEN o_orderkey % 6 = 0 THEN 'missing_wacc' WHEN o_orderkey % 7 = 0 THEN 'missing_shares' END AS reason,
    CASE WHEN o_orderkey % 20 = 0 THEN 'default_tax_rate,default_terminal_growth' WHEN o_orderkey % 4 = 0 THEN 'default_tax_rate' WHEN o_orderkey % 5 = 0 THEN 'default_terminal_growth' ELSE '' END AS flags FROM orders""")
def normalize_inputs(spark, sf):
    k = F.col("o_orderkey")
    percent = lambda n: F.concat((k % n).cast("string"), F.lit("%"))
    raw = proxy.table(spark, sf, "orders").select(
        k.alias("report_id"), F.when(k % 4 == 0, "n/a").otherwise(percent(30)).alias("tax_rate"), F.when(k % 5 != 0, percent(4)).alias("terminal_growth"), F.lit("80%").alias("nol_utilization"),
        F.when(k % 6 == 0, "-").otherwise("9%").alias("wacc"), F.format_string("$%.2f", "o_totalprice").alias("revenue"), F.when(k % 7 == 0, "(3)").otherwise("1,000").alias("shares"))
    n = O.normalize_inputs(raw)
    return n.select("report_id", "tax_rate", "terminal_growth", "reason", F.array_join("flags", ",").alias("flags"))


@query(f"""WITH {PRICES}, {FEATURES}, {SECURITIES}, last AS (SELECT * FROM prices WHERE raw_close > 0), rep AS (SELECT o_orderkey AS report_id, o_custkey % 150 AS ticker, CAST(o_orderdate AS DATE) AS date, (o_orderkey % 40) / 1e2 AS ai_irr FROM orders),
  pr AS (SELECT r.*, p.raw_close FROM rep r ASOF LEFT JOIN last p ON r.ticker = p.ticker AND r.date >= p.date)
  SELECT report_id, pr.ticker, pr.date, {R('pr.raw_close')} AS raw_close, coalesce(CASE WHEN feat.ticker % 3 <> 0 THEN feat.sector END, sec.sector) AS sector,
    CASE WHEN feat.ticker % 3 <> 0 AND feat.sector IS NOT NULL THEN 'features' WHEN sec.sector IS NOT NULL THEN 'sector_map' ELSE 'missing' END AS sector_source, {R('coalesce(pr.raw_close * 1e2, feat.market_cap)')} AS market_cap, {R('ai_irr - roe')} AS label_minus_baseline
  FROM pr LEFT JOIN feat ON feat.ticker = pr.ticker LEFT JOIN sec ON sec.ticker = pr.ticker""")
def label_panel(spark, sf):
    """Features stand in for the mechanical rate by return on equity, so that SQL can check the assembly."""
    k = F.col("o_orderkey")
    rep = proxy.table(spark, sf, "orders").select(k.alias("report_id"), (F.col("o_custkey") % 150).alias("ticker"), F.to_date("o_orderdate").alias("date"), ((k % 40) / 100).alias("ai_irr"))
    d = derived(spark, sf).withColumns({"shares": F.when(F.col("ticker").isNotNull(), 100.0), "mechanical_irr": F.col("roe"), "sector": F.when(F.col("ticker") % 3 != 0, F.col("sector"))})
    p = proxy.prices(spark, sf).filter("raw_close > 0").select("ticker", F.col("date").alias("_at"), "raw_close")
    priced = asof(rep.select("ticker", "date").distinct(), p, ["ticker"], "date", "_at", ["raw_close"])
    out = O.label_panel(rep, d, proxy.securities(spark, sf), priced)
    return out.select("report_id", "ticker", "date", settle(F.col("raw_close")).alias("raw_close"), "sector", "sector_source", settle(F.col("market_cap")).alias("market_cap"), settle(F.col("label_minus_baseline")).alias("label_minus_baseline"))


@query(f"""{_RECURSIVE}, js AS (SELECT report_id, abs(margin - lag(margin) OVER (PARTITION BY report_id ORDER BY i)) > 0.155 AS j FROM yrs), jj AS (SELECT report_id, coalesce(bool_or(j), false) AS jump FROM js GROUP BY 1),
  fl AS (SELECT report_id, per_share, error, {_FLAG(_SANITY)} AS flags FROM val JOIN jj USING (report_id))
  SELECT 'coverage' AS kind, 'per_share' AS name, count(per_share) AS n, {R('count(per_share) * 1.0 / count(*)')} AS share FROM fl UNION ALL SELECT 'coverage', 'error', count(error), {R('count(error) * 1.0 / count(*)')} FROM fl
  UNION ALL SELECT 'flag', name, count(*), {R('count(*) * 1.0 / (SELECT count(*) FROM fl)')} FROM (SELECT unnest(string_split(flags, ',')) AS name FROM fl WHERE flags <> '') GROUP BY name""")
def label_summary(spark, sf):
    return O.label_summary(_flagged(spark, sf), ["per_share", "error"]).withColumn("share", settle(F.col("share")))


@query("""WITH t AS (SELECT o_custkey AS ticker, o_orderstatus AS tier, o_orderkey AS report, o_totalprice AS value FROM orders WHERE o_orderstatus IN ('F', 'O') QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
  SELECT ticker, max(report) FILTER (WHERE tier = 'F') AS report_a, max(value) FILTER (WHERE tier = 'F') AS value_a, max(report) FILTER (WHERE tier = 'O') AS report_b, max(value) FILTER (WHERE tier = 'O') AS value_b FROM t GROUP BY 1""")
def tier_comparison(spark, sf):
    f = proxy.filings(spark, sf).withColumn("report", F.col("accession"))
    return O.tier_comparison(f, "F", "O", ["report", "value"], ["filed", "accession"])


@query("""SELECT o_orderstatus AS tier, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS done, count(*) FILTER (WHERE o_orderkey % 3 = 1) AS failed, count(*) FILTER (WHERE o_orderkey % 3 = 2) AS skipped, floor(sum(o_totalprice) * 1e6 + 0.5001234567) / 1e6 AS cost,
  CAST(sum(1 + CAST(o_totalprice > 100000 AS INTEGER)) AS BIGINT) AS flags FROM orders GROUP BY 1""")
def collection_summary(spark, sf):
    k = F.col("o_orderkey")
    runs = proxy.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("tier"), F.when(k % 3 == 0, "done").when(k % 3 == 1, "failed").otherwise("skipped").alias("status"), F.col("o_totalprice").cast("string").alias("cost"), F.array_compact(F.array(F.lit("seen"), F.when(F.col("o_totalprice") > 100000, F.lit("dear")))).alias("flags"))
    return O.collection_summary(runs).withColumn("cost", settle(F.col("cost")))


@query(f"""WITH {PRICES}, {FEATURES}, {SECURITIES}, last AS (SELECT * FROM prices WHERE raw_close > 0), rep AS (SELECT o_orderkey AS report_id, o_custkey % 150 AS ticker, CAST(o_orderdate AS DATE) AS date, o_orderkey AS k FROM orders),
  pr AS (SELECT r.*, p.raw_close FROM rep r ASOF LEFT JOIN last p ON r.ticker = p.ticker AND r.date >= p.date),
  rc AS (SELECT l_suppkey AS ticker, count(*) AS n, {R('sum(l_extendedprice)')} AS revenue FROM lineitem GROUP BY 1),
  j AS (SELECT pr.*, rc.ticker AS known, revenue, CASE WHEN rc.ticker % 7 <> 0 THEN revenue * 1e-1 END AS income, CASE WHEN rc.ticker % 11 <> 0 THEN n * 1e3 END AS shares, CASE WHEN rc.ticker % 5 <> 0 THEN revenue * 5e-2 END AS cash, coalesce(feat.sector, sec.sector) AS sector
    FROM pr LEFT JOIN rc ON rc.ticker = pr.ticker LEFT JOIN feat ON feat.ticker = pr.ticker LEFT JOIN sec ON sec.ticker = pr.ticker),
  u AS (SELECT *, known IS NOT NULL AND income IS NOT NULL AND shares IS NOT NULL AND raw_close IS NOT NULL AS usable FROM j),
  f AS (SELECT *, list_filter([CASE WHEN k % 9 = 0 THEN 'stale_price' END, CASE WHEN k % 10 = 0 THEN 'default_terminal_growth' END, CASE WHEN k % 12 = 0 THEN 'missing_wacc' END, CASE WHEN k % 15 = 0 THEN 'margin_reversal' END], lambda x: x IS NOT NULL) AS own,
    list_filter([CASE WHEN usable AND cash IS NULL THEN 'missing_cash_mechanical' END, CASE WHEN income IS NULL THEN 'missing_mechanical_operating_income' END, CASE WHEN raw_close IS NULL THEN 'missing_mechanical_price' END, CASE WHEN revenue IS NULL THEN 'missing_mechanical_revenue' END,
      CASE WHEN shares IS NULL THEN 'missing_mechanical_shares_outstanding' END, CASE WHEN raw_close IS NULL THEN 'missing_price' END], lambda x: x IS NOT NULL) AS made FROM u)
  SELECT report_id, ticker, sector, array_to_string(own || made, ',') AS flags, k % 12 = 0 OR raw_close IS NULL AS excluded, CASE WHEN k % 12 = 0 OR raw_close IS NULL THEN 0e0 ELSE 1e0 / (1 + CAST(k % 9 = 0 AS INTEGER) + CAST(k % 10 = 0 AS INTEGER)) END AS label_weight,
    {R('CASE WHEN usable THEN (raw_close * shares + revenue * 1e-1 - coalesce(cash, 0)) / revenue END')} AS target_by_revenue FROM f""")
def weighted_label_panel(spark, sf):
    """Labels with the rate of the company's own figures at the report's price, flags, policy and weight."""
    k, c = F.col("o_orderkey"), F.col
    own = F.array_compact(F.array(F.when(k % 9 == 0, "stale_price"), F.when(k % 10 == 0, "default_terminal_growth"), F.when(k % 12 == 0, "missing_wacc"), F.when(k % 15 == 0, "margin_reversal")))
    rep = proxy.table(spark, sf, "orders").select(k.alias("report_id"), (c("o_custkey") % 150).alias("ticker"), F.to_date("o_orderdate").alias("date"), ((k % 40) / 100).alias("ai_irr"), own.alias("flags"))
    sums = proxy.table(spark, sf, "lineitem").groupBy(c("l_suppkey").alias("ticker")).agg(F.count("*").alias("n"), settle(F.sum("l_extendedprice")).alias("revenue"))
    none = F.lit(None).cast("double")
    records = sums.select(
        "ticker", "revenue", F.when(c("ticker") % 7 != 0, c("revenue") * 0.1).alias("operating_income"), none.alias("operating_margin"), F.when(c("ticker") % 11 != 0, c("n") * 1000.0).alias("shares"), none.alias("current_price"), none.alias("report_price"),
        (c("revenue") * 0.02).alias("da"), (c("revenue") * -0.03).alias("capex"), F.when(c("ticker") % 5 != 0, c("revenue") * 0.05).alias("cash"), (c("revenue") * 0.1).alias("total_debt"))
    p = proxy.prices(spark, sf).filter("raw_close > 0").select("ticker", c("date").alias("_at"), "raw_close")
    priced = asof(rep.select("ticker", "date").distinct(), p, ["ticker"], "date", "_at", ["raw_close"])
    d = derived(spark, sf).withColumn("shares", F.lit(100.0))
    out = O.weighted_label_panel(rep, records, d, proxy.securities(spark, sf), priced)
    return out.select("report_id", "ticker", "sector", F.array_join("flags", ",").alias("flags"), "excluded", "label_weight", "target_ev").join(sums.select("ticker", "revenue"), "ticker", "left").select(
        "report_id", "ticker", "sector", "flags", "excluded", "label_weight", settle(c("target_ev") / c("revenue")).alias("target_by_revenue"))
