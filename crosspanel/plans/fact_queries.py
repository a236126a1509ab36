"""Queries on facts, filings and fundamentals."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosspanel.functions.coerce import settle
from crosspanel.operators import facts as O
from crosspanel.operators import quality, xsec
from crosspanel.operators.asof import asof
from crosspanel.plans.registry import FILINGS, PRICES, R, query
from crosspanel.sources import proxy
from crosspanel.sources.fundamentals import FIELDS, company_facts, features

_SUMS = {
    "revenue": "l_extendedprice", "net_income": "l_extendedprice * l_discount", "total_assets": "l_quantity * 1000", "long_debt": "CASE WHEN l_linestatus = 'F' THEN l_extendedprice * l_tax END",
    "short_debt": "CASE WHEN l_linestatus = 'O' THEN l_extendedprice * l_tax END", "tangible": "CASE WHEN l_quantity > 25 THEN l_quantity END", "intangible": "CASE WHEN l_quantity <= 5 THEN l_quantity END",
    "cost": "CASE WHEN l_returnflag <> 'A' THEN l_extendedprice * (1 - l_discount) END"}
CFACTS = f"""csums AS (SELECT l_suppkey AS ticker, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS start, ascii(l_returnflag) - 65 AS rank, {', '.join(f'{R(f"sum({x})")} AS {k}' for k, x in _SUMS.items())} FROM lineitem GROUP BY 1, 2, 3),
cf0 AS ({' UNION ALL '.join(f"SELECT ticker, start, rank, '{k}' AS field, {k} AS value FROM csums WHERE {k} IS NOT NULL" for k in _SUMS)}),
cf1 AS (SELECT *, CAST(start + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS "end", CAST(start + INTERVAL 3 MONTH + INTERVAL 44 DAY AS DATE) AS filed FROM cf0),
cfacts AS (SELECT *, ticker || '-' || strftime(filed, '%Y%m%d') AS accn, CAST(year("end") AS INTEGER) AS fy, CASE WHEN month("end") = 12 THEN '10-K' ELSE '10-Q' END AS form,
  CASE WHEN field = 'cost' AND ticker % 2 = 0 THEN 'dei' ELSE 'us-gaap' END AS taxonomy FROM cf1)"""
ANCHORS = """anchors AS (SELECT ticker, field AS anchor_field, "end" AS anchor_end, accn AS anchor_accn FROM cfacts WHERE field IN ('revenue', 'net_income', 'total_assets')
  QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY CASE field WHEN 'revenue' THEN 1 WHEN 'net_income' THEN 2 ELSE 3 END, "end" DESC, filed DESC, rank) = 1)"""
_CHOSEN = f"""{CFACTS}, {ANCHORS}, chosen AS (SELECT ticker, field, value, "end", filed, accn FROM cfacts LEFT JOIN anchors USING (ticker)
  QUALIFY row_number() OVER (PARTITION BY ticker, field ORDER BY coalesce(accn = anchor_accn, false) DESC, coalesce("end" = anchor_end, false) DESC, coalesce(-abs("end" - anchor_end), -1e9) DESC, "end" DESC, filed DESC, rank) = 1)"""


@query(f"WITH {CFACTS}, {ANCHORS} SELECT * FROM anchors")
def anchor_facts(spark, sf):
    return O.anchor_facts(company_facts(spark, sf))


def _selected(spark, sf):
    f = company_facts(spark, sf)
    return O.select_facts(f, O.anchor_facts(f))


@query(f"WITH {_CHOSEN} SELECT * FROM chosen")
def selected_facts(spark, sf):
    return _selected(spark, sf)


_WIDE = f"{_CHOSEN}, wide AS (SELECT ticker, {', '.join(f'max(value) FILTER (WHERE field = {chr(39)}{k}{chr(39)}) AS {k}' for k in _SUMS)} FROM chosen GROUP BY ticker)"


@query(f"""WITH {_WIDE} SELECT ticker, CASE WHEN long_debt IS NOT NULL OR short_debt IS NOT NULL THEN {R('coalesce(abs(long_debt), 0) + coalesce(abs(short_debt), 0)')} END AS total_debt,
  CASE WHEN tangible IS NOT NULL OR intangible IS NOT NULL THEN {R('coalesce(tangible, 0) + coalesce(intangible, 0)')} END AS da, {R('revenue - abs(coalesce(cost, net_income))')} AS gross_profit FROM wide""")
def derived_facts(spark, sf):
    w = _selected(spark, sf).groupBy("ticker").pivot("field", FIELDS).agg(F.first("value"))
    none, c = F.lit(None).cast("double"), F.col
    return w.select("ticker", settle(O.total_debt(none, c("long_debt"), c("short_debt"))).alias("total_debt"), settle(O.depreciation(none, c("tangible"), c("intangible"))).alias("da"), settle(O.gross_profit(none, c("revenue"), c("cost"), c("net_income"))).alias("gross_profit"))


@query(f"""WITH {CFACTS}, p AS (SELECT ticker, "end", max(CASE WHEN field = 'total_assets' AND ticker % 3 = 0 AND value > 100000 THEN value END) AS d, max(CASE WHEN field = 'long_debt' THEN value END) AS l, max(CASE WHEN field = 'short_debt' THEN value END) AS s FROM cfacts GROUP BY 1, 2)
  SELECT ticker, "end", CASE WHEN count(d) OVER (PARTITION BY ticker) > 0 THEN d WHEN l IS NOT NULL OR s IS NOT NULL THEN {R('coalesce(l, 0) + coalesce(s, 0)')} END AS debt FROM p""")
def quarterly_debt(spark, sf):
    of = lambda ok: F.max(F.when(ok, F.col("value")))
    direct = (F.col("field") == "total_assets") & (F.col("ticker") % 3 == 0) & (F.col("value") > 100000)
    p = company_facts(spark, sf).groupBy("ticker", "end").agg(of(direct).alias("direct_debt"), of(F.col("field") == "long_debt").alias("long_debt"), of(F.col("field") == "short_debt").alias("short_debt"))
    return O.quarterly_debt(p).select("ticker", "end", settle(F.col("debt")).alias("debt"))


_SNAP = f"""{CFACTS}, picked AS (SELECT ticker, accn, field, value FROM cfacts QUALIFY row_number() OVER (PARTITION BY ticker, accn, field ORDER BY "end" DESC, rank) = 1),
snap AS (SELECT p.ticker, p.accn, m.filed, m.period_end, m.fy, m.form, max(value) FILTER (WHERE field = 'revenue') AS revenue, max(value) FILTER (WHERE field = 'net_income') AS net_income, max(value) FILTER (WHERE field = 'total_assets') AS total_assets
  FROM picked p JOIN (SELECT ticker, accn, max(filed) AS filed, max("end") AS period_end, max(fy) AS fy, max(form) AS form FROM cfacts GROUP BY 1, 2) m ON m.ticker = p.ticker AND m.accn = p.accn GROUP BY ALL)"""
_SNAP_FIELDS = ["revenue", "net_income", "total_assets"]


def _snapshots(spark, sf):
    return O.filing_snapshots(company_facts(spark, sf), _SNAP_FIELDS)


@query(f"WITH {_SNAP} SELECT * FROM snap")
def filing_snapshots(spark, sf):
    return _snapshots(spark, sf).drop("filing")


@query(f"""WITH {_SNAP}, g AS (SELECT ticker, accn, filed, fy, total_assets, CASE WHEN month(period_end) = 6 THEN NULL WHEN month(period_end) = 9 THEN CAST(period_end - INTERVAL 1 YEAR AS DATE) ELSE period_end END AS p,
    CASE WHEN ticker % 4 <> 0 THEN fy END AS y FROM snap), k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY filed NULLS FIRST, p NULLS FIRST, accn) AS i FROM g)
  SELECT a.ticker, a.accn, arg_max_null(b.p, b.i) AS prior_period_end, arg_max_null(b.total_assets, b.i) AS prior_total_assets
  FROM k a LEFT JOIN k b ON a.ticker = b.ticker AND b.i < a.i AND coalesce(b.p < a.p, b.y < a.y, true) GROUP BY 1, 2""")
def prior_filing(spark, sf):
    """Some filings lack their period or report one of a year before, and some companies have no fiscal years."""
    month, end = F.month("period_end"), F.col("period_end")
    s = _snapshots(spark, sf).withColumns({"period_end": F.when(month == 6, None).when(month == 9, F.add_months(end, -12)).otherwise(end), "fy": F.when(F.col("ticker") % 4 != 0, F.col("fy"))})
    return O.with_prior_filing(s, ["total_assets"]).select("ticker", "accn", "prior_period_end", "prior_total_assets")


@query(f"""WITH {PRICES}, {_SNAP}, s AS (SELECT *, lag(total_assets) OVER (PARTITION BY ticker ORDER BY filed, period_end, accn) AS prior_total_assets FROM snap),
  px AS (SELECT g.ticker, g.date, p.raw_close, p.adjusted_close FROM grid g ASOF JOIN prices p ON g.ticker = p.ticker AND g.date >= p.date)
  SELECT px.ticker, px.date, px.raw_close, px.adjusted_close, s.accn, s.revenue, {R('s.net_income / nullif(s.revenue, 0)')} AS net_margin, {R('s.total_assets / nullif(s.prior_total_assets, 0) - 1')} AS asset_growth
  FROM px ASOF JOIN s ON px.ticker = s.ticker AND px.date > s.filed""")
def pit_matrix(spark, sf):
    """Point-in-time matrix: last price at, and last filing before, each rebalance date; rows lacking either go."""
    p = proxy.prices(spark, sf)
    events = p.select("ticker", F.col("date").alias("_at"), F.struct("raw_close", "adjusted_close").alias("px"))
    priced = asof(proxy.grid(p), events, ["ticker"], "date", "_at", ["px"]).filter("px is not null")
    snaps = O.with_prior_filing(_snapshots(spark, sf), ["total_assets"])
    filed = snaps.select("ticker", F.col("filed").alias("_at"), F.struct("accn", "revenue", "net_income", "total_assets", "prior_total_assets").alias("f"))
    m = asof(priced, filed, ["ticker"], "date", "_at", ["f"], strict=True).filter("f is not null")
    return m.select("ticker", "date", "px.raw_close", "px.adjusted_close", "f.accn", "f.revenue", settle(F.try_divide("f.net_income", "f.revenue")).alias("net_margin"), settle(F.try_divide("f.total_assets", "f.prior_total_assets") - 1).alias("asset_growth"))


_REFS = f"""{CFACTS}, refs AS (SELECT ticker, accn, max(form) AS form, max(filed) AS filed, max("end") AS "end" FROM (SELECT *, max(CAST(taxonomy = 'dei' AS INTEGER)) OVER (PARTITION BY ticker) AS dei FROM cfacts) WHERE taxonomy = 'dei' OR dei = 0 GROUP BY 1, 2)"""


@query(f"WITH {_REFS} SELECT * FROM refs")
def filing_refs(spark, sf):
    return O.filing_refs(company_facts(spark, sf))


@query(f"""WITH {_REFS}, k AS (SELECT *, row_number() OVER (PARTITION BY ticker, form ORDER BY filed DESC, accn DESC) AS lookback_rank FROM refs)
  SELECT ticker, accn, form, filed, CAST(lookback_rank AS INTEGER) AS lookback_rank, 'filings/' || ticker || '/' || replace(accn, '-', '') || '.txt' AS path, filed IS NOT NULL AND accn IS NOT NULL AS date_limited_source FROM k WHERE lookback_rank <= 2""")
def corpus_requests(spark, sf):
    refs = O.filing_refs(company_facts(spark, sf))
    return O.corpus_requests(refs, refs).drop("flags")


@query(f"WITH {FILINGS} SELECT ticker, tier, accession, filed, value FROM filings QUALIFY row_number() OVER (PARTITION BY ticker, tier ORDER BY filed DESC, accession DESC) = 1")
def latest_report(spark, sf):
    return O.latest_report(proxy.filings(spark, sf), ["ticker", "tier"], ["filed", "accession"]).select("ticker", "tier", "accession", "filed", "value")


_F = {
    "raw_close": "avg(l_extendedprice / l_quantity)", "ocf": "sum(l_extendedprice * l_discount)", "capex": "sum(-l_extendedprice * l_tax / 2)", "total_debt": "sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice * l_tax END)",
    "ebit": "sum(l_extendedprice * l_discount * l_tax * 10)", "equity": "sum(l_quantity * 100)", "net_income": "sum(CASE WHEN l_linestatus = 'F' THEN l_extendedprice * l_discount END)",
    "gross_profit": "sum(CASE WHEN l_quantity > 10 THEN l_extendedprice * 0.3 END)", "revenue": "sum(l_extendedprice)", "assets": "sum(l_quantity * 2000)",
    "prior_assets": "sum(CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN l_quantity * 4000 END)", "current_assets": "sum(CASE WHEN l_quantity > 40 THEN l_extendedprice END)", "current_liabilities": "sum(CASE WHEN l_quantity < 10 THEN l_extendedprice END)"}
_D = {
    "fcf_to_ev": "CASE WHEN ev > 0 THEN fcf / ev END", "fcf_yield": "fcf / nullif(market_cap, 0)", "roic": "0.79 * ebit / nullif(equity + total_debt - cash, 0)", "roe": "net_income / nullif(equity, 0)",
    "gross_margin": "gross_profit / nullif(revenue, 0)", "operating_margin": "ebit / nullif(revenue, 0)", "net_margin": "net_income / nullif(revenue, 0)", "gross_profitability_assets": "gross_profit / nullif(assets, 0)",
    "book_to_market": "equity / nullif(market_cap, 0)", "debt_to_equity": "total_debt / nullif(equity, 0)", "current_ratio": "current_assets / nullif(current_liabilities, 0)", "asset_turnover": "revenue / nullif(assets, 0)",
    "asset_growth_1y": "(assets - prior_assets) / nullif(prior_assets, 0)", "cash_earnings_gap": "(ocf - net_income) / nullif(assets, 0)", "accruals": "(net_income - ocf) / nullif(assets, 0)", "capex_intensity": "abs(capex) / nullif(revenue, 0)"}
FEATURES = f"""feat0 AS (SELECT l_suppkey AS ticker, CAST(count(*) AS DOUBLE) AS shares, {', '.join(f'{R(x)} AS {k}' for k, x in _F.items())} FROM lineitem GROUP BY 1),
feat1 AS (SELECT f.*, r_name AS sector, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS cash, CASE WHEN shares <> 0 THEN raw_close * shares END AS market_cap, ocf - abs(capex) AS fcf
  FROM feat0 f JOIN supplier ON s_suppkey = ticker JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
feat2 AS (SELECT *, market_cap + total_debt - cash AS ev FROM feat1),
feat AS (SELECT ticker, sector, market_cap, fcf, ev, {', '.join(f'{R(x)} AS {k}' for k, x in _D.items())} FROM feat2)"""
DERIVED = list(_D)


def derived(spark, sf):
    d = O.derive(features(spark, sf))
    return d.select("ticker", "sector", "market_cap", "fcf", "ev", *[settle(F.col(k)).alias(k) for k in DERIVED])


@query(f"WITH {FEATURES} SELECT ticker, sector, {R('market_cap')} AS market_cap, {R('fcf')} AS fcf, {R('ev')} AS ev, {', '.join(_D)} FROM feat")
def derive_fundamentals(spark, sf):
    d = derived(spark, sf)
    return d.select("ticker", "sector", *[settle(F.col(c)).alias(c) for c in ("market_cap", "fcf", "ev")], *DERIVED)


@query(f"""WITH {_WIDE}, two AS (SELECT ticker, value, row_number() OVER (PARTITION BY ticker ORDER BY "end" DESC) AS k FROM (SELECT * FROM cfacts WHERE field = 'total_assets' QUALIFY row_number() OVER (PARTITION BY ticker, "end" ORDER BY filed DESC, rank) = 1)),
  g AS (SELECT ticker, max(value) FILTER (WHERE k = 1) AS a, max(value) FILTER (WHERE k = 2) AS b FROM two GROUP BY 1)
  SELECT s_suppkey AS ticker, wide.revenue, {R('wide.net_income / nullif(wide.revenue, 0)')} AS net_margin, {R('g.a / nullif(g.b, 0) - 1')} AS asset_growth_1y, CASE WHEN wide.ticker IS NULL THEN 'no facts for ticker ' || s_suppkey END AS error
  FROM supplier LEFT JOIN wide ON wide.ticker = s_suppkey LEFT JOIN g ON g.ticker = s_suppkey""")
def current_features(spark, sf):
    """Newest state of each known company: facts by anchor, growth of the latest two totals; without facts an error text."""
    f = company_facts(spark, sf)
    wide = O.select_facts(f, O.anchor_facts(f)).groupBy("ticker").pivot("field", ["revenue", "net_income"]).agg(F.first("value"))
    ends = f.filter("field = 'total_assets'").groupBy("ticker", "end").agg(F.max_by("value", F.struct("filed", -F.col("rank"))).alias("v"))
    last = F.reverse(F.array_sort(F.collect_list(F.struct("end", "v"))))
    growth = ends.groupBy("ticker").agg(last.alias("l")).select("ticker", (F.try_divide(F.try_element_at("l", F.lit(1))["v"], F.try_element_at("l", F.lit(2))["v"]) - 1).alias("g"))
    known = proxy.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("ticker"))
    error = F.when(F.col("revenue").isNull() & F.col("net_income").isNull(), F.concat(F.lit("no facts for ticker "), F.col("ticker").cast("string")))
    return known.join(wide, "ticker", "left").join(growth, "ticker", "left").select("ticker", "revenue", settle(F.try_divide("net_income", "revenue")).alias("net_margin"), settle(F.col("g")).alias("asset_growth_1y"), error.alias("error"))


@query(f"WITH {CFACTS} SELECT count(*) AS rows, {R('avg(CAST(accn IS NOT NULL AS INTEGER))')} AS accn_coverage, count(*) FILTER (WHERE form = '10-K') AS annual, count(*) FILTER (WHERE value > 1e5) AS large FROM cfacts")
def fact_summary(spark, sf):
    s = quality.summary_row(company_facts(spark, sf), ["accn"], {"annual": F.col("form") == "10-K", "large": F.col("value") > 1e5})
    return s.withColumn("accn_coverage", settle(F.col("accn_coverage")))


TAGGED = """tagged AS (SELECT l_orderkey AS ticker, l_linenumber AS line, l_returnflag AS tag, CASE l_linenumber % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'shares' ELSE 'USD' END AS unit,
  CASE l_linenumber % 6 WHEN 0 THEN '10-K' WHEN 1 THEN '10-Q' WHEN 2 THEN '20-F' WHEN 3 THEN '10-Q/A' WHEN 4 THEN '10-K/A' ELSE '8-K' END AS form, 'Q' || CAST(l_partkey % 4 + 1 AS VARCHAR) AS fp,
  CASE WHEN l_returnflag <> 'A' THEN CAST(l_shipdate AS DATE) END AS start, CAST(l_shipdate AS DATE) + CAST(l_quantity * 9 AS INTEGER) AS "end", l_linestatus = 'F' AS is_duration, l_extendedprice AS value FROM lineitem)"""


def tagged(spark, sf):
    """Same columns as TAGGED: facts of many forms, units and lengths, some without a start."""
    nth = F.col("l_linenumber") % 6
    form = F.when(nth == 0, "10-K").when(nth == 1, "10-Q").when(nth == 2, "20-F").when(nth == 3, "10-Q/A").when(nth == 4, "10-K/A").otherwise("8-K")
    unit = F.when(F.col("l_linenumber") % 3 == 0, "EUR").when(F.col("l_linenumber") % 3 == 1, "shares").otherwise("USD")
    day = F.to_date("l_shipdate")
    return proxy.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("ticker"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("tag"), unit.alias("unit"), form.alias("form"), F.concat(F.lit("Q"), (F.col("l_partkey") % 4 + 1).cast("string")).alias("fp"),
        F.when(F.col("l_returnflag") != "A", day).alias("start"), F.date_add(day, (F.col("l_quantity") * 9).cast("int")).alias("end"), (F.col("l_linestatus") == "F").alias("is_duration"), F.col("l_extendedprice").alias("value"))


@query(f"""WITH {TAGGED} SELECT ticker, line, form, start, "end", value FROM tagged WHERE form IN ({', '.join(f"'{f}'" for f in O.ANNUAL_FORMS)}) AND (NOT is_duration OR coalesce("end" - start BETWEEN 300 AND 380, false))""")
def annual_facts(spark, sf):
    return O.annual_facts(tagged(spark, sf)).select("ticker", "line", "form", "start", "end", "value")


@query(f"""WITH {TAGGED} SELECT ticker, line, form, fp, start, "end", value FROM tagged WHERE form IN ('10-Q', '10-Q/A') AND fp IN ('Q1', 'Q2', 'Q3') AND (NOT is_duration OR coalesce("end" - start BETWEEN 45 AND 130, false))""")
def quarterly_facts(spark, sf):
    return O.quarterly_facts(tagged(spark, sf)).select("ticker", "line", "form", "fp", "start", "end", "value")


@query(f"""WITH {TAGGED}, placed AS (SELECT *, CASE unit WHEN 'USD' THEN 1 WHEN 'EUR' THEN 2 END AS place FROM tagged), best AS (SELECT *, min(place) OVER (PARTITION BY ticker, tag) AS first FROM placed)
  SELECT ticker, line, tag, unit, value FROM best WHERE first IS NULL OR place = first""")
def preferred_unit(spark, sf):
    return O.preferred_unit(tagged(spark, sf), ["USD", "EUR"]).select("ticker", "line", "tag", "unit", "value")


@query("""WITH s AS (SELECT s_nationkey AS grp, s_suppkey AS ticker, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS score FROM supplier
    UNION ALL SELECT 100 + c_nationkey, c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END FROM customer),
  r AS (SELECT *, count(score) OVER (PARTITION BY grp) AS n, row_number() OVER (PARTITION BY grp ORDER BY score DESC NULLS LAST, ticker) - 1 AS i FROM s)
  SELECT grp, ticker, CASE WHEN score IS NOT NULL THEN 'Q' || CAST(CASE WHEN n < 3 THEN 1 WHEN n < 50 THEN 2 * (i * 3 // n) + 1 ELSE (i * 5 // n) + 1 END AS VARCHAR) END AS bucket FROM r""")
def buckets_small(spark, sf):
    part = lambda t, x, by: proxy.table(spark, sf, t).select((F.col(f"{x}_nationkey") + by).cast("long").alias("grp"), F.col({"s": "s_suppkey", "c": "c_custkey"}[x]).cast("long").alias("ticker"), F.when(F.col(f"{x}_acctbal") > 0, F.col(f"{x}_acctbal")).alias("score"))
    both = part("supplier", "s", 0).unionByName(part("customer", "c", 100))
    return both.select("grp", "ticker", xsec.bucket_small("score", "ticker", ["grp"]).alias("bucket"))


@query("""WITH e AS (SELECT (SELECT count(*) FROM orders) AS rows, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS keys, (SELECT count(*) FROM customer) AS open),
  f AS (SELECT count(*) AS rows, count(DISTINCT o_orderkey) AS keys, count(*) FILTER (WHERE o_orderstatus = 'O') AS open FROM orders)
  SELECT 'rows' AS "check", f.rows AS found, e.rows AS expected, f.rows = e.rows AS ok FROM e, f UNION ALL SELECT 'keys', f.keys, e.keys, f.keys = e.keys FROM e, f UNION ALL SELECT 'open', f.open, e.open, f.open = e.open FROM e, f""")
def check_counts(spark, sf):
    t = lambda n: proxy.table(spark, sf, n)
    one = [t("orders").agg(F.count("*").alias("rows")), t("lineitem").agg(F.countDistinct("l_orderkey").alias("keys")), t("customer").agg(F.count("*").alias("open"))]
    expected = one[0].crossJoin(one[1]).crossJoin(one[2])  # one row each
    return quality.check_counts(t("orders"), expected, ["o_orderkey"], {"open": F.col("o_orderstatus") == "O"})


@query("""WITH r AS (SELECT count(*) AS rows, count(CASE WHEN l_returnflag <> 'A' THEN l_tax END) AS ret_1m, count(l_discount) AS ret_3m, 0 AS ret_12m FROM lineitem),
  u AS (SELECT rows, 'ret_1m' AS horizon, ret_1m AS non_null FROM r UNION ALL SELECT rows, 'ret_3m', ret_3m FROM r UNION ALL SELECT rows, 'ret_12m', ret_12m FROM r)
  SELECT horizon, rows, CAST(non_null AS BIGINT) AS non_null, non_null * 1.0 / rows AS share, CASE WHEN non_null = 0 THEN 'blocked' WHEN non_null < rows THEN 'partial' ELSE 'complete' END AS status FROM u""")
def return_coverage(spark, sf):
    lines = proxy.table(spark, sf, "lineitem").select(F.when(F.col("l_returnflag") != "A", F.col("l_tax")).alias("ret_1m"), F.col("l_discount").alias("ret_3m"), F.lit(None).cast("double").alias("ret_12m"))
    return quality.return_coverage(lines, ["ret_1m", "ret_3m", "ret_12m"])


_FIELD = "CASE WHEN line % 4 = 0 THEN 'revenue' WHEN line % 4 = 1 THEN 'ocf' WHEN line % 4 = 2 THEN 'capex' ELSE 'ebit' END"
_FILED = f"""{TAGGED}, placed AS (SELECT *, CASE unit WHEN 'USD' THEN 1 WHEN 'EUR' THEN 2 END AS place FROM tagged), best AS (SELECT *, min(place) OVER (PARTITION BY ticker, tag) AS first FROM placed),
filed AS (SELECT ticker, {_FIELD} AS field, form, fp, "end", value * CASE WHEN line % 4 = 2 THEN -1 ELSE 1 END AS value, "end" + 45 AS filed, ticker || '-' || line AS accn, CAST(year("end") AS INTEGER) AS fy, line, start, is_duration FROM best WHERE first IS NULL OR place = first)"""


def _filed(spark, sf):
    """tagged with field, filed, accn, fy and rank."""
    line = F.col("line")
    field = F.when(line % 4 == 0, "revenue").when(line % 4 == 1, "ocf").when(line % 4 == 2, "capex").otherwise("ebit")
    return tagged(spark, sf).withColumns({"field": field, "value": F.when(line % 4 == 2, -F.col("value")).otherwise(F.col("value")), "filed": F.date_add("end", 45), "accn": F.concat_ws("-", F.col("ticker").cast("string"), line.cast("string")), "fy": F.year("end"), "rank": line})


@query(f"""WITH {_FILED}, k AS (SELECT * FROM filed WHERE form IN ('10-Q', '10-Q/A') AND fp IN ('Q1', 'Q2', 'Q3') AND (NOT is_duration OR coalesce("end" - start BETWEEN 45 AND 130, false))),
  w AS (SELECT ticker, fy, fp, "end", max(filed) AS filed, {', '.join(f"arg_max(value, -line) FILTER (WHERE field = '{f}') AS {f}" for f in ('revenue', 'ebit', 'ocf', 'capex'))} FROM k GROUP BY 1, 2, 3, 4)
  SELECT ticker, fy, fp, "end", filed, revenue, ebit, ocf, abs(capex) AS capex, {R('ocf - abs(capex)')} AS fcf FROM w""")
def quarterly_panel(spark, sf):
    """Figures of single quarters in one unit, with free cash flow."""
    return O.quarterly_panel(_filed(spark, sf), ["USD", "EUR"]).withColumn("fcf", settle(F.col("fcf")))


@query(f"""WITH {_FILED}, a AS (SELECT * FROM filed WHERE form IN ({', '.join(f"'{f}'" for f in O.ANNUAL_FORMS)}) AND (NOT is_duration OR coalesce("end" - start BETWEEN 300 AND 380, false))),
  anc AS (SELECT ticker, "end" AS anchor_end, accn AS anchor_accn FROM a WHERE field = 'revenue' QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY "end" DESC, filed DESC, line) = 1)
  SELECT ticker, field, value, "end", filed, accn FROM a LEFT JOIN anc USING (ticker)
  QUALIFY row_number() OVER (PARTITION BY ticker, field ORDER BY coalesce(accn = anchor_accn, false) DESC, coalesce("end" = anchor_end, false) DESC, coalesce(-abs("end" - anchor_end), -1e9) DESC, "end" DESC, filed DESC, line) = 1""")
def annual_selection(spark, sf):
    """The choice of facts after the rules on units, forms and lengths."""
    return O.selected_annual(_filed(spark, sf), ["USD", "EUR"])
