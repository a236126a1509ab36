"""Queries on universe tables and table checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosspanel.functions.coerce import settle
from crosspanel.operators import membership as O
from crosspanel.operators.universe import membership_on_dates
from crosspanel.plans.registry import PRICES, SECURITIES, R, query
from crosspanel.sources import proxy


@query("""SELECT upper(replace(trim(p_name), '.', '-')) AS ticker, arg_min(p_brand, p_partkey) AS sector, arg_min(p_type, p_partkey) AS sub_industry, lpad(CAST(min(p_partkey) AS VARCHAR), 10, '0') AS cik FROM part WHERE p_partkey % 9 <> 0 GROUP BY 1""")
def sector_map(spark, sf):
    p = proxy.table(spark, sf, "part")
    cells = F.map_from_arrays(F.array(F.lit("symbol"), F.lit("gicssector"), F.lit("gicssubindustry"), F.lit("cik")), F.array(F.col("p_name"), F.when(F.col("p_partkey") % 9 == 0, "").otherwise(F.col("p_brand")), F.col("p_type"), F.col("p_partkey").cast("string")))
    return O.sector_map(p.select(F.lit(0).alias("page_id"), F.col("p_partkey").alias("row_no"), cells.alias("cells")))


CHANGES = """chg AS (SELECT CAST(o_orderdate AS DATE) AS date, 'C' || o_custkey AS ticker, CASE WHEN o_orderkey % 2 = 0 THEN 'added' ELSE 'removed' END AS kind, o_orderkey AS seq FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0)"""


def _changes(spark, sf):
    k, name = F.col("o_orderkey"), F.concat(F.lit(" c"), F.col("o_custkey").cast("string"))
    empty = F.lit("")
    day = F.when(k % 5 == 0, "soon").when(k % 2 == 0, F.date_format("o_orderdate", "MMMM d, yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    cells = F.array(day, F.when(k % 2 == 0, name).otherwise(empty), empty, F.when(k % 2 == 0, empty).otherwise(name), empty, F.lit("reason"))
    rows = proxy.table(spark, sf, "orders").select(k.alias("row_no"), F.when(k % 7 == 0, F.slice(cells, 1, 3)).otherwise(cells).alias("cells"))
    return O.membership_changes(rows)


@query(f"WITH {CHANGES} SELECT date, ticker, kind, 'reason' AS reason, seq FROM chg")
def membership_changes(spark, sf):
    return _changes(spark, sf)


_MASTER = f"{SECURITIES}, master AS (SELECT s_suppkey AS ticker, CASE WHEN s_suppkey % 4 <> 0 THEN lpad(CAST(s_suppkey AS VARCHAR), 10, '0') END AS cik, CASE WHEN s_suppkey % 3 = 0 THEN sec.sector WHEN s_suppkey % 5 <> 0 THEN sec.sub_industry WHEN s_suppkey % 2 = 0 THEN 'Listed' END AS sector, CASE WHEN s_suppkey % 3 = 0 THEN 'features' WHEN s_suppkey % 5 <> 0 THEN 'sector_map' WHEN s_suppkey % 2 = 0 THEN 'section' ELSE 'missing' END AS sector_source FROM supplier JOIN sec ON sec.ticker = s_suppkey)"


def _master(spark, sf):
    s = proxy.securities(spark, sf)
    t = F.col("ticker")
    listed = s.select("ticker", F.when(t % 2 == 0, "Listed").alias("section"))
    ids = s.filter(t % 4 != 0).select("ticker", F.lpad(t.cast("string"), 10, "0").alias("cik"))
    return O.security_master(listed, ids, s.filter(t % 3 == 0).select("ticker", "sector"), s.filter(t % 5 != 0).select("ticker", F.col("sub_industry").alias("sector")))


@query(f"WITH {_MASTER} SELECT * FROM master")
def security_master(spark, sf):
    return _master(spark, sf).drop("section")


@query(f"WITH {_MASTER}, {CHANGES} SELECT count(*) AS tickers, {R('avg(CAST(cik IS NOT NULL AS INTEGER))')} AS cik_share, {R('avg(CAST(sector IS NOT NULL AS INTEGER))')} AS sector_share, count(*) FILTER (WHERE cik IS NULL) AS unmatched, (SELECT count(*) FROM chg) AS changes, (SELECT min(date) FROM chg) AS first_change, (SELECT max(date) FROM chg) AS last_change FROM master")
def universe_snapshot(spark, sf):
    u = O.universe_snapshot(_master(spark, sf), _changes(spark, sf))
    return u.withColumns({c: settle(F.col(c)) for c in ("cik_share", "sector_share")})


_MEMBERS = f"""{CHANGES}, span AS (SELECT min(date) AS a, max(date) AS b FROM chg), me AS (SELECT last_day(CAST(d AS DATE)) AS date FROM span, unnest(generate_series(CAST(date_trunc('month', a) AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 MONTH)) t(d) WHERE last_day(CAST(d AS DATE)) <= b),
cur AS (SELECT DISTINCT 'C' || c_custkey AS ticker FROM customer WHERE c_acctbal > 5000), nm AS (SELECT ticker FROM cur UNION SELECT ticker FROM chg),
one AS (SELECT * FROM chg QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY seq) = 1), pr AS (SELECT nm.ticker, me.date, one.kind FROM nm CROSS JOIN me ASOF LEFT JOIN one ON nm.ticker = one.ticker AND me.date < one.date),
mem AS (SELECT date, ticker FROM pr WHERE kind = 'removed' OR (kind IS NULL AND ticker IN (SELECT ticker FROM cur)))"""


def _members(spark, sf):
    changes = _changes(spark, sf)
    ends = O.month_ends(changes.agg(F.min("date").alias("first"), F.max("date").alias("last")))
    current = proxy.table(spark, sf, "customer").filter("c_acctbal > 5000").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("ticker"))
    return membership_on_dates(current, changes, ends)


@query(f"WITH {_MEMBERS} SELECT CAST(date AS DATE) AS date, ticker FROM mem")
def membership_panel(spark, sf):
    return _members(spark, sf)


_KNOWN = "kn AS (SELECT 'C' || c_custkey AS ticker FROM customer WHERE c_acctbal > 6000), ids AS (SELECT 'C' || c_custkey AS ticker FROM customer WHERE c_mktsegment <> 'BUILDING')"


def _customers(spark, sf, known):
    """All customers; those who are not known have no ticker."""
    return proxy.table(spark, sf, "customer").select(F.when(F.expr(known), F.concat(F.lit("C"), F.col("c_custkey").cast("string"))).alias("ticker"))


@query(f"""WITH {_MEMBERS}, {_KNOWN}, mo AS (SELECT date, avg(CAST(ticker NOT IN (SELECT ticker FROM kn) AS INTEGER)) AS share FROM mem GROUP BY 1), ms AS (SELECT DISTINCT ticker FROM mem WHERE ticker NOT IN (SELECT ticker FROM kn))
  SELECT count(*) AS missing, count(*) FILTER (WHERE ticker IN (SELECT ticker FROM ids)) AS with_id, count(*) FILTER (WHERE ticker NOT IN (SELECT ticker FROM ids)) AS without_id, (SELECT {R('avg(share)')} FROM mo) AS mean_share, (SELECT {R('max(share)')} FROM mo) AS max_share FROM ms""")
def membership_gap(spark, sf):
    g = O.membership_gap(_members(spark, sf), _customers(spark, sf, "c_acctbal > 6000"), _customers(spark, sf, "c_mktsegment <> 'BUILDING'"))
    return g.withColumns({c: settle(F.col(c)) for c in ("mean_share", "max_share")})


@query(f"WITH {_MEMBERS}, f AS (SELECT ticker, min(date) AS added_on FROM chg WHERE kind = 'added' GROUP BY 1) SELECT CAST(mem.date AS DATE) AS date, mem.ticker, f.added_on, coalesce(f.added_on <= mem.date, true) AS eligible FROM mem LEFT JOIN f USING (ticker)")
def add_date_filter(spark, sf):
    return O.add_date_filter(_members(spark, sf), _changes(spark, sf))


@query(f"""WITH {_MEMBERS}, {_KNOWN}, m AS (SELECT DISTINCT date_trunc('month', date) AS month, ticker FROM mem WHERE month(date) IN (3, 9))
  SELECT CAST(month AS DATE) AS month, count(*) AS members, count(*) FILTER (WHERE ticker NOT IN (SELECT ticker FROM kn)) AS missing, {R('avg(CAST(ticker NOT IN (SELECT ticker FROM kn) AS INTEGER))')} AS share FROM m GROUP BY 1""")
def gap_by_rebalance_month(spark, sf):
    members = _members(spark, sf)
    covered = members.join(_customers(spark, sf, "c_acctbal > 6000"), "ticker", "left_semi")
    g = O.gap_by_month(members, covered, members.filter("month(date) in (3, 9)").select("date"))
    return g.withColumn("share", settle(F.col("share")))


@query(f"WITH {SECURITIES} SELECT ticker, CASE WHEN ticker % 3 = 0 THEN sector ELSE sub_industry END AS sector FROM sec")
def add_context(spark, sf):
    s = proxy.securities(spark, sf)
    panel = s.select("ticker", F.when(F.col("ticker") % 3 == 0, F.col("sector")).alias("sector"))
    return O.add_context(panel, s.select("ticker", F.col("sub_industry").alias("sector")))


@query("""WITH a AS (SELECT DISTINCT 'customer' AS t, CAST(c_custkey AS VARCHAR) AS v FROM customer UNION SELECT 'orders', CAST(o_custkey AS VARCHAR) FROM orders UNION SELECT 'supplier', CAST(s_suppkey AS VARCHAR) FROM supplier)
  SELECT n.t AS "table", v.v AS value FROM (SELECT DISTINCT v FROM a) v CROSS JOIN (VALUES ('customer'), ('orders'), ('supplier')) n(t) LEFT JOIN a ON a.v = v.v AND a.t = n.t WHERE a.t IS NULL""")
def check_cross_table(spark, sf):
    keys = {"customer": "c_custkey", "orders": "o_custkey", "supplier": "s_suppkey"}
    return O.cross_table({t: proxy.table(spark, sf, t).select(F.col(k).alias("k")) for t, k in keys.items()}, "k")


@query(f"""WITH {PRICES}, sp AS (SELECT ticker, min(date) AS a, max(date) AS b FROM prices GROUP BY 1), w AS (SELECT s_suppkey AS ticker FROM supplier UNION SELECT -1), r AS (SELECT w.ticker, CASE WHEN a IS NULL THEN 'absent' WHEN a - DATE '1995-01-01' > 7 THEN 'late_start' WHEN DATE '2001-06-01' - b > 7 THEN 'early_end' END AS reason FROM w LEFT JOIN sp USING (ticker))
  SELECT * FROM r WHERE reason IS NOT NULL""")
def coverage_window(spark, sf):
    s = proxy.securities(spark, sf).select("ticker")
    day = lambda x: F.lit(x).cast("date")
    return O.coverage_window(proxy.prices(spark, sf), s.unionByName(s.agg(F.lit(-1).cast("long").alias("ticker"))), day("1995-01-01"), day("2001-06-01"))
