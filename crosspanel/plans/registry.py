"""Query registry: each query over the driver tables, with the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crosspanel.functions.coerce import settle
from crosspanel.operators import diagnostics, parts, portfolio, quality, scores, text, universe, valuation, xsec
from crosspanel.operators.asof import asof
from crosspanel.sources import proxy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def R(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5001234567) / 1e6"


PRICES = f"""prices AS (
  SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date, {R('avg(l_extendedprice / l_quantity)')} AS raw_close,
         {R('avg(l_extendedprice * (1 - l_discount) / l_quantity)')} AS adjusted_close
  FROM lineitem GROUP BY 1, 2),
cal AS (SELECT max(date) AS date FROM prices GROUP BY date_trunc('month', date)),
names AS (SELECT DISTINCT ticker FROM prices),
grid AS (SELECT ticker, date FROM names CROSS JOIN cal)"""

SECURITIES = """sec AS (
  SELECT s_suppkey AS ticker, r_name AS sector, n_name AS sub_industry, s_acctbal AS market_cap
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _at(months: int) -> str:
    return f"r{months} AS (SELECT g.ticker, g.date, p.adjusted_close AS p FROM (SELECT ticker, date, CAST(date - INTERVAL {months} MONTH AS DATE) AS at FROM grid) g ASOF JOIN prices p ON g.ticker = p.ticker AND g.at >= p.date)"


STEPS = f"""nxt AS (SELECT date, lead(date) OVER (ORDER BY date) AS next_date FROM cal),
ent AS (SELECT g.ticker, g.date, p.adjusted_close AS entry FROM grid g ASOF JOIN prices p ON g.ticker = p.ticker AND g.date < p.date),
steps AS (
  SELECT g.ticker, g.date, {R('x.entry2 / ent.entry - 1')} AS ret
  FROM grid g JOIN nxt USING (date) LEFT JOIN ent ON ent.ticker = g.ticker AND ent.date = g.date
  LEFT JOIN (SELECT ticker, date AS at, entry AS entry2 FROM ent) x ON x.ticker = g.ticker AND x.at = nxt.next_date)"""

PANEL = f"""{PRICES}, {SECURITIES}, {_at(0)}, {_at(3)}, {STEPS},
panel AS (
  SELECT r0.ticker, r0.date, sec.sector, sec.market_cap, {R('r0.p / r3.p - 1')} AS score, steps.ret
  FROM r0 JOIN r3 USING (ticker, date) JOIN steps USING (ticker, date) JOIN sec USING (ticker))"""


def ranked(source: str, keys: str, x: str = "score", y: str = "ret") -> str:
    """Correlation of doubled average ranks, by whole sums."""
    return f"""(SELECT {keys}, n, CAST(n * xy - sx * sy AS DOUBLE) / nullif(sqrt(CAST(n * xx - sx * sx AS DOUBLE) * CAST(n * yy - sy * sy AS DOUBLE)), 0) AS rank_ic
      FROM (SELECT {keys}, count(*) AS n, sum(rx) AS sx, sum(ry) AS sy, sum(rx * ry) AS xy, sum(rx * rx) AS xx, sum(ry * ry) AS yy
      FROM (SELECT {keys}, 2 * rank() OVER (PARTITION BY {keys} ORDER BY {x}) + count(*) OVER (PARTITION BY {keys}, {x}) - 1 AS rx,
                   2 * rank() OVER (PARTITION BY {keys} ORDER BY {y}) + count(*) OVER (PARTITION BY {keys}, {y}) - 1 AS ry
            FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL) GROUP BY {keys}))"""


# --- prices, as-of, returns


@query(f"WITH {PRICES} SELECT * FROM prices")
def prices_daily(spark, sf):
    return proxy.prices(spark, sf)


@query(f"WITH {PRICES} SELECT CAST(date AS DATE) AS date FROM cal")
def rebalance_calendar(spark, sf):
    return proxy.rebalance_dates(proxy.prices(spark, sf)).select("date")


@query(f"WITH {PRICES} SELECT g.ticker, g.date, p.raw_close FROM grid g ASOF LEFT JOIN prices p ON g.ticker = p.ticker AND g.date >= p.date")
def asof_price_le(spark, sf):
    p = proxy.prices(spark, sf)
    return asof(proxy.grid(p), p.select("ticker", F.col("date").alias("_at"), "raw_close"), ["ticker"], "date", "_at", ["raw_close"])


@query(f"WITH {PRICES} SELECT g.ticker, g.date, p.raw_close FROM grid g ASOF LEFT JOIN prices p ON g.ticker = p.ticker AND g.date < p.date")
def first_price_gt(spark, sf):
    p = proxy.prices(spark, sf)
    return asof(proxy.grid(p), p.select("ticker", F.col("date").alias("_at"), "raw_close"), ["ticker"], "date", "_at", ["raw_close"], strict=True, forward=True)


@query("""WITH p AS (SELECT event_id, ts FROM events WHERE event_type = 'purchase'), e AS (SELECT event_id AS error_id, user_id AS error_user, ts AS at FROM events WHERE event_type = 'error' QUALIFY row_number() OVER (PARTITION BY ts ORDER BY event_id DESC) = 1)
  SELECT p.event_id, e.error_id, e.error_user FROM p ASOF LEFT JOIN e ON p.ts > e.at""")
def asof_whole_table(spark, sf):
    """The last error before each purchase, of anyone: one key has all rows."""
    e = proxy.table(spark, sf, "events")
    errors = e.filter("event_type = 'error'").select(F.col("event_id").alias("error_id"), F.col("user_id").alias("error_user"), F.col("ts").alias("at"))
    return parts.asof(e.filter("event_type = 'purchase'").select("event_id", "ts"), errors, [], "ts", "at", ["error_id", "error_user"], strict=True, order=["error_id"]).drop("ts")


_RETURNS = ", ".join(f"{R(f'r0.p / r{k}.p - 1')} AS return_{k}m" for k in (1, 3, 6, 12))


@query(f"""WITH {PRICES}, {', '.join(_at(k) for k in (0, 1, 3, 6, 12))},
  t AS (SELECT r0.ticker, r0.date, r0.p AS adjusted_price, {_RETURNS} FROM r0 {' '.join(f'LEFT JOIN r{k} ON r{k}.ticker = r0.ticker AND r{k}.date = r0.date' for k in (1, 3, 6, 12))})
  SELECT *, {R('(1 + return_12m) / nullif(1 + return_1m, 0) - 1')} AS momentum_12_1 FROM t""")
def price_returns(spark, sf):
    return proxy.price_returns(proxy.prices(spark, sf))


@query(f"WITH {PRICES}, {STEPS} SELECT ticker, date, ret FROM steps")
def step_returns(spark, sf):
    return proxy.step_returns(proxy.prices(spark, sf))


@query(f"""WITH {PRICES}, h AS (SELECT ticker, date, k AS horizon, CAST(date + to_months(k) AS DATE) AS at FROM grid CROSS JOIN (VALUES (1), (3), (6), (12)) v(k)),
  a AS (SELECT h.ticker, h.date, h.horizon, h.at, p.date AS entry_date, p.adjusted_close AS entry FROM h ASOF LEFT JOIN prices p ON h.ticker = p.ticker AND h.date < p.date),
  b AS (SELECT a.ticker, a.date, a.horizon, a.entry_date, a.entry, p.date AS exit_date, p.adjusted_close AS exit FROM a ASOF LEFT JOIN prices p ON a.ticker = p.ticker AND a.at < p.date)
  SELECT ticker, date, CAST(horizon AS INTEGER) AS horizon, entry_date, exit_date, entry AS entry_price, exit AS exit_price, {R('exit / nullif(entry, 0) - 1')} AS ret FROM b""")
def forward_returns(spark, sf):
    p = proxy.prices(spark, sf)
    events = p.select("ticker", F.col("date").alias("_at"), F.struct("date", "adjusted_close").alias("e"))
    probes = proxy.grid(p).withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in (1, 3, 6, 12)]))).withColumn("at", F.add_months("date", F.col("horizon")))
    entry = asof(probes, events, ["ticker"], "date", "_at", ["e"], strict=True, forward=True).withColumnRenamed("e", "entry")
    out = asof(entry, events, ["ticker"], "at", "_at", ["e"], strict=True, forward=True)
    return out.select("ticker", "date", "horizon", F.col("entry.date").alias("entry_date"), F.col("e.date").alias("exit_date"), F.col("entry.adjusted_close").alias("entry_price"), F.col("e.adjusted_close").alias("exit_price"), settle(F.try_divide("e.adjusted_close", "entry.adjusted_close") - 1).alias("ret"))


@query(f"WITH {PRICES} SELECT count(DISTINCT ticker) AS tickers, CAST(min(date) - INTERVAL 10 DAY AS DATE) AS first_date, CAST(max(date) + INTERVAL 12 MONTH + INTERVAL 10 DAY AS DATE) AS last_date FROM grid")
def price_window(spark, sf):
    g = proxy.grid(proxy.prices(spark, sf))
    return g.agg(F.countDistinct("ticker").alias("tickers"), F.date_sub(F.min("date"), 10).alias("first_date"), F.date_add(F.add_months(F.max("date"), 12), 10).alias("last_date"))


# --- facts and filings

FACTS = f"""sums AS (
  SELECT l_suppkey AS ticker, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS start, ascii(l_returnflag) - 65 AS rank,
         {R('sum(l_extendedprice)')} AS revenue, {R('sum(l_extendedprice * l_tax)')} AS tax FROM lineitem GROUP BY 1, 2, 3),
facts AS (
  SELECT ticker, start, rank, field, value, CAST(start + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS "end", CAST(start + INTERVAL 3 MONTH + INTERVAL 44 DAY AS DATE) AS filed
  FROM (SELECT ticker, start, rank, 'revenue' AS field, revenue AS value FROM sums UNION ALL SELECT ticker, start, rank, 'tax', tax FROM sums))"""


@query(f"WITH {FACTS} SELECT ticker, field, value, \"end\", CAST(rank AS INTEGER) AS rank FROM facts QUALIFY row_number() OVER (PARTITION BY ticker, field ORDER BY \"end\" DESC, filed DESC, rank) = 1")
def facts_latest(spark, sf):
    f = proxy.facts(spark, sf)
    best = F.max_by(F.struct("value", "end", "rank"), F.struct("end", "filed", -F.col("rank")))
    return f.groupBy("ticker", "field").agg(best.alias("b")).select("ticker", "field", "b.value", "b.end", F.col("b.rank").cast("int").alias("rank"))


@query(f"""WITH {FACTS}, one AS (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY ticker, field, start, "end" ORDER BY filed DESC, rank) = 1)
  SELECT ticker, field, value, "end", row_number() OVER (PARTITION BY ticker, field ORDER BY "end" DESC) AS nth FROM one QUALIFY nth <= 2""")
def facts_latest_two(spark, sf):
    f = proxy.facts(spark, sf)
    best = F.max_by("value", F.struct("filed", -F.col("rank")))
    one = f.groupBy("ticker", "field", "start", "end").agg(best.alias("value"))
    nth = F.row_number().over(Window.partitionBy("ticker", "field").orderBy(F.col("end").desc())).cast("long")
    return one.withColumn("nth", nth).filter("nth <= 2").select("ticker", "field", "value", "end", "nth")


_BY_PERIOD = f"""{FACTS}, period AS (
  SELECT ticker, "end", filed, max(value) FILTER (WHERE field = 'revenue') AS revenue, max(value) FILTER (WHERE field = 'tax') AS tax
  FROM (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY ticker, field, "end" ORDER BY filed DESC, rank) = 1) GROUP BY ALL)"""


def _by_period(spark, sf):
    f = proxy.facts(spark, sf)
    best = f.groupBy("ticker", "field", "end").agg(F.max_by("value", F.struct("filed", -F.col("rank"))).alias("value"), F.max("filed").alias("filed"))
    return best.groupBy("ticker", "end", "filed").pivot("field", ["revenue", "tax"]).agg(F.first("value"))


@query(f"WITH {_BY_PERIOD} SELECT * FROM period")
def facts_by_period(spark, sf):
    return _by_period(spark, sf)


@query(f"""WITH {_BY_PERIOD}, w AS (SELECT *, count(revenue) OVER four AS n4, sum(revenue) OVER four AS s4, lag(revenue, 1) OVER o AS l1, lag(revenue, 4) OVER o AS l4
    FROM period WINDOW o AS (PARTITION BY ticker ORDER BY "end", filed), four AS (PARTITION BY ticker ORDER BY "end", filed ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
  SELECT ticker, "end", revenue, CASE WHEN n4 = 4 THEN {R('s4')} END AS ttm, {R('revenue / nullif(l1, 0) - 1')} AS qoq, {R('revenue / nullif(l4, 0) - 1')} AS yoy FROM w""")
def quarterly_rollups(spark, sf):
    o = Window.partitionBy("ticker").orderBy("end", "filed")
    four = o.rowsBetween(-3, 0)
    change = lambda k: settle(F.try_divide("revenue", F.lag("revenue", k).over(o)) - 1)
    return _by_period(spark, sf).select("ticker", "end", "revenue", F.when(F.count("revenue").over(four) == 4, settle(F.sum("revenue").over(four))).alias("ttm"), change(1).alias("qoq"), change(4).alias("yoy"))


@query(f"""WITH {_BY_PERIOD} SELECT ticker, {R('sum(revenue)')} AS ttm_last4 FROM
  (SELECT * FROM period WHERE revenue IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY "end" DESC) <= 4) GROUP BY ticker HAVING count(*) = 4""")
def ttm_last4(spark, sf):
    nth = F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("end").desc()))
    last = _by_period(spark, sf).filter("revenue is not null").withColumn("nth", nth).filter("nth <= 4")
    return last.groupBy("ticker").agg(F.count("*").alias("n"), settle(F.sum("revenue")).alias("ttm_last4")).filter("n = 4").select("ticker", "ttm_last4")


FILINGS = "filings AS (SELECT o_custkey AS ticker, CAST(o_orderdate AS DATE) AS filed, o_orderpriority AS form, o_orderkey AS accession, o_totalprice AS value, o_orderstatus AS tier FROM orders)"


@query(f"""WITH {FILINGS}, probes AS (SELECT DISTINCT f.ticker, CAST(d AS DATE) AS date FROM filings f CROSS JOIN (VALUES (DATE '1996-07-01'), (DATE '1998-01-01'), (DATE '2000-01-01')) v(d)),
  last AS (SELECT * FROM filings QUALIFY row_number() OVER (PARTITION BY ticker, filed ORDER BY accession DESC) = 1)
  SELECT p.ticker, p.date, l.accession FROM probes p ASOF LEFT JOIN last l ON p.ticker = l.ticker AND p.date > l.filed""")
def filing_asof(spark, sf):
    f = proxy.filings(spark, sf)
    dates = spark.createDataFrame([("1996-07-01",), ("1998-01-01",), ("2000-01-01",)], "d string").select(F.to_date("d").alias("date"))
    return asof(f.select("ticker").distinct().crossJoin(F.broadcast(dates)), f.select("ticker", F.col("filed").alias("_at"), "accession"), ["ticker"], "date", "_at", ["accession"], strict=True, order=["accession"])


@query(f"WITH {FILINGS} SELECT ticker, form, accession, row_number() OVER (PARTITION BY ticker, form ORDER BY filed DESC, accession DESC) AS lookback_rank FROM filings QUALIFY lookback_rank <= 2")
def filing_latest_k(spark, sf):
    nth = F.row_number().over(Window.partitionBy("ticker", "form").orderBy(F.col("filed").desc(), F.col("accession").desc())).cast("long")
    return proxy.filings(spark, sf).withColumn("lookback_rank", nth).filter("lookback_rank <= 2").select("ticker", "form", "accession", "lookback_rank")


# --- cross-sections


@query(f"""WITH {PANEL}, q AS (SELECT *, quantile_cont(score, 0.01) OVER w AS lo, quantile_cont(score, 0.99) OVER w AS hi FROM panel WINDOW w AS (PARTITION BY date)),
  c AS (SELECT ticker, date, least(greatest(score, lo), hi) AS x FROM q)
  SELECT ticker, date, {R('x')} AS winsorized, {R('CASE WHEN stddev_pop(x) OVER w > 1e-12 THEN (x - avg(x) OVER w) / stddev_pop(x) OVER w ELSE 0 END')} AS z FROM c WINDOW w AS (PARTITION BY date)""")
def winsor_z(spark, sf):
    w = proxy.panel(spark, sf).withColumn("x", xsec.winsorize("score", ["date"]))
    return w.select("ticker", "date", settle(F.col("x")).alias("winsorized"), settle(xsec.zscore(F.col("x"), ["date"])).alias("z"))


@query(f"WITH {PANEL} SELECT ticker, date, sector, {R('CASE WHEN stddev_pop(score) OVER w > 1e-12 THEN (score - avg(score) OVER w) / stddev_pop(score) OVER w ELSE 0 END')} AS z FROM panel WINDOW w AS (PARTITION BY date, sector)")
def z_within_sector(spark, sf):
    return proxy.panel(spark, sf).select("ticker", "date", "sector", settle(xsec.zscore(F.col("score"), ["date", "sector"])).alias("z"))


@query(f"""WITH {PANEL}, r AS (SELECT ticker, date, (rank() OVER (PARTITION BY date ORDER BY score) + (count(*) OVER (PARTITION BY date, score) - 1) / 2.0 - 1) / nullif(count(*) OVER (PARTITION BY date) - 1, 0) AS p FROM panel)
  SELECT ticker, date, {R('coalesce(p, 0.5)')} AS pct, CAST(least(9, greatest(0, floor(coalesce(p, 0.5) * 10))) AS INTEGER) AS decile FROM r""")
def pct_rank_deciles(spark, sf):
    p = proxy.panel(spark, sf).withColumn("p", xsec.pct_rank_01(F.col("score"), ["date"]))
    return p.select("ticker", "date", settle(F.col("p")).alias("pct"), xsec.decile(F.col("p")).alias("decile"))


@query(f"""WITH {SECURITIES}, q AS (SELECT *, quantile_cont(market_cap, 1/3) FILTER (WHERE market_cap > 0) OVER w AS a, quantile_cont(market_cap, 2/3) FILTER (WHERE market_cap > 0) OVER w AS b,
    count(*) FILTER (WHERE market_cap > 0) OVER w AS n FROM sec WINDOW w AS (PARTITION BY sector))
  SELECT ticker, sector, CASE WHEN market_cap > 0 THEN CASE WHEN n < 3 THEN 'known' WHEN market_cap <= a THEN 'small' WHEN market_cap <= b THEN 'mid' ELSE 'large' END ELSE 'unknown' END AS size_bucket,
    CASE WHEN market_cap > 0 THEN {R('ln(CASE WHEN market_cap > 0 THEN market_cap ELSE 1 END)')} END AS log_market_cap FROM q""")
def size_buckets(spark, sf):
    s = proxy.securities(spark, sf)
    return scores.size_buckets(s, "market_cap", ["sector"]).select("ticker", "sector", "size_bucket", F.when(F.col("market_cap") > 0, settle(F.ln("market_cap"))).alias("log_market_cap"))


@query(f"WITH {PANEL} SELECT date, count(score) AS n, {R('avg(score)')} AS mean, {R('stddev_pop(score)')} AS std, {R('quantile_cont(score, 0.05)')} AS p05, {R('quantile_cont(score, 0.95)')} AS p95 FROM panel GROUP BY date")
def summary_stats(spark, sf):
    q = lambda p: settle(F.percentile("score", F.lit(p)))
    return proxy.panel(spark, sf).groupBy("date").agg(F.count("score").alias("n"), settle(F.avg("score")).alias("mean"), settle(F.stddev_pop("score")).alias("std"), q(0.05).alias("p05"), q(0.95).alias("p95"))


# --- diagnostics

_SPLIT = f"{PANEL}, split AS (SELECT *, avg(score) OVER (PARTITION BY date, sector) AS sector_score, score - avg(score) OVER (PARTITION BY date, sector) AS within_score FROM panel), across AS (SELECT date, sector, avg(score) AS score, avg(ret) AS ret FROM split WHERE ret IS NOT NULL GROUP BY 1, 2)"
_IC = f"{_SPLIT}, ic AS (SELECT date, n, rank_ic, 'global' AS decomposition FROM {ranked('split', 'date')} UNION ALL SELECT date, n, rank_ic, 'across_sector' FROM {ranked('across', 'date')})"


@query(f"WITH {_SPLIT} SELECT ticker, date, {R('sector_score')} AS sector_score, {R('within_score')} AS within_score FROM split")
def decompose(spark, sf):
    return diagnostics.decompose(proxy.panel(spark, sf), ["date"]).select("ticker", "date", settle(F.col("sector_score")).alias("sector_score"), settle(F.col("within_score")).alias("within_score"))


def _ic(spark, sf):
    return diagnostics.rank_ic(proxy.panel(spark, sf), ["date"]).drop("horizon")


@query(f"WITH {_IC} SELECT date, n, decomposition, {R('rank_ic')} AS rank_ic FROM ic")
def rank_ic(spark, sf):
    return _ic(spark, sf).filter("decomposition <> 'within_sector'").select("date", "n", "decomposition", settle(F.col("rank_ic")).alias("rank_ic"))


@query(f"WITH {_SPLIT} SELECT date, n, {R('rank_ic')} AS rank_ic FROM {ranked('split', 'date', 'within_score')}")
def rank_ic_within_sector(spark, sf):
    return _ic(spark, sf).filter("decomposition = 'within_sector'").select("date", "n", settle(F.col("rank_ic")).alias("rank_ic"))


@query(f"WITH {PANEL} SELECT date, sector, n, {R('rank_ic')} AS rank_ic FROM {ranked('panel', 'date, sector')}")
def ic_by_sector(spark, sf):
    return diagnostics.spearman(proxy.panel(spark, sf), ["date", "sector"], "score", "ret").select("date", "sector", "n", settle(F.col("rank_ic")).alias("rank_ic"))


@query(f"WITH {PANEL} SELECT date, count(*) AS universe_n, count(score) AS score_non_null, count(ret) AS return_non_null, count(*) FILTER (WHERE score IS NOT NULL AND ret IS NOT NULL) AS paired_n, count(DISTINCT sector) AS sector_count FROM panel GROUP BY date")
def ic_coverage(spark, sf):
    paired = F.count(F.when(F.col("score").isNotNull() & F.col("ret").isNotNull(), 1))
    return proxy.panel(spark, sf).groupBy("date").agg(F.count("*").alias("universe_n"), F.count("score").alias("score_non_null"), F.count("ret").alias("return_non_null"), paired.alias("paired_n"), F.countDistinct("sector").alias("sector_count"))


@query(f"WITH {_IC} SELECT decomposition, count(*) AS months, {R('avg(rank_ic)')} AS mean_ic, {R('quantile_cont(rank_ic, 0.5)')} AS median_ic, {R('stddev_pop(rank_ic)')} AS std_ic, {R('avg(CASE WHEN rank_ic > 0 THEN 1.0 ELSE 0.0 END)')} AS positive_share FROM ic WHERE rank_ic IS NOT NULL GROUP BY 1")
def ic_summary(spark, sf):
    s = diagnostics.ic_summary(_ic(spark, sf).filter("decomposition <> 'within_sector'"), ["decomposition"])
    return s.select("decomposition", "months", *[settle(F.col(c)).alias(c) for c in ("mean_ic", "median_ic", "std_ic", "positive_share")])


_LAGS = " ".join(f"+ CASE WHEN {k} <= lag THEN 2 * (1 - {k} / (lag + 1.0)) * coalesce((SELECT sum(a.dev * b.dev) FROM dev a JOIN dev b ON b.i = a.i + {k}), 0) / n ELSE 0 END" for k in range(1, 9))


@query(f"""WITH {_IC}, s AS (SELECT rank_ic, row_number() OVER (ORDER BY date) AS i FROM ic WHERE decomposition = 'global' AND rank_ic IS NOT NULL),
  m AS (SELECT count(*) AS n, avg(rank_ic) AS mean, floor(4 * pow(count(*) / 100.0, 2.0 / 9)) AS lag FROM s),
  dev AS (SELECT i, rank_ic - (SELECT mean FROM m) AS dev FROM s),
  v AS (SELECT n, mean, (SELECT sum(dev * dev) FROM dev) / n {_LAGS} AS var FROM m)
  SELECT n AS months, {R('mean / sqrt(var / n)')} AS newey_west_t FROM v WHERE n >= 2 AND var > 0""")
def newey_west(spark, sf):
    s = diagnostics.ic_summary(_ic(spark, sf).filter("decomposition = 'global'"), ["decomposition"])
    return s.filter("newey_west_t is not null").select("months", settle(F.col("newey_west_t")).alias("newey_west_t"))


@query(f"WITH {_IC} SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS months, {R('avg(rank_ic)')} AS mean_ic, {R('avg(CASE WHEN rank_ic > 0 THEN 1.0 ELSE 0.0 END)')} AS positive_share FROM ic WHERE decomposition = 'global' AND rank_ic IS NOT NULL GROUP BY 1")
def ic_by_year(spark, sf):
    ic = _ic(spark, sf).filter("decomposition = 'global' and rank_ic is not null")
    return ic.groupBy(F.year("date").alias("year")).agg(F.count("*").alias("months"), settle(F.avg("rank_ic")).alias("mean_ic"), settle(F.avg((F.col("rank_ic") > 0).cast("double"))).alias("positive_share"))


# --- portfolios

_RANKED = "row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) - 1 AS i, count(*) OVER (PARTITION BY date) AS n"
_BUCKETS = f"{PANEL}, held AS (SELECT *, 'Q' || CAST(CASE WHEN n < 50 THEN 2 * (i * 3 // n) + 1 ELSE (i * 5 // n) + 1 END AS VARCHAR) AS bucket FROM (SELECT *, {_RANKED} FROM panel) WHERE n >= 3), w AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY date, bucket) AS weight FROM held)"


def _held(spark, sf):
    return portfolio.equal_weights(proxy.panel(spark, sf), ["date"])


@query(f"WITH {_BUCKETS} SELECT ticker, date, bucket, {R('weight')} AS weight FROM w")
def buckets(spark, sf):
    return _held(spark, sf).select("ticker", "date", "bucket", settle(F.col("weight")).alias("weight"))


@query(f"""WITH {PANEL}, k AS (SELECT *, row_number() OVER (PARTITION BY date, sector ORDER BY score DESC, ticker) - 1 AS i, count(*) OVER (PARTITION BY date, sector) AS n FROM panel),
  b AS (SELECT *, 'Q' || CAST(CASE WHEN n < 50 THEN 2 * (i * 3 // n) + 1 ELSE (i * 5 // n) + 1 END AS VARCHAR) AS bucket FROM k WHERE n >= 3),
  ns AS (SELECT date, count(DISTINCT sector) AS s FROM b GROUP BY 1), bs AS (SELECT date, bucket, count(DISTINCT sector) AS s FROM b GROUP BY 1, 2)
  SELECT b.ticker, b.date, b.bucket, {R('1.0 / bs.s / count(*) OVER (PARTITION BY b.date, b.bucket, b.sector)')} AS weight FROM b JOIN ns USING (date) JOIN bs ON bs.date = b.date AND bs.bucket = b.bucket WHERE ns.s >= 2""")
def weights_neutral(spark, sf):
    return portfolio.sector_neutral_weights(proxy.panel(spark, sf), ["date"]).select("ticker", "date", "bucket", settle(F.col("weight")).alias("weight"))


_BUCKET_RETURNS = f"{_BUCKETS}, br AS (SELECT date, bucket, sum(weight * ret) / sum(weight) AS ret, count(*) AS names FROM w WHERE ret IS NOT NULL GROUP BY 1, 2)"


def _bucket_returns(spark, sf):
    held = _held(spark, sf).filter("ret is not null")
    return held.groupBy("date", "bucket").agg((F.sum(F.col("weight") * F.col("ret")) / F.sum("weight")).alias("ret"), F.count("*").alias("names"))


_Q = [f"Q{i}" for i in range(1, 6)]


@query(f"""WITH {_BUCKET_RETURNS}, p AS (SELECT date, {', '.join(f"max(ret) FILTER (WHERE bucket = '{q}') AS {q.lower()}" for q in _Q)}, sum(names) AS names FROM br GROUP BY date),
  u AS (SELECT date, avg(ret) AS universe FROM w GROUP BY 1)
  SELECT date, {', '.join(f'{R(q.lower())} AS {q.lower()}' for q in _Q)}, {R('q1 - q5')} AS spread, {R('universe')} AS universe, CAST(names AS BIGINT) AS names FROM p JOIN u USING (date)""")
def bucket_returns(spark, sf):
    """Each bucket's return, the first less the last, and the mean of all names held."""
    held = _held(spark, sf)
    wide = _bucket_returns(spark, sf).groupBy("date").pivot("bucket", _Q).agg(F.first("ret"))
    every = held.filter("ret is not null").groupBy("date").agg(F.avg("ret").alias("universe"), F.count("*").alias("names"))
    return wide.join(every, "date").select("date", *[settle(F.col(q)).alias(q.lower()) for q in _Q], settle(F.col("Q1") - F.col("Q5")).alias("spread"), settle(F.col("universe")).alias("universe"), "names")


_TURNOVER = f"""{_BUCKETS}, ks AS (SELECT bucket, date, ticker, weight, dense_rank() OVER (PARTITION BY bucket ORDER BY date) AS k FROM w),
  ds AS (SELECT DISTINCT bucket, k, date FROM ks),
  j AS (SELECT coalesce(a.bucket, b.bucket) AS bucket, coalesce(a.k, b.k + 1) AS k, abs(coalesce(a.weight, 0) - coalesce(b.weight, 0)) AS d FROM ks a FULL JOIN ks b ON a.bucket = b.bucket AND a.ticker = b.ticker AND a.k = b.k + 1),
  tv AS (SELECT j.bucket, ds.date, CASE WHEN j.k = 1 THEN sum(d) ELSE sum(d) / 2 END AS turnover FROM j JOIN ds ON ds.bucket = j.bucket AND ds.k = j.k GROUP BY j.bucket, ds.date, j.k)"""


@query(f"WITH {_TURNOVER} SELECT bucket, date, {R('turnover')} AS turnover FROM tv")
def turnover(spark, sf):
    return portfolio.turnover(_held(spark, sf), ["bucket"]).select("bucket", "date", settle(F.col("turnover")).alias("turnover"))


@query(f"""WITH {_TURNOVER}, br AS (SELECT date, bucket, sum(weight * ret) AS gross, count(*) AS name_count FROM w WHERE ret IS NOT NULL GROUP BY 1, 2)
  SELECT br.bucket, br.date, name_count, CAST(c AS DOUBLE) AS cost_bps, {R('gross')} AS gross_return, {R('gross - turnover * c / 1e4')} AS net_return FROM br JOIN tv ON tv.bucket = br.bucket AND tv.date = br.date CROSS JOIN (VALUES (0), (10), (25), (50)) v(c)""")
def monthly_returns_net(spark, sf):
    held = _held(spark, sf)
    gross = held.filter("ret is not null").groupBy("bucket", "date").agg(F.sum(F.col("weight") * F.col("ret")).alias("gross_return"), F.count("*").alias("name_count"))
    net = portfolio.apply_costs(gross.join(portfolio.turnover(held, ["bucket"]), ["bucket", "date"]), [0, 10, 25, 50])
    return net.select("bucket", "date", "name_count", "cost_bps", settle(F.col("gross_return")).alias("gross_return"), settle(F.col("net_return")).alias("net_return"))


@query(f"WITH {_BUCKETS} SELECT date, bucket, sector, {R('sum(weight)')} AS sector_weight, count(*) AS names, {R('sum(weight * market_cap)')} AS weighted_market_cap FROM w GROUP BY 1, 2, 3")
def exposures(spark, sf):
    return _held(spark, sf).groupBy("date", "bucket", "sector").agg(settle(F.sum("weight")).alias("sector_weight"), F.count("*").alias("names"), settle(F.sum(F.col("weight") * F.col("market_cap"))).alias("weighted_market_cap"))


@query(f"""WITH {_BUCKET_RETURNS}, wl AS (SELECT *, product(1 + ret) OVER (PARTITION BY bucket ORDER BY date ROWS UNBOUNDED PRECEDING) AS wealth FROM br),
  dd AS (SELECT *, wealth / max(wealth) OVER (PARTITION BY bucket ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM wl)
  SELECT bucket, count(*) AS months, {R('ln(arg_max(wealth, date))')} AS log_wealth, {R('stddev_pop(ret) * sqrt(12)')} AS volatility, {R('avg(ret) / stddev_pop(ret) * sqrt(12)')} AS sharpe, {R('min(drawdown)')} AS max_drawdown FROM dd GROUP BY bucket""")
def performance(spark, sf):
    p = portfolio.performance(_bucket_returns(spark, sf), ["bucket"])
    p = p.withColumn("log_wealth", F.ln(1 + F.col("cumulative")))
    return p.select("bucket", "months", *[settle(F.col(c)).alias(c) for c in ("log_wealth", "volatility", "sharpe", "max_drawdown")])


@query(f"WITH {_BUCKET_RETURNS} SELECT bucket, CAST(year(date) AS INTEGER) AS year, {R('product(1 + ret) - 1')} AS annual_return FROM br GROUP BY 1, 2")
def annual_returns(spark, sf):
    return _bucket_returns(spark, sf).groupBy("bucket", F.year("date").alias("year")).agg(settle(F.product(1 + F.col("ret")) - 1).alias("annual_return"))


# --- valuation and labels


_GRID = ", ".join(map(repr, valuation.RATE_GRID))
_PV = "list_sum(list_transform(flows, lambda f, i: f / pow(1 + {r}, i)))"


@query(f"""WITH RECURSIVE o AS (SELECT l_orderkey AS order_id, list(l_extendedprice ORDER BY l_linenumber, l_partkey, l_extendedprice) AS flows, sum(l_extendedprice) * 9e-1 AS target FROM lineitem GROUP BY 1),
  g AS (SELECT order_id, flows, target, i, r, {_PV.format(r='r')} - target AS v FROM o CROSS JOIN (SELECT unnest([{_GRID}]) AS r, unnest(range(17)) AS i)),
  e AS (SELECT order_id, flows, target, i, r AS lo, lead(r) OVER w AS hi, v AS vlo, lead(v) OVER w AS vhi FROM g WINDOW w AS (PARTITION BY order_id ORDER BY i)),
  s AS (SELECT order_id, flows, target, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi, vlo, 0 AS step FROM e WHERE vlo * vhi <= 0 AND target > 0 QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY i) = 1
    UNION ALL SELECT order_id, flows, target, CASE WHEN vlo * vm <= 0 THEN lo ELSE mid END, CASE WHEN vlo * vm <= 0 THEN mid ELSE hi END, vlo, step + 1
      FROM (SELECT *, {_PV.format(r='mid')} - target AS vm FROM (SELECT *, (lo + hi) / 2 AS mid FROM s WHERE step < 44)))
  SELECT order_id, {R('(lo + hi) / 2')} AS rate FROM o LEFT JOIN (SELECT order_id, lo, hi FROM s WHERE step = 44) USING (order_id)""")
def implied_rate(spark, sf):
    """Rate at which an order's lines, one a year, are worth nine tenths of their sum."""
    l = proxy.table(spark, sf, "lineitem")  # noqa: E741
    flows = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_extendedprice"))), lambda r: r["l_extendedprice"])
    orders = l.groupBy(F.col("l_orderkey").alias("order_id")).agg(flows.alias("flows"), (F.sum("l_extendedprice") * 0.9).alias("target"))
    rate = valuation.implied_rate(F.col("flows"), F.col("target"))
    return orders.select("order_id", "target", rate.alias("rate")).select("order_id", settle(F.col("rate")).alias("rate"))


_LABELS = f"{FILINGS}, labels_long AS (SELECT ticker, form AS model, tier, value / 1e5 - 1 AS label FROM filings)"


def _labels(spark, sf):
    return proxy.filings(spark, sf).select("ticker", F.col("form").alias("model"), "tier", (F.col("value") / 1e5 - 1).alias("label"))


@query(f"""WITH {_LABELS} SELECT ticker, count(*) AS n, {R('avg(label)')} AS mean, {R('quantile_cont(label, 0.5)')} AS median, {R('stddev_samp(label)')} AS std, {R('quantile_cont(label, 0.75) - quantile_cont(label, 0.25)')} AS iqr, {R('max(label) - min(label)')} AS spread FROM labels_long GROUP BY ticker""")
def label_uncertainty(spark, sf):
    q = lambda p: F.percentile("label", F.lit(p))
    return _labels(spark, sf).groupBy("ticker").agg(F.count("*").alias("n"), settle(F.avg("label")).alias("mean"), settle(q(0.5)).alias("median"), settle(F.stddev_samp("label")).alias("std"), settle(q(0.75) - q(0.25)).alias("iqr"), settle(F.max("label") - F.min("label")).alias("spread"))


@query(f"WITH {_LABELS}, m AS (SELECT ticker, model, avg(label) AS x FROM labels_long GROUP BY 1, 2) SELECT ticker, CASE WHEN count(*) > 1 THEN {R('max(x) - min(x)')} END AS disagreement FROM m GROUP BY ticker")
def disagreement(spark, sf):
    means = _labels(spark, sf).groupBy("ticker", "model").agg(F.avg("label").alias("x"))
    return means.groupBy("ticker").agg(F.when(F.count("*") > 1, settle(F.max("x") - F.min("x"))).alias("disagreement"))


@query(f"""WITH {_LABELS}, f AS (SELECT tier, CASE WHEN label <= -0.9 THEN 0.0 ELSE 1.0 / (1 + CAST(label > 2 AS INTEGER) + CAST(model = '5-LOW' AS INTEGER)) END AS weight FROM labels_long)
  SELECT tier, count(*) AS n, {R('avg(CASE WHEN weight = 0 THEN 1.0 ELSE 0.0 END)')} AS excluded_share, {R('avg(CASE WHEN weight > 0 AND weight < 1 THEN 1.0 ELSE 0.0 END)')} AS downweighted_share, {R('avg(weight)')} AS mean_weight FROM f GROUP BY tier""")
def failure_rates(spark, sf):
    flag = lambda ok, name: F.when(ok, F.lit(name))
    flags = F.array_compact(F.array(flag(F.col("label") <= -0.9, "nonpositive_value"), flag(F.col("label") > 2, "extreme_upside"), flag(F.col("model") == "5-LOW", "low_priority")))
    w = _labels(spark, sf).withColumn("weight", valuation.label_weight(flags, ["nonpositive_value"], ["extreme_upside", "low_priority"]))
    share = lambda c: settle(F.avg(c.cast("double")))
    return w.groupBy("tier").agg(F.count("*").alias("n"), share(F.col("weight") == 0).alias("excluded_share"), share((F.col("weight") > 0) & (F.col("weight") < 1)).alias("downweighted_share"), settle(F.avg("weight")).alias("mean_weight"))


@query("""WITH t AS (SELECT c_custkey AS ticker, c_acctbal AS x, avg(o_totalprice) / 1e5 AS y FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2),
  f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM t)
  SELECT ticker, floor((y - a - b * x) * 1e6 + 0.5001234567) / 1e6 AS residual FROM t CROSS JOIN f""")
def factor_residuals(spark, sf):
    c, o = proxy.table(spark, sf, "customer"), proxy.table(spark, sf, "orders")
    t = o.groupBy(F.col("o_custkey").alias("ticker")).agg((F.avg("o_totalprice") / 1e5).alias("y")).join(c.select(F.col("c_custkey").alias("ticker"), F.col("c_acctbal").alias("x")), "ticker")
    fit = t.agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"))
    return t.crossJoin(F.broadcast(fit)).select("ticker", settle(F.col("y") - F.col("a") - F.col("b") * F.col("x")).alias("residual"))  # fit is one row


@query(f"WITH {_LABELS}, p AS (SELECT *, CASE tier WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.5 ELSE 0.25 END AS w FROM labels_long) SELECT ticker, {R('sum(w * label) / sum(w)')} AS weighted_label, count(*) AS n, {R('avg(w)')} AS mean_weight FROM p GROUP BY ticker")
def weighted_labels(spark, sf):
    w = F.when(F.col("tier") == "F", 1.0).when(F.col("tier") == "O", 0.5).otherwise(0.25)
    return _labels(spark, sf).withColumn("w", w).groupBy("ticker").agg(settle(F.sum(F.col("w") * F.col("label")) / F.sum("w")).alias("weighted_label"), F.count("*").alias("n"), settle(F.avg("w")).alias("mean_weight"))


@query(f"WITH {PANEL}, k AS (SELECT ticker, row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) AS i, count(*) OVER (PARTITION BY date) AS n FROM panel) SELECT ticker, count(*) AS appearances, count(*) FILTER (WHERE i <= ceil(n / 4.0)) AS hits, {R('avg(CASE WHEN i <= ceil(n / 4.0) THEN 1.0 ELSE 0.0 END)')} AS rate FROM k GROUP BY ticker")
def top_quartile_rates(spark, sf):
    i = F.row_number().over(Window.partitionBy("date").orderBy(F.col("score").desc(), "ticker"))
    hit = (i <= F.ceil(F.count(F.lit(1)).over(Window.partitionBy("date")) / 4)).cast("int")
    return proxy.panel(spark, sf).withColumn("hit", hit).groupBy("ticker").agg(F.count("*").alias("appearances"), F.sum("hit").alias("hits"), settle(F.avg("hit")).alias("rate"))


# --- universe


@query("""WITH ev AS (SELECT user_id AS ticker, CAST(ts AS DATE) AS on_day, CASE event_type WHEN 'signup' THEN 'added' ELSE 'removed' END AS kind, event_id AS seq FROM events WHERE event_type IN ('signup', 'error')),
  cur AS (SELECT DISTINCT user_id AS ticker FROM events WHERE event_type = 'purchase'), known AS (SELECT ticker FROM cur UNION SELECT ticker FROM ev),
  d AS (SELECT CAST(x AS DATE) AS date FROM (VALUES (DATE '2024-01-05'), (DATE '2024-01-15'), (DATE '2024-01-25')) v(x)),
  s AS (SELECT k.ticker, d.date, (SELECT kind FROM ev WHERE ev.ticker = k.ticker AND ev.on_day > d.date ORDER BY on_day, seq LIMIT 1) AS kind FROM known k CROSS JOIN d)
  SELECT date, ticker FROM s WHERE kind = 'removed' OR (kind IS NULL AND ticker IN (SELECT ticker FROM cur))""")
def membership_on_date(spark, sf):
    e = proxy.table(spark, sf, "events")
    changes = e.filter(F.col("event_type").isin("signup", "error")).select(F.col("user_id").alias("ticker"), F.to_date("ts").alias("date"), F.when(F.col("event_type") == "signup", "added").otherwise("removed").alias("kind"), F.col("event_id").alias("seq"))
    current = e.filter("event_type = 'purchase'").select(F.col("user_id").alias("ticker"))
    dates = spark.createDataFrame([("2024-01-05",), ("2024-01-15",), ("2024-01-25",)], "d string").select(F.to_date("d").alias("date"))
    return universe.membership_on_dates(current, changes, dates)


# --- filing text

# The driver's texts have few of a filing's terms, so each group also has some of theirs.
_MORE = {
    "positive_tone": ["the", "and", "with"], "negative_tone": ["worthless", "idiot", "trash", "from"], "uncertainty": ["or", "as", "or the"], "management_hedging": ["this", "on"], "capital_allocation_discipline": ["are", "was", "that"],
    "competitive_pressure": ["of the"], "pricing_power": ["the and", "un"], "demand_weakness": ["der", "and the"], "supply_chain_stress": ["la", "los"], "regulatory_pressure": ["are"], "accounting_aggressiveness": ["is", "by"], "guidance_credibility": ["in", "en"],
}
GROUPS = {g: [*terms, *_MORE[g]] for g, terms in text.TERMS.items()}
WORD_SQL = "len(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_''-]*'))"


def count_sql(terms: list[str], column: str = "plain") -> str:
    return " + ".join(rf"len(regexp_extract_all({column}, '\b{re.escape(t)}\b'))" for t in terms)


#: Lower-cased text in which any other letter is an x and any other mark no space, so that ASCII word edges are the right ones.
PLAIN_SQL = r"regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\x00-\x7F]', chr(1), 'g'), '[^\x00-\x7F]', 'x', 'g')"


@query(f"""WITH d AS (SELECT doc_id, text, {PLAIN_SQL} AS plain, {WORD_SQL} AS words FROM documents), n AS (SELECT doc_id, words, {', '.join(f'{count_sql(t)} AS {g}' for g, t in GROUPS.items())} FROM d)
  SELECT doc_id, CAST(words AS INTEGER) AS words, {R('coalesce((positive_tone - negative_tone) * 1.0 / nullif(positive_tone + negative_tone, 0), 0)')} AS tone,
    {', '.join(f"{R(f'coalesce(least(1.0, {g} * 1000.0 / nullif(words, 0) / 10), 0)')} AS {g}" for g in GROUPS if not g.endswith('_tone'))} FROM n""")
def keyword_density(spark, sf):
    found = proxy.table(spark, sf, "documents").select("doc_id", text.word_count(F.col("text")).alias("words"), text.terms_in(F.col("text"), GROUPS).alias("found"))
    n = {g: text.group_count(F.col("found"), GROUPS, g) for g in GROUPS}
    return found.select("doc_id", "words", settle(text.tone(n["positive_tone"], n["negative_tone"])).alias("tone"), *[settle(text.density(c, F.col("words"))).alias(g) for g, c in n.items() if not g.endswith("_tone")])


@query(f"""WITH t AS (SELECT doc_id, source, list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9_]{{2,}}')) AS tokens FROM documents),
  p AS (SELECT *, lag(tokens) OVER (PARTITION BY source ORDER BY doc_id) AS prior FROM t)
  SELECT doc_id, {R('1 - len(list_intersect(tokens, prior)) * 1.0 / nullif(len(list_distinct(list_concat(tokens, prior))), 0)')} AS novelty FROM p WHERE prior IS NOT NULL""")
def jaccard_novelty(spark, sf):
    d = proxy.table(spark, sf, "documents")
    return text.novelty(d, ["source"], ["doc_id"], "doc_id").filter("prior_doc_id is not null").select("doc_id", settle(F.col("novelty")).alias("novelty"))


# --- quality


@query("""SELECT 'positive_price' AS "check", count(*) FILTER (WHERE NOT coalesce(o_totalprice > 0, false)) AS bad FROM orders
  UNION ALL SELECT 'known_status', count(*) FILTER (WHERE NOT coalesce(o_orderstatus IN ('F', 'O'), false)) FROM orders
  UNION ALL SELECT 'has_customer', count(*) FILTER (WHERE o_custkey IS NULL) FROM orders""")
def dq_failures(spark, sf):
    o = proxy.table(spark, sf, "orders")
    return quality.failures(o, {"positive_price": F.col("o_totalprice") > 0, "known_status": F.col("o_orderstatus").isin("F", "O"), "has_customer": F.col("o_custkey").isNotNull()})


@query("SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dq_unique(spark, sf):
    return quality.duplicate_keys(proxy.table(spark, sf, "lineitem"), ["l_suppkey", "l_partkey"])


@query("SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linestatus) AS distinct_values FROM lineitem GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT l_linestatus) < 2")
def dq_constant_panels(spark, sf):
    return quality.constant_panels(proxy.table(spark, sf, "lineitem"), ["l_orderkey"], "l_linestatus")


@query()
def fingerprint(spark, sf):
    return quality.fingerprint(proxy.table(spark, sf, "lineitem"))
