"""Queries on composite scores, comparison of signals, and portfolio audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.functions.coerce import settle
from crosspanel.operators import comparison, diagnostics, membership, parts, portfolio, scores, universe
from crosspanel.plans.fact_queries import DERIVED, FEATURES, derived
from crosspanel.plans.registry import PANEL, R, query, ranked
from crosspanel.sources import proxy

_HAVE = {b: {f: s for f, s in fs.items() if f in DERIVED} for b, fs in scores.BLOCKS.items()}
_LONG = " UNION ALL ".join(f"SELECT ticker, '{f}' AS feature, {f} AS x FROM feat WHERE {f} IS NOT NULL" for f in {f: 1 for fs in _HAVE.values() for f in fs})
_SIGNS = ", ".join(f"('{b}', '{f}', {s})" for b, fs in _HAVE.items() for f, s in fs.items())
_BLOCK = f"""{FEATURES}, flong AS ({_LONG}), fq AS (SELECT feature, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM flong GROUP BY 1),
fcut AS (SELECT ticker, feature, least(greatest(x, lo), hi) AS x FROM flong JOIN fq USING (feature)), fm AS (SELECT feature, avg(x) AS m, stddev_pop(x) AS s FROM fcut GROUP BY 1),
fz AS (SELECT ticker, feature, CASE WHEN s > 1e-12 THEN (x - m) / s ELSE 0 END AS z FROM fcut JOIN fm USING (feature)),
blocks AS (SELECT ticker, block, avg(z * sign) AS score, count(*) AS feature_count FROM fz JOIN (VALUES {_SIGNS}) v(block, feature, sign) USING (feature) GROUP BY 1, 2)"""


@query(f"WITH {_BLOCK} SELECT ticker, block, {R('score')} AS score, feature_count FROM blocks")
def block_scores(spark, sf):
    return scores.block_scores(derived(spark, sf), []).withColumn("score", settle(F.col("score")))


@query(f"WITH {_BLOCK} SELECT ticker, {R('avg(score)')} AS composite, count(*) AS block_count FROM blocks GROUP BY 1")
def composite_score(spark, sf):
    return scores.composite(scores.block_scores(derived(spark, sf), []), []).withColumn("composite", settle(F.col("composite")))


@query(f"""WITH {_BLOCK}, sz AS (SELECT ticker, block, sign, CASE WHEN stddev_pop(z) OVER w > 1e-12 THEN (z - avg(z) OVER w) / stddev_pop(z) OVER w ELSE 0 END AS z
    FROM fz JOIN feat USING (ticker) JOIN (VALUES {_SIGNS}) v(block, feature, sign) USING (feature) WINDOW w AS (PARTITION BY feat.sector, block, feature)),
  sb AS (SELECT ticker, block, avg(z * sign) AS score FROM sz GROUP BY 1, 2) SELECT ticker, {R('avg(score)')} AS composite, count(*) AS block_count FROM sb GROUP BY 1""")
def composite_within_sector(spark, sf):
    """Scores of each name among the names of its sector."""
    return scores.composite(scores.block_scores(derived(spark, sf), [], within="sector"), []).withColumn("composite", settle(F.col("composite")))


_COLS = [f for f in scores.ADDITIVE if f in DERIVED]
_IMPUTED = f"{FEATURES}, med AS (SELECT sector, {', '.join(f'quantile_cont({c}, 0.5) AS {c}' for c in _COLS)} FROM feat GROUP BY 1), imp AS (SELECT ticker, f.sector, {', '.join(f'coalesce(f.{c}, m.{c}, 0) AS {c}' for c in _COLS)} FROM feat f JOIN med m ON f.sector IS NOT DISTINCT FROM m.sector)"


@query(f"WITH {_IMPUTED} SELECT ticker, sector, {', '.join(f'{R(c)} AS {c}' for c in _COLS)} FROM imp")
def median_impute(spark, sf):
    d = scores.median_imputed(derived(spark, sf), _COLS, ["sector"])
    return d.select("ticker", "sector", *[settle(F.col(c)).alias(c) for c in _COLS])


def _zsum(source: str) -> str:
    z = " + ".join(f"{scores.ADDITIVE[c]} * CASE WHEN {c} IS NULL THEN NULL WHEN stddev_pop({c}) OVER w > 1e-12 THEN ({c} - avg({c}) OVER w) / stddev_pop({c}) OVER w ELSE 0 END" for c in _COLS)
    return f"SELECT ticker, {R(z)} AS additive FROM {source} WINDOW w AS (PARTITION BY sector)"


@query(f"WITH {_IMPUTED} {_zsum('imp')}")
def additive_score_broad(spark, sf):
    return scores.additive_score(derived(spark, sf), ["sector"], impute=True).select("ticker", settle(F.col("additive")).alias("additive"))


@query(f"WITH {FEATURES} {_zsum('feat')}")
def additive_score_clean(spark, sf):
    return scores.additive_score(derived(spark, sf), ["sector"], impute=False).select("ticker", settle(F.col("additive")).alias("additive"))


@query(f"""WITH {FEATURES}, q AS (SELECT ticker, sector, roe, quantile_cont(roe, 0.01) OVER w AS lo, quantile_cont(roe, 0.99) OVER w AS hi FROM feat WINDOW w AS (PARTITION BY sector)),
  c AS (SELECT ticker, sector, CASE WHEN roe IS NOT NULL THEN least(greatest(roe, lo), hi) END AS x FROM q), f AS (SELECT ticker, sector, coalesce(x, quantile_cont(x, 0.5) OVER (PARTITION BY sector), 0) AS x FROM c)
  SELECT ticker, {R('CASE WHEN stddev_pop(x) OVER w > 1e-12 THEN (x - avg(x) OVER w) / stddev_pop(x) OVER w ELSE 0 END')} AS roe FROM f WINDOW w AS (PARTITION BY sector)""")
def standardize_for_fit(spark, sf):
    return scores.standardized(derived(spark, sf), ["roe"], ["sector"]).select("ticker", settle(F.col("roe")).alias("roe"))


# Fixed parameters of a linear score: coefficient, median, mean, scale.
_TERMS = {"roe": (0.5, 0.2, 0.25, 0.4), "fcf_to_ev": (0.3, 0.01, 0.02, 0.05), "asset_growth_1y": (-0.2, -0.4, -0.3, 0.0)}


@query(f"WITH {FEATURES} SELECT ticker, {R('0.1 + ' + ' + '.join(f'(coalesce({c}, {m}) - {a}) / {s or 1.0} * ({w})' for c, (w, m, a, s) in _TERMS.items()))} AS score FROM feat")
def linear_score(spark, sf):
    return derived(spark, sf).select("ticker", settle(scores.linear_score(0.1, _TERMS)).alias("score"))


# --- signals over dates, long

_SIGNALS = {"momentum_3m": "score", "size": "-market_cap", "flat": "CASE WHEN ticker % 7 = 0 THEN 1.0 END"}
SIGNALS = f"""{PANEL}, signals AS ({' UNION ALL '.join(f"SELECT '{k}' AS signal, ticker, date, sector, ret, {x} AS score FROM panel" for k, x in _SIGNALS.items())})"""


def signals(spark, sf) -> DataFrame:
    p = proxy.panel(spark, sf)
    made = {"momentum_3m": F.col("score"), "size": -F.col("market_cap"), "flat": F.when(F.col("ticker") % 7 == 0, 1.0)}
    one = F.explode(F.array(*[F.struct(F.lit(k).alias("signal"), x.cast("double").alias("score")) for k, x in made.items()]))
    return p.select("ticker", "date", "sector", "ret", one.alias("s")).select("ticker", "date", "sector", "ret", "s.signal", "s.score")


@query(f"WITH {SIGNALS} SELECT ticker, date, max(sector) AS sector, max(ret) AS ret, {', '.join(f'max(score) FILTER (WHERE signal = {chr(39)}{k}{chr(39)}) AS {k}' for k in _SIGNALS)} FROM signals GROUP BY 1, 2")
def ic_input(spark, sf):
    """Wide view of the long signals, for export."""
    return signals(spark, sf).groupBy("ticker", "date").pivot("signal", list(_SIGNALS)).agg(F.first("score").alias("score")).join(proxy.panel(spark, sf).select("ticker", "date", "sector", "ret"), ["ticker", "date"])


@query(f"WITH {SIGNALS} SELECT signal, date, ticker, score FROM signals WINDOW w AS (PARTITION BY signal, date) QUALIFY count(score) OVER w >= 2 AND min(score) OVER w < max(score) OVER w")
def drop_degenerate(spark, sf):
    return scores.without_degenerate(signals(spark, sf), ["signal", "date"]).select("signal", "date", "ticker", "score")


_SUMMARY = f"""{SIGNALS}, split AS (SELECT * FROM signals WHERE score IS NOT NULL), across AS (SELECT signal, date, sector, avg(score) AS score, avg(ret) AS ret FROM split WHERE ret IS NOT NULL GROUP BY 1, 2, 3),
sic AS (SELECT signal, date, rank_ic, 'global' AS d FROM {ranked('split', 'signal, date')} UNION ALL SELECT signal, date, rank_ic, 'across_sector' FROM {ranked('across', 'signal, date')}),
ssum AS (SELECT signal, d, count(*) AS months, avg(rank_ic) AS mean_ic FROM sic WHERE rank_ic IS NOT NULL GROUP BY 1, 2)"""


@query(f"""WITH {_SUMMARY}, w AS (SELECT signal, max(mean_ic) FILTER (WHERE d = 'global') AS g, max(mean_ic) FILTER (WHERE d = 'across_sector') AS a, max(months) FILTER (WHERE d = 'global') AS gm FROM ssum GROUP BY 1)
  SELECT e.signal, {R('g')} AS global_mean_ic, {R('a')} AS across_sector_mean_ic, gm AS global_months,
    CASE WHEN w.signal IS NULL THEN 'missing_signal' WHEN g IS NULL OR a IS NULL THEN 'blocked_missing_decomposition' WHEN gm < 12 THEN 'diagnostic_insufficient_history' ELSE 'available' END AS status
  FROM (VALUES ('momentum_3m'), ('size'), ('flat'), ('absent')) e(signal) LEFT JOIN w USING (signal)""")
def signal_comparison(spark, sf):
    s = signals(spark, sf)
    ic = diagnostics.rank_ic(s, ["signal", "date"])
    summary = diagnostics.ic_summary(ic, ["signal", "decomposition"])
    expected = spark.createDataFrame([(k,) for k in [*_SIGNALS, "absent"]], "signal string")
    c = comparison.signal_comparison(summary, expected)
    return c.select("signal", settle(F.col("global_mean_ic")).alias("global_mean_ic"), settle(F.col("across_sector_mean_ic")).alias("across_sector_mean_ic"), "global_months", "status")


@query(f"""WITH {PANEL} SELECT count(DISTINCT date) AS months, count(DISTINCT sector) AS sectors, count(*) FILTER (WHERE score IS NOT NULL AND ret IS NOT NULL) AS ret_paired, CAST(0 AS BIGINT) AS return_24m_paired, 'ret' AS primary_return,
  'no_coverage_return_24m' AS blockers FROM panel""")
def diagnostic_status(spark, sf):
    p = proxy.panel(spark, sf).withColumn("return_24m", F.lit(None).cast("double"))
    return comparison.diagnostic_status(p, ["return_24m", "ret"]).select("months", "sectors", "ret_paired", "return_24m_paired", "primary_return", "blockers")


@query(f"""WITH {_BLOCK}, c AS (SELECT ticker, avg(score) AS x FROM blocks GROUP BY 1)
  SELECT ticker, {R('market_cap / 1e6')} AS size_signal, {R('c.x')} AS composite, CAST(ev IS NULL AS INTEGER) + CAST(roe IS NULL AS INTEGER) AS missing FROM feat LEFT JOIN c USING (ticker)""")
def add_benchmark_signals(spark, sf):
    d = derived(spark, sf)
    c = scores.composite(scores.block_scores(d, []), [])
    missing = F.col("ev").isNull().cast("int") + F.col("roe").isNull().cast("int")
    return d.join(c, "ticker", "left").select("ticker", settle(F.col("market_cap") / 1e6).alias("size_signal"), settle(F.col("composite")).alias("composite"), missing.alias("missing"))


# --- portfolios by signal

_HELD = """held AS (SELECT * EXCLUDE (i, n), 'Q' || CAST(CASE WHEN n < 50 THEN 2 * (i * 3 // n) + 1 ELSE (i * 5 // n) + 1 END AS VARCHAR) AS bucket
  FROM (SELECT *, row_number() OVER (PARTITION BY signal, date ORDER BY score DESC, ticker) - 1 AS i, count(*) OVER (PARTITION BY signal, date) AS n FROM signals WHERE score IS NOT NULL) WHERE n >= 3),
w AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY signal, date, bucket) AS weight FROM held)"""
_AFTER = """ks AS (SELECT *, dense_rank() OVER (PARTITION BY signal, bucket ORDER BY date) AS k FROM w), ds AS (SELECT DISTINCT signal, bucket, k, date FROM ks),
kl AS (SELECT signal, bucket, k, weight, lag(k) OVER w AS k0, lag(weight) OVER w AS w0, lead(k) OVER w AS k1 FROM ks WINDOW w AS (PARTITION BY signal, bucket, ticker ORDER BY k)),
kj AS (SELECT signal, bucket, k, abs(weight - CASE WHEN k0 = k - 1 THEN w0 ELSE 0 END) AS d FROM kl UNION ALL SELECT signal, bucket, k + 1, weight FROM kl WHERE k1 IS DISTINCT FROM k + 1),
tv AS (SELECT kj.signal, kj.bucket, ds.date, CASE WHEN kj.k = 1 THEN sum(d) ELSE sum(d) / 2 END AS turnover FROM kj JOIN ds ON ds.signal = kj.signal AND ds.bucket = kj.bucket AND ds.k = kj.k GROUP BY kj.signal, kj.bucket, ds.date, kj.k),
sbr AS (SELECT signal, bucket, date, sum(weight * ret) / sum(weight) AS ret, count(*) AS names FROM w WHERE ret IS NOT NULL GROUP BY 1, 2, 3)"""
_NEUTRAL = """nk AS (SELECT *, row_number() OVER (PARTITION BY signal, date, sector ORDER BY score DESC, ticker) - 1 AS i, count(*) OVER (PARTITION BY signal, date, sector) AS n FROM signals WHERE score IS NOT NULL AND sector IS NOT NULL),
nb AS (SELECT *, 'Q' || CAST(CASE WHEN n < 50 THEN 2 * (i * 3 // n) + 1 ELSE (i * 5 // n) + 1 END AS VARCHAR) AS bucket FROM nk WHERE n >= 3),
ns AS (SELECT signal, date, count(DISTINCT sector) AS s FROM nb GROUP BY 1, 2), bs AS (SELECT signal, date, bucket, count(DISTINCT sector) AS s FROM nb GROUP BY 1, 2, 3),
w AS (SELECT nb.*, 1.0 / bs.s / count(*) OVER (PARTITION BY nb.signal, nb.date, nb.bucket, nb.sector) AS weight FROM nb JOIN ns ON ns.signal = nb.signal AND ns.date = nb.date
  JOIN bs ON bs.signal = nb.signal AND bs.date = nb.date AND bs.bucket = nb.bucket WHERE ns.s >= 2)"""
_BY_SIGNAL = f"{SIGNALS}, {_HELD}, {_AFTER}"


@query(f"WITH {_BY_SIGNAL} SELECT w.signal, w.date, w.bucket, w.ticker, CAST(c AS DOUBLE) AS cost_bps, {R('turnover * c / 1e4 * weight')} AS cost, {R('ret - turnover * c / 1e4 * weight')} AS net_return FROM w JOIN tv ON tv.signal = w.signal AND tv.bucket = w.bucket AND tv.date = w.date CROSS JOIN (VALUES (0), (25)) v(c)")
def holdings(spark, sf):
    held = portfolio.equal_weights(signals(spark, sf), ["signal", "date"])
    h = comparison.holdings_report(held, portfolio.turnover(held, ["signal", "bucket"]), ["signal", "bucket"], [0, 25])
    return h.select("signal", "date", "bucket", "ticker", "cost_bps", settle(F.col("cost")).alias("cost"), settle(F.col("net_return")).alias("net_return"))


def _net(mode: str) -> str:
    return f"SELECT '{mode}' AS mode, sbr.signal, sbr.date, sbr.bucket, names, CAST(c AS DOUBLE) AS cost_bps, {R('ret')} AS gross_return, {R('ret - turnover * c / 1e4')} AS net_return FROM sbr JOIN tv ON tv.signal = sbr.signal AND tv.bucket = sbr.bucket AND tv.date = sbr.date CROSS JOIN (VALUES (0), (25)) v(c)"


@query(f"WITH {_BY_SIGNAL} {_net('unconstrained')}")
def audited_unconstrained(spark, sf):
    return _audited(spark, sf).filter("mode = 'unconstrained'")


def _audited(spark, sf):
    a = comparison.audited(signals(spark, sf), ["signal"], [0, 25])
    return a.select("mode", "signal", "date", "bucket", "names", "cost_bps", settle(F.col("gross_return")).alias("gross_return"), settle(F.col("net_return")).alias("net_return"))


@query(f"WITH {SIGNALS}, {_NEUTRAL}, {_AFTER} {_net('sector_neutral')}")
def audited_sector_neutral(spark, sf):
    return _audited(spark, sf).filter("mode = 'sector_neutral'")


@query(f"""WITH {SIGNALS}, lk AS (SELECT *, row_number() OVER (PARTITION BY signal, date ORDER BY score DESC, ticker) - 1 AS i, count(*) OVER (PARTITION BY signal, date) AS n FROM signals WHERE score IS NOT NULL),
  lb AS (SELECT *, 'Q' || CAST(CASE WHEN n < 3 THEN 1 WHEN n < 50 THEN 2 * (i * 3 // n) + 1 ELSE (i * 5 // n) + 1 END AS VARCHAR) AS bucket FROM lk), lw AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY signal, date, bucket) AS weight FROM lb)
  SELECT signal, date, bucket, CAST(c AS DOUBLE) AS cost_bps, count(*) AS names, {R('sum(weight * ret)')} AS gross_return, {R('sum(weight * ret - weight * c / 1e4)')} AS net_return FROM lw CROSS JOIN (VALUES (10), (50)) v(c) WHERE ret IS NOT NULL GROUP BY 1, 2, 3, c""")
def label_audit(spark, sf):
    """Every date is a cross-section of its own."""
    a = comparison.label_audit(signals(spark, sf), ["signal", "date"], [10, 50])
    return a.select("signal", "date", "bucket", "cost_bps", "names", settle(F.col("gross_return")).alias("gross_return"), settle(F.col("net_return")).alias("net_return"))


_NULLS = "CAST(score IS NULL AS INTEGER) + CAST(ret IS NULL AS INTEGER) + CAST(market_cap <= 0 AS INTEGER) + CAST(ticker % 9 = 0 AS INTEGER)"
_UNIVERSES = f"{PANEL}, signals AS (SELECT 'broad' AS signal, * FROM panel WHERE {_NULLS} <= 2 UNION ALL SELECT 'clean', * FROM panel WHERE {_NULLS} = 0)"


@query(f"""SELECT mode, signal AS universe, date, bucket, names, cost_bps, gross_return, net_return FROM (
  (WITH {_UNIVERSES}, {_HELD}, {_AFTER} {_net('unconstrained')}) UNION ALL (WITH {_UNIVERSES}, {_NEUTRAL}, {_AFTER} {_net('sector_neutral')}))""")
def universe_backtest(spark, sf):
    """Both weightings on the clean and the broad universe, net of costs."""
    p = proxy.panel(spark, sf).withColumns({"cap": F.when(F.col("market_cap") > 0, F.col("market_cap")), "other": F.when(F.col("ticker") % 9 != 0, 1.0)})
    rows = universe.by_universe(universe.with_null_count(p, ["score", "ret", "cap", "other"])).drop("cap", "other", "feature_null_count")
    a = comparison.audited(parts.checkpointed(rows), ["universe"], [0, 25])
    return a.select("mode", "universe", "date", "bucket", "names", "cost_bps", settle(F.col("gross_return")).alias("gross_return"), settle(F.col("net_return")).alias("net_return"))


def _signal_buckets(spark, sf):
    held = portfolio.equal_weights(signals(spark, sf), ["signal", "date"]).filter("ret is not null")
    return held.groupBy("signal", "bucket", "date").agg((F.sum(F.col("weight") * F.col("ret")) / F.sum("weight")).alias("ret"), F.count("*").alias("names"))


@query(f"""WITH {_BY_SIGNAL}, j AS (SELECT a.signal, a.ret AS ra, b.ret AS rb FROM sbr a JOIN sbr b ON a.signal = b.signal AND a.date = b.date AND a.bucket = 'Q1' AND b.bucket = 'Q5')
  SELECT signal, count(*) AS months, {R('avg(CASE WHEN ra > rb THEN 1.0 ELSE 0.0 END)')} AS hit_rate, {R('pow(product(1 + ra), 12.0 / count(*)) - pow(product(1 + rb), 12.0 / count(*))')} AS annual_gap,
    pow(product(1 + ra), 12.0 / count(*)) > pow(product(1 + rb), 12.0 / count(*)) AND avg(CASE WHEN ra > rb THEN 1.0 ELSE 0.0 END) > 0.5 AS beats FROM j GROUP BY 1""")
def outperformance(spark, sf):
    b = _signal_buckets(spark, sf)
    o = comparison.outperformance(b.filter("bucket = 'Q1'"), b.filter("bucket = 'Q5'"), ["signal"])
    return o.select("signal", "months", settle(F.col("hit_rate")).alias("hit_rate"), settle(F.col("annual_gap")).alias("annual_gap"), "beats")


@query(f"""WITH {_BY_SIGNAL}, p AS (SELECT signal, date, max(ret) FILTER (WHERE bucket = 'Q1') AS q1, max(ret) FILTER (WHERE bucket = 'Q5') AS q5, sum(names) AS names FROM sbr GROUP BY 1, 2)
  SELECT signal, count(*) AS months, {R('avg(q1)')} AS q1_mean, {R('avg(q5)')} AS q5_mean, {R('avg(q1 - q5)')} AS spread_mean, {R('stddev_pop(q1 - q5) * sqrt(12)')} AS spread_volatility, quantile_cont(names, 0.5) AS median_names FROM p GROUP BY 1""")
def signal_performance(spark, sf):
    p = _signal_buckets(spark, sf).groupBy("signal", "date").agg(F.max(F.when(F.col("bucket") == "Q1", F.col("ret"))).alias("q1"), F.max(F.when(F.col("bucket") == "Q5", F.col("ret"))).alias("q5"), F.sum("names").alias("names"))
    gap = F.col("q1") - F.col("q5")
    return p.groupBy("signal").agg(F.count("*").alias("months"), settle(F.avg("q1")).alias("q1_mean"), settle(F.avg("q5")).alias("q5_mean"), settle(F.avg(gap)).alias("spread_mean"), settle(F.stddev_pop(gap) * 12**0.5).alias("spread_volatility"), F.percentile("names", F.lit(0.5)).alias("median_names"))


@query(f"WITH {_BY_SIGNAL} SELECT signal, bucket, count(*) AS months, {R('stddev_pop(ret) * sqrt(12)')} AS volatility, {R('avg(ret) / nullif(stddev_pop(ret), 0) * sqrt(12)')} AS sharpe FROM sbr GROUP BY 1, 2")
def strategy_pass(spark, sf):
    """All signals on one universe side by side."""
    p = portfolio.performance(_signal_buckets(spark, sf), ["signal", "bucket"])
    return p.select("signal", "bucket", "months", settle(F.col("volatility")).alias("volatility"), settle(F.col("sharpe")).alias("sharpe"))


@query(f"""WITH {PANEL}, el AS (SELECT * FROM panel WHERE ticker % 2 = 1 OR date >= DATE '1995-01-01' + CAST(ticker * 10 AS INTEGER)),
  h AS (SELECT ticker, date, 'model' AS signal, 0.1 + (score - 0.5) / 2 * 0.3 AS score FROM el UNION ALL SELECT ticker, date, 'score', CASE WHEN stddev_pop(score) OVER w > 1e-12 THEN (score - avg(score) OVER w) / stddev_pop(score) OVER w ELSE 0 END FROM el WINDOW w AS (PARTITION BY date))
  SELECT ticker, date, signal, {R('score')} AS score FROM h WINDOW w AS (PARTITION BY date, signal) QUALIFY min(score) OVER w < max(score) OVER w""")
def score_history(spark, sf):
    """A fixed linear map and the raw factor over all dates, for names in the universe by then."""
    p = proxy.panel(spark, sf).select("ticker", "date", "score")
    changes = proxy.securities(spark, sf).filter("ticker % 2 = 0").select("ticker", F.lit("added").alias("kind"), F.date_add(F.lit("1995-01-01").cast("date"), (F.col("ticker") * 10).cast("int")).alias("date"))
    h = scores.score_history(membership.add_date_filter(p, changes), ["date"], {"model": scores.linear_score(0.1, {"score": (0.3, 0.0, 0.5, 2.0)})}, ["score"])
    return h.select("ticker", "date", "signal", settle(F.col("score")).alias("score"))
