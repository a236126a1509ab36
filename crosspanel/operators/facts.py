"""Facts and filings: selection by anchor, per-filing snapshots, prior periods, references and debt fall-backs.

A fact is a row (ticker, field, value, end, filed, accn, form, fy, rank); of candidates for one field a lower rank is better.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The order in which a company's anchor fact is looked for.
ANCHOR_FIELDS = ["revenue", "net_income", "total_assets"]


# Forms of annual and of quarterly reports, and the days that their periods last.
ANNUAL_FORMS = ["10-K", "10-K/A", "10-KT", "10-KT/A", "20-F", "20-F/A", "40-F", "40-F/A"]
QUARTERLY_FORMS, QUARTERS = ["10-Q", "10-Q/A"], ["Q1", "Q2", "Q3"]
ANNUAL_DAYS, QUARTERLY_DAYS = (300, 380), (45, 130)


def _lasts(days: tuple[int, int]) -> Column:
    """A fact of a day needs no start; one of a period must last so long."""
    return ~F.col("is_duration") | F.coalesce(F.datediff("end", "start").between(*days), F.lit(False))


def annual_facts(facts: DataFrame) -> DataFrame:
    """Facts (form, start, end, is_duration, ...) of annual reports about whole years; stub periods go."""
    return facts.filter(F.col("form").isin(ANNUAL_FORMS) & F.col("end").isNotNull() & _lasts(ANNUAL_DAYS))


def quarterly_facts(facts: DataFrame) -> DataFrame:
    """Facts (form, fp, start, end, is_duration, ...) of the first three quarters; figures of the year to date go."""
    return facts.filter(F.col("form").isin(QUARTERLY_FORMS) & F.col("fp").isin(QUARTERS) & F.col("end").isNotNull() & _lasts(QUARTERLY_DAYS))


def preferred_unit(facts: DataFrame, units: list[str]) -> DataFrame:
    """Of each ticker and tag the facts in the first of units that it has at all, or all of them if it has none.

    To be applied before other filters: the choice looks at which units are there, not at which facts survive.
    """
    place = F.array_position(F.array(*[F.lit(u) for u in units]), F.col("unit"))
    place = F.when(place > 0, place)
    best = F.min(place).over(Window.partitionBy("ticker", "tag"))
    return facts.withColumns({"_place": place, "_best": best}).filter("_best is null or _place = _best").drop("_place", "_best")


def selected_annual(facts: DataFrame, units: list[str]) -> DataFrame:
    """One annual fact for each ticker and field: units first, then forms and lengths, then the choice around the anchor."""
    usable = annual_facts(preferred_unit(facts, units))
    return select_facts(usable, anchor_facts(usable))


def quarterly_panel(facts: DataFrame, units: list[str]) -> DataFrame:
    """(ticker, fy, fp, end, filed and a column for each of revenue, ebit, ocf, capex; fcf): the newest quarterly fact of each period.

    Figures of the year to date and of other units are left out before the choice; capex counts by its size.
    """
    usable = quarterly_facts(preferred_unit(facts, units)).filter("value is not null")
    order = F.struct("filed", -F.col("rank"))
    pick = lambda f: F.max_by("value", F.when(F.col("field") == f, order)).alias(f)
    wide = usable.groupBy("ticker", "fy", "fp", "end").agg(F.max("filed").alias("filed"), *[pick(f) for f in ("revenue", "ebit", "ocf", "capex")])
    return wide.withColumn("capex", F.abs("capex")).withColumn("fcf", F.col("ocf") - F.col("capex"))


def anchor_facts(facts: DataFrame, fields: list[str] = ANCHOR_FIELDS) -> DataFrame:
    """(ticker, anchor_field, anchor_end, anchor_accn): the newest fact of the first field that the company reports."""
    place = F.array_position(F.array(*[F.lit(f) for f in fields]), F.col("field"))
    best = F.max_by(F.struct("field", "end", "accn"), F.struct(-place, "end", "filed", -F.col("rank"), "accn"))
    found = facts.filter(F.col("field").isin(fields) & F.col("value").isNotNull()).groupBy("ticker").agg(best.alias("a"))
    return found.select("ticker", F.col("a.field").alias("anchor_field"), F.col("a.end").alias("anchor_end"), F.col("a.accn").alias("anchor_accn"))


def select_facts(facts: DataFrame, anchors: DataFrame) -> DataFrame:
    """One fact per ticker and field: same filing as the anchor, then same end, then nearest end, then newest.

    Both sides are keyed by ticker, so the join and the aggregation need one shuffle of the facts. Without an anchor the
    newest fact is taken. Facts that are equal in all this and in rank go by accession and value, the greatest first, so
    that the choice does not depend on where rows lie.
    """
    no = F.lit(False)
    near = F.coalesce(-F.abs(F.datediff("end", "anchor_end")).cast("double"), F.lit(-1e9))
    order = F.struct(F.coalesce(F.col("accn") == F.col("anchor_accn"), no), F.coalesce(F.col("end") == F.col("anchor_end"), no), near, "end", "filed", -F.col("rank"), "accn", "value")
    chosen = F.max_by(F.struct("value", "end", "filed", "accn"), order)
    return facts.filter("value is not null").join(anchors, "ticker", "left").groupBy("ticker", "field").agg(chosen.alias("f")).select("ticker", "field", "f.*")


def total_debt(direct: Column, long: Column, short: Column) -> Column:
    """Size of the direct figure, else of long and short added, one of which may be missing."""
    parts = F.coalesce(F.abs(long), F.lit(0.0)) + F.coalesce(F.abs(short), F.lit(0.0))
    return F.coalesce(F.abs(direct), F.when(long.isNotNull() | short.isNotNull(), parts))


def depreciation(direct: Column, tangible: Column, intangible: Column) -> Column:
    parts = F.coalesce(tangible, F.lit(0.0)) + F.coalesce(intangible, F.lit(0.0))
    return F.coalesce(direct, F.when(tangible.isNotNull() | intangible.isNotNull(), parts))


def gross_profit(direct: Column, revenue: Column, *costs: Column) -> Column:
    return F.coalesce(direct, revenue - F.abs(F.coalesce(*costs)))


def quarterly_debt(periods: DataFrame) -> DataFrame:
    """periods (ticker, end, direct_debt, long_debt, short_debt) with debt: parts only where the company never reports a direct figure."""
    ever = F.max(F.col("direct_debt").isNotNull()).over(Window.partitionBy("ticker"))
    parts = F.when(F.col("long_debt").isNotNull() | F.col("short_debt").isNotNull(), F.coalesce("long_debt", F.lit(0.0)) + F.coalesce("short_debt", F.lit(0.0)))
    return periods.withColumn("debt", F.when(ever, F.col("direct_debt")).otherwise(parts))


def filing_snapshots(facts: DataFrame, fields: list[str]) -> DataFrame:
    """One row per filing with a column for each field: the fact of the filing's own period first, then the newest.

    A filing is its accession, or filed, end, form and year together where that is missing. The window and the
    aggregation share one shuffle.
    """
    key = F.coalesce("accn", F.concat_ws("|", F.col("filed").cast("string"), F.col("end").cast("string"), "form", F.col("fy").cast("string")))
    whole = Window.partitionBy("ticker", "filing")
    keyed = facts.filter("value is not null").withColumn("filing", key).withColumn("_period", F.max("end").over(whole))
    order = F.struct(F.col("end") == F.col("_period"), "end", -F.col("rank"))
    latest = F.struct("end", -F.col("rank"), "field")
    picks = [F.max_by("value", F.when(F.col("field") == f, order)).alias(f) for f in fields]
    return keyed.groupBy("ticker", "filing").agg(
        F.max("accn").alias("accn"), F.max("filed").alias("filed"), F.max("end").alias("period_end"),
        F.max_by("fy", F.when(F.col("fy").isNotNull(), latest)).alias("fy"), F.max_by("form", F.when(F.col("form").isNotNull(), latest)).alias("form"), *picks)


def with_prior_filing(snapshots: DataFrame, values: list[str]) -> DataFrame:
    """snapshots with prior_period_end and prior_<value>: the nearest earlier filing of an earlier period.

    Where an end is missing fiscal years decide, and where these are missing too any earlier filing will do. A company's
    filings (a few hundred) are one sorted array, held once; each looks back along it.
    """
    order = F.struct(F.coalesce("filed", F.lit("0001-01-01").cast("date")).alias("a"), F.coalesce("period_end", F.lit("0001-01-01").cast("date")).alias("b"), F.col("filing").alias("c"))
    one = snapshots.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct(order.alias("_order"), *[c for c in snapshots.columns if c != "ticker"]))).alias("_all"))

    def with_prior(row: Column, i: Column) -> Column:
        def earlier(p: Column) -> Column:
            return F.coalesce(p["period_end"] < row["period_end"], p["fy"] < row["fy"], F.lit(True))

        prior = F.try_element_at(F.filter(F.slice("_all", 1, i), earlier), F.lit(-1))
        return F.struct(row.alias("row"), prior.alias("prior"))

    rows = one.select("ticker", F.explode(F.transform("_all", with_prior)).alias("_r"))
    own = [F.col("ticker") if c == "ticker" else F.col(f"_r.row.{c}").alias(c) for c in snapshots.columns]
    return rows.select(*own, F.col("_r.prior.period_end").alias("prior_period_end"), *[F.col(f"_r.prior.{v}").alias(f"prior_{v}") for v in values])


def filing_refs(facts: DataFrame) -> DataFrame:
    """(ticker, accn, form, filed, end): distinct accessions; where a company has facts of taxonomy dei, only those count."""
    cover = F.max(F.col("taxonomy") == "dei").over(Window.partitionBy("ticker"))
    some = facts.filter("accn is not null").withColumn("_cover", cover).filter((F.col("taxonomy") == "dei") | ~F.col("_cover"))
    order = F.struct("filed", "end", -F.col("rank"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    return some.groupBy("ticker", "accn").agg(last("form"), last("filed"), last("end"))


def corpus_requests(refs: DataFrame, quarterly: DataFrame, annual: int = 2, quarters: int = 2) -> DataFrame:
    """The newest annual and quarterly filings of each ticker with url and flags; a repeated accession counts once, the quarterly row last."""

    def newest(rows: DataFrame, k: int) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("filed").desc_nulls_last(), F.col("accn").desc()))
        return rows.withColumn("lookback_rank", nth).filter(F.col("lookback_rank") <= k)

    both = newest(refs.filter("form = '10-K'"), annual).withColumn("_part", F.lit(0)).unionByName(newest(quarterly.filter("form = '10-Q'").dropDuplicates(["ticker", "accn"]), quarters).withColumn("_part", F.lit(1)))
    last = F.row_number().over(Window.partitionBy("ticker", "accn").orderBy(F.col("_part").desc()))
    limited = F.col("filed").isNotNull() & F.col("accn").isNotNull()
    flags = F.array_compact(F.array(F.when(F.col("filed").isNull(), F.lit("missing_filed")), F.when(F.col("accn").isNull(), F.lit("missing_accession"))))
    url = F.concat(F.lit("filings/"), F.col("ticker").cast("string"), F.lit("/"), F.translate("accn", "-", ""), F.lit(".txt"))
    return both.withColumn("_last", last).filter("_last = 1").select("ticker", "accn", "form", "filed", "lookback_rank", url.alias("path"), limited.alias("date_limited_source"), flags.alias("flags"))


def latest_report(reports: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The last row of each group in the order of the named columns, nulls first."""
    rest = [c for c in reports.columns if c not in by]
    return reports.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*by, "r.*")


def derive(df: DataFrame) -> DataFrame:
    """Ratios of fundamentals: missing inputs and zero divisors give null.

    In: raw_close, shares, ocf, capex, total_debt, cash, ebit, equity, net_income, gross_profit, revenue, assets,
    prior_assets, current_assets, current_liabilities.
    """
    c = F.col
    out = df.withColumn("market_cap", F.when(c("shares") != 0, c("raw_close") * c("shares"))).withColumn("fcf", c("ocf") - F.abs(c("capex")))
    out = out.withColumn("ev", c("market_cap") + c("total_debt") - c("cash"))
    ratio = F.try_divide
    # Fixed value: a flat tax of 21 percent on operating profit.
    return out.withColumns({
        "fcf_to_ev": F.when(c("ev") > 0, c("fcf") / c("ev")), "fcf_yield": ratio(c("fcf"), c("market_cap")), "roic": ratio(0.79 * c("ebit"), c("equity") + c("total_debt") - c("cash")),
        "roe": ratio(c("net_income"), c("equity")), "gross_margin": ratio(c("gross_profit"), c("revenue")), "operating_margin": ratio(c("ebit"), c("revenue")),
        "net_margin": ratio(c("net_income"), c("revenue")), "gross_profitability_assets": ratio(c("gross_profit"), c("assets")), "book_to_market": ratio(c("equity"), c("market_cap")),
        "debt_to_equity": ratio(c("total_debt"), c("equity")), "current_ratio": ratio(c("current_assets"), c("current_liabilities")), "asset_turnover": ratio(c("revenue"), c("assets")),
        "asset_growth_1y": ratio(c("assets") - c("prior_assets"), c("prior_assets")), "cash_earnings_gap": ratio(c("ocf") - c("net_income"), c("assets")),
        "accruals": ratio(c("net_income") - c("ocf"), c("assets")), "capex_intensity": ratio(F.abs(c("capex")), c("revenue"))})
