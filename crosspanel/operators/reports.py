"""Valuation reports as table jobs: inputs with defaults, scenarios, cash flows, values, rates, flags and panels.

A report is a row whose forecast is an array of yearly structs, so a projection is one higher-order fold inside the row.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions.coerce import num_or_null, parse_amount
from crosspanel.operators.valuation import DOWNWEIGHT, EXCLUDE, flag_policy, implied_rate, label_weight

# What a report without the figure is taken to say.
TAX, GROWTH, NOL_USE, YEARS = 0.21, 0.02, 0.8, 5
MODES = ["base", "bull", "bear"]


def flag_list(flags: dict[str, Column]) -> Column:
    """Names whose condition is true, as a sorted set."""
    return F.array_sort(F.array_compact(F.array(*[F.when(ok, F.lit(name)) for name, ok in flags.items()])))


def normalize_inputs(raw: DataFrame) -> DataFrame:
    """Text figures -> numbers, defaults with flags, and a reason where a critical one is missing (null: usable).

    In: tax_rate, terminal_growth, nol_utilization, wacc, revenue, shares (text) and columns kept as they are.
    Explicit zeros stay zeros.
    """
    ratio = lambda c: parse_amount(F.col(c), ratio=True)
    read = raw.withColumns({"_tax": ratio("tax_rate"), "_growth": ratio("terminal_growth"), "_use": ratio("nol_utilization"), "wacc": ratio("wacc"), "revenue": parse_amount(F.col("revenue")), "shares": parse_amount(F.col("shares"))})
    reason = F.when(F.col("revenue").isNull(), "missing_revenue").when(F.col("wacc").isNull(), "missing_wacc").when(F.col("shares").isNull() | (F.col("shares") <= 0), "missing_shares")
    flags = flag_list({"default_tax_rate": F.col("_tax").isNull(), "default_terminal_growth": F.col("_growth").isNull()})
    return read.withColumns({
        "tax_rate": F.coalesce("_tax", F.lit(TAX)), "terminal_growth": F.coalesce("_growth", F.lit(GROWTH)), "nol_utilization": F.coalesce("_use", F.lit(NOL_USE)), "flags": flags, "reason": reason,
    }).drop("_tax", "_growth", "_use")


def forecast_years(*drivers: Column, last_year: Column, declared: Column | None = None) -> Column:
    """Years of the drivers' maps together, sorted; without any the declared number (five) after last_year."""
    union = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.coalesce(F.map_keys(d), F.array().cast("array<int>")) for d in drivers]))))
    n = F.coalesce(declared, F.lit(YEARS)) if declared is not None else F.lit(YEARS)
    return F.when(F.size(union) > 0, union).otherwise(F.sequence(last_year + 1, last_year + n))


def scenario_inputs(reports: DataFrame, fields: list[str]) -> DataFrame:
    """Three rows a report: base as it is, bull and bear with their own fields (structs `bull` and `bear`) over the base's."""
    merged = [F.struct(F.lit(m).alias("scenario"), *[(F.col(f) if m == "base" else F.coalesce(F.col(f"{m}.{f}"), F.col(f))).alias(f) for f in fields]) for m in MODES]
    kept = [c for c in reports.columns if c not in {*fields, "bull", "bear"}]
    return reports.select(*kept, F.explode(F.array(*merged)).alias("_s")).select(*kept, "_s.*")


def project(years: Column, revenue: Column, nwc: Column, nol: Column, tax: Column, nol_use: Column, wacc: Column) -> Column:
    """years: array of struct (growth, ebit_margin, da, capex, nwc), the last four by share of revenue -> struct (years, pv).

    Year by year: revenue grows; tax falls on profit less the losses carried forward that may be used; a loss adds to
    these; cash flow is profit less tax plus depreciation less investment less the growth of working capital.
    """
    d = lambda x: x.cast("double")
    row = lambda fcff, ebitda, pv: F.struct(fcff.alias("fcff"), ebitda.alias("ebitda"), pv.alias("pv"))
    zero = F.lit(0.0)
    start = F.struct(d(revenue).alias("revenue"), d(nwc).alias("nwc"), F.greatest(d(nol), zero).alias("nol"), F.lit(1.0).alias("factor"), F.array().cast("array<struct<fcff:double,ebitda:double,pv:double>>").alias("years"))

    def step(a: Column, y: Column) -> Column:
        now = a["revenue"] * (1 + y["growth"])
        ebit, held = now * y["ebit_margin"], now * y["nwc"]
        used = F.when(ebit > 0, F.least(a["nol"], ebit * nol_use)).otherwise(zero)
        paid = F.when(ebit > 0, (ebit - used) * tax).otherwise(zero)
        left = F.when(ebit > 0, a["nol"] - used).otherwise(a["nol"] - ebit)
        fcff = ebit - paid + now * y["da"] - now * y["capex"] - (held - a["nwc"])
        factor = a["factor"] / (1 + wacc)
        return F.struct(now.alias("revenue"), held.alias("nwc"), left.alias("nol"), factor.alias("factor"), F.concat(a["years"], F.array(row(fcff, ebit + now * y["da"], fcff * factor))).alias("years"))

    return F.aggregate(years, start, step, lambda a: F.struct(a["years"].alias("years"), a["factor"].alias("factor"), F.aggregate(a["years"], zero, lambda s, y: s + y["pv"]).alias("pv")))


def terminal(method: Column, fcff: Column, ebitda: Column, growth: Column, wacc: Column, multiple: Column) -> tuple[Column, Column]:
    """(value, error) by gordon_growth, exit_multiple or the average of both."""
    gordon, leave = fcff * (1 + growth) / (wacc - growth), ebitda * multiple
    error = F.when(method.isin("gordon_growth", "average") & ~(wacc > growth), "growth_not_below_wacc").when(method.isin("exit_multiple", "average") & multiple.isNull(), "missing_exit_multiple")
    value = F.when(method == "gordon_growth", gordon).when(method == "exit_multiple", leave).otherwise((gordon + leave) / 2)
    return F.when(error.isNull(), value), error


def net_debt(override: Column, debt: Column, cash: Column) -> Column:
    return F.coalesce(override, debt - cash)


def investments_adjustment(investments: Column, override: Column, debt: Column, cash: Column) -> Column:
    """Zero where an override of net debt has the investments in it already, within one or one percent."""
    near, net = F.greatest(F.lit(1.0), F.abs(investments) * 0.01), debt - cash
    inside = (F.abs(override - (net - investments)) <= near) & (F.abs(override - net) > near)
    return F.when(F.coalesce(inside, F.lit(False)), 0.0).otherwise(investments)


def prior_claims(rows: DataFrame) -> Column:
    """Minority interest and preferred equity; zero where null or without such a column."""
    return sum((F.coalesce(F.col(n), F.lit(0.0)) for n in ("minority_interest", "preferred_equity") if n in rows.columns), F.lit(0.0))


def valued(scenarios: DataFrame) -> DataFrame:
    """scenarios with ev, terminal_share, equity, per_share, upside and error (rows with an error have null values).

    In: years, revenue0, nwc0, nol, tax_rate, nol_utilization, wacc, terminal_growth, method, exit_multiple,
    net_debt_override, debt, cash, investments, shares, price, and if there are such columns minority_interest and
    preferred_equity (null: zero), which are claims before that of the shares.
    """
    c = F.col
    p = scenarios.withColumn("projection", project(c("years"), c("revenue0"), c("nwc0"), c("nol"), c("tax_rate"), c("nol_utilization"), c("wacc")))
    last = F.try_element_at(c("projection.years"), F.lit(-1))
    value, error = terminal(c("method"), last["fcff"], last["ebitda"], c("terminal_growth"), c("wacc"), c("exit_multiple"))
    p = p.withColumns({"terminal": value, "error": error}).withColumn("_tpv", c("terminal") * c("projection.factor")).withColumn("ev", c("projection.pv") + c("_tpv"))
    equity = c("ev") - net_debt(c("net_debt_override"), c("debt"), c("cash")) + investments_adjustment(c("investments"), c("net_debt_override"), c("debt"), c("cash")) - prior_claims(p)
    p = p.withColumns({"terminal_share": F.try_divide("_tpv", "ev"), "equity": equity}).withColumn("per_share", F.try_divide("equity", "shares"))
    return p.withColumn("upside", F.try_divide("per_share", "price") - 1).drop("_tpv")


def ai_irr(base: DataFrame) -> DataFrame:
    """valued rows with target_ev (price x shares with net debt and prior claims, less investments), ai_irr and irr_flags.

    The rate at which the cash flows, the terminal value added to the last, are worth the present enterprise value.
    """
    c = F.col
    flows = F.transform(c("projection.years"), lambda y: y["fcff"])
    with_end = F.concat(F.slice(flows, 1, F.greatest(F.size(flows) - 1, F.lit(0))), F.array(F.try_element_at(flows, F.lit(-1)) + c("terminal")))
    target = c("price") * c("shares") + net_debt(c("net_debt_override"), c("debt"), c("cash")) - investments_adjustment(c("investments"), c("net_debt_override"), c("debt"), c("cash")) + prior_claims(base)
    out = base.withColumns({"_flows": F.when(c("terminal").isNotNull(), with_end), "target_ev": target})
    out = out.withColumn("ai_irr", implied_rate(c("_flows"), c("target_ev"))).drop("_flows")
    return out.withColumn("irr_flags", flag_list({"missing_scenario": c("projection").isNull() | (F.size("projection.years") == 0), "missing_ai_irr": c("ai_irr").isNull()}))


def mechanical_irr(features: DataFrame, growth: float = 0.03, wacc: float = 0.09, terminal_growth: float = 0.025, years: int = YEARS) -> DataFrame:
    """features (revenue, operating_margin, da_pct, capex_pct, nwc_pct, market_cap, total_debt, cash) with mechanical_irr and mechanical_flags.

    Constant ratios; optional inputs that are missing count as zero and are flagged; without revenue, margin or market
    value the rate is null.
    """
    c, optional = F.col, ["da_pct", "capex_pct", "nwc_pct", "total_debt", "cash"]
    full = features.withColumns({f"_{o}": F.coalesce(c(o), F.lit(0.0)) for o in optional})
    year = F.struct(F.lit(growth).alias("growth"), c("operating_margin").alias("ebit_margin"), c("_da_pct").alias("da"), c("_capex_pct").alias("capex"), c("_nwc_pct").alias("nwc"))
    full = full.withColumn("_p", project(F.array_repeat(year, years), c("revenue"), c("revenue") * c("_nwc_pct"), F.lit(0.0), F.lit(TAX), F.lit(NOL_USE), F.lit(wacc)))
    flows = F.transform(c("_p.years"), lambda y: y["fcff"])
    last = F.try_element_at(flows, F.lit(-1))
    with_end = F.concat(F.slice(flows, 1, years - 1), F.array(last + last * (1 + terminal_growth) / (wacc - terminal_growth)))
    critical = c("revenue").isNotNull() & c("operating_margin").isNotNull() & c("market_cap").isNotNull()
    full = full.withColumns({"_flows": F.when(critical, with_end), "_ev": c("market_cap") + c("_total_debt") - c("_cash")})
    flags = flag_list({**{f"missing_{o}": c(o).isNull() for o in optional}, "missing_critical_input": ~critical})
    return full.withColumns({"mechanical_irr": implied_rate(c("_flows"), c("_ev")), "mechanical_flags": flags}).select(*features.columns, "mechanical_irr", "mechanical_flags")


def mechanical_price(raw_close: Column, current: Column, report: Column) -> Column:
    """Struct of price, source and flags: a raw close, else the unverified current price; a report's price is refused."""
    names = lambda *n: F.array(*[F.lit(x) for x in n]).cast("array<string>")
    row = lambda price, source, flags: F.struct(price.cast("double").alias("price"), F.lit(source).cast("string").alias("source"), flags.alias("flags"))
    none = F.lit(None)
    return (
        F.when(raw_close > 0, row(raw_close, "raw_close_price", names()))
        .when(current > 0, row(current, "legacy_edgar_current_price", names("raw_price_unavailable", "mechanical_price_asof_unverified")))
        .when(report > 0, row(none, None, names("raw_price_unavailable", "report_price_ignored_for_mechanical_dcf")))
        .otherwise(row(none, None, names("missing_price")))
    )


def mechanical_label(records: DataFrame, growth: float = 0.03, wacc: float = 0.09, terminal_growth: float = 0.025, years: int = YEARS) -> DataFrame:
    """records with mechanical_irr, price_source, target_ev and mechanical_flags, from filing figures and a checked price.

    In: revenue, operating_income, operating_margin, shares, raw_close, current_price, report_price, da, capex, cash,
    total_debt. Income is revenue by margin where it is null itself. Depreciation, investment, cash and debt that are null
    count as zero and are flagged; without revenue, income, shares or price there is no rate, and flags say why.
    """
    c, optional = F.col, {"da": "da", "capex": "capex", "cash": "cash", "total_debt": "debt"}
    out = records.withColumns({"_price": mechanical_price(c("raw_close"), c("current_price"), c("report_price")), "_income": F.coalesce(c("operating_income"), c("revenue") * c("operating_margin"))})
    out = out.withColumns({f"_{o}": F.coalesce(c(o), F.lit(0.0)) for o in optional})
    positive = lambda x: F.coalesce(x > 0, F.lit(False))
    lacking = {"revenue": ~positive(c("revenue")), "operating_income": c("_income").isNull(), "shares_outstanding": ~positive(c("shares")), "price": ~positive(c("_price.price"))}
    usable = ~functools.reduce(Column.__or__, lacking.values())
    share = lambda x: F.try_divide(x, c("revenue"))
    year = F.struct(F.lit(growth).alias("growth"), share(c("_income")).alias("ebit_margin"), share(c("_da")).alias("da"), share(F.abs("_capex")).alias("capex"), F.lit(0.0).alias("nwc"))
    out = out.withColumns({"_usable": usable, "_p": project(F.array_repeat(year, years), c("revenue"), F.lit(0.0), F.lit(0.0), F.lit(TAX), F.lit(NOL_USE), F.lit(wacc))})
    flows = F.transform(c("_p.years"), lambda y: y["fcff"])
    last = F.try_element_at(flows, F.lit(-1))
    with_end = F.concat(F.slice(flows, 1, years - 1), F.array(last * (1 + (1 + terminal_growth) / (wacc - terminal_growth))))
    out = out.withColumns({"_flows": F.when(c("_usable"), with_end), "target_ev": F.when(c("_usable"), c("_price.price") * c("shares") + c("_total_debt") - c("_cash")), "price_source": c("_price.source")})
    out = out.withColumn("mechanical_irr", implied_rate(c("_flows"), c("target_ev")))
    flags = flag_list({
        **{f"missing_mechanical_{n}": ok for n, ok in lacking.items()}, **{f"missing_{n}_mechanical": c("_usable") & c(o).isNull() for o, n in optional.items()},
        "mechanical_dcf_error": c("_usable") & c("mechanical_irr").isNull()})
    return out.withColumn("mechanical_flags", F.array_sort(F.array_union(flags, c("_price.flags")))).select(*records.columns, "mechanical_irr", "price_source", "target_ev", "mechanical_flags")


def is_round(values: Column) -> Column:
    """Six forecast figures or more, of which 85 percent are whole percents."""
    whole = F.filter(values, lambda v: F.abs(v * 100 - F.round(v * 100)) < 1e-9)
    return (F.size(values) >= 6) & (F.size(whole) >= 0.85 * F.size(values))


def jumps(values: Column, most: float) -> Column:
    """Whether neighbours differ by more than most."""
    n = F.greatest(F.size(values) - 1, F.lit(0))
    return F.exists(F.zip_with(F.slice(values, 1, n), F.slice(values, 2, n), lambda a, b: F.abs(b - a)), lambda d: d > most)


def out_of_order(bear: Column, base: Column, bull: Column) -> Column:
    return F.coalesce(bear > base, F.lit(False)) | F.coalesce(base > bull, F.lit(False))


def sanity_flags(price: Column, value: Column, upside: Column, ev: Column, terminal_share: Column, shares: Column, implied_shares: Column, wacc: Column, growth: Column, comps: Column, **more: Column) -> Column:
    """Flags of a valued report; more: further flags with their conditions."""
    no = F.lit(False)
    return flag_list({
        "missing_price": price.isNull() | (price <= 0), "nonpositive_ai_value": value.isNull() | (value <= 0), "internal_inconsistency": F.coalesce(F.abs(F.try_divide(value, price) - 1 - upside) > 0.01, no),
        "ev_negative": F.coalesce(ev <= 0, no), "terminal_value_dominates": F.coalesce(F.abs(terminal_share) > 0.85, no),
        "share_count_outlier": shares.isNull() | (shares <= 0) | F.coalesce(F.abs(F.try_divide(implied_shares, shares) - 1) > 0.05, no),
        "missing_wacc": wacc.isNull() | (wacc <= 0), "wacc_terminal_spread_too_small": F.coalesce(wacc - growth <= 0.01, no), "missing_comps": F.coalesce(comps, F.lit(0)) <= 0, **more})


def collection_flags(price: Column, wacc: Column, growth: Column, last_margin: Column, margins: Column, growths: Column, comps: Column, empty_scenario: Column, year_one_gap: Column, values: Column) -> Column:
    """Flags at collection, in the order of the checks."""
    reversal = ((last_margin > 0) & F.exists(margins, lambda m: m < 0)) | ((last_margin < 0) & F.exists(margins, lambda m: m > 0))
    fives = F.filter(values, lambda v: F.abs(v * 20 - F.round(v * 20)) < 1e-9)
    checks = {
        "stale_price": price.isNull() | (price == 0), "wacc_outlier": ~wacc.between(0.04, 0.20), "terminal_growth_outlier": ~growth.between(0.0, 0.05), "margin_reversal": reversal,
        "revenue_explosion": F.exists(growths, lambda g: (g > 0.8) | (g < -0.5)), "missing_comps": comps < 3, "missing_scenarios": empty_scenario, "internal_inconsistency": F.abs(year_one_gap) > 0.05,
        "suspiciously_round": F.size(fives) * 2 > F.size(values)}
    return F.array_compact(F.array(*[F.when(ok, F.lit(name)) for name, ok in checks.items()]))


def label_panel(reports: DataFrame, features: DataFrame, sectors: DataFrame, prices: DataFrame) -> DataFrame:
    """reports (ticker, date, ai_irr, flags) with features, sector (feature's before the map's, with its source), price at
    the report's date and market value (price x shares, else the feature's). All joins are on ticker.

    prices is (ticker, date, raw_close) as of the report dates: one row a report, made by an as-of join.
    """
    f = features.select("ticker", F.col("sector").alias("_fs"), "shares", "market_cap", "mechanical_irr")
    m = sectors.select("ticker", F.col("sector").alias("_ms"))
    rows = reports.join(prices.filter("raw_close > 0"), ["ticker", "date"], "left").join(f, "ticker", "left").join(m, "ticker", "left")
    source = F.when(F.col("_fs").isNotNull(), "features").when(F.col("_ms").isNotNull(), "sector_map").otherwise("missing")
    cap = F.coalesce(F.col("raw_close") * F.col("shares"), F.col("market_cap"))
    return rows.withColumns({"sector": F.coalesce("_fs", "_ms"), "sector_source": source, "market_cap": cap, "label_minus_baseline": F.col("ai_irr") - F.col("mechanical_irr")}).drop("_fs", "_ms")


def weighted_label_panel(reports: DataFrame, records: DataFrame, features: DataFrame, sectors: DataFrame, prices: DataFrame) -> DataFrame:
    """label_panel with the mechanical rate made from filing records (ticker and what mechanical_label takes but raw_close), its
    flags after the report's own, their policy, whether the label is left out, and its weight.

    The rate is that of the record at the report's price, so it belongs to the report's date.
    """
    figures = [c for c in records.columns if c not in ("ticker", "raw_close")]
    priced = reports.join(prices.filter("raw_close > 0"), ["ticker", "date"], "left").join(records.select("ticker", *[F.col(c).alias(f"_r_{c}") for c in figures]), "ticker", "left")
    made = mechanical_label(priced.select("report_id", "ticker", "raw_close", *[F.col(f"_r_{c}").alias(c) for c in figures])).select("report_id", "price_source", "target_ev", F.col("mechanical_irr").alias("_rate"), "mechanical_flags")
    rows = label_panel(reports, features.withColumn("mechanical_irr", F.lit(None).cast("double")), sectors, prices).drop("label_minus_baseline", "mechanical_irr").join(made, "report_id").withColumnRenamed("_rate", "mechanical_irr")
    flags = F.array_union(F.coalesce("flags", F.array().cast("array<string>")), "mechanical_flags")
    out = rows.withColumn("flags", flags)
    left_out = F.arrays_overlap("flags", F.array(*[F.lit(f) for f in EXCLUDE]))
    return out.withColumns({"label_minus_baseline": F.col("ai_irr") - F.col("mechanical_irr"), "flag_policy": flag_policy(F.col("flags")), "excluded": left_out, "label_weight": label_weight(F.col("flags"), EXCLUDE, DOWNWEIGHT)}).drop("mechanical_flags")


def label_summary(panel: DataFrame, labels: list[str], flags: str = "flags") -> DataFrame:
    """(kind, name, n, share): coverage of each label and count of each flag, in one pass over the panel."""
    entry = lambda kind, name, hit: F.struct(F.lit(kind).alias("kind"), name.alias("name"), hit.cast("long").alias("hit"))
    fixed = [entry("total", F.lit("rows"), F.lit(1)), *[entry("coverage", F.lit(c), F.col(c).isNotNull()) for c in labels]]
    raised = F.coalesce(F.transform(flags, lambda f: entry("flag", f, F.lit(1))), F.array().cast("array<struct<kind:string,name:string,hit:bigint>>"))
    counts = panel.select(F.explode(F.concat(F.array(*fixed), raised)).alias("e")).groupBy("e.kind", "e.name").agg(F.sum("e.hit").alias("n"))
    total = F.max(F.when(F.col("kind") == "total", F.col("n"))).over(Window.partitionBy())  # a row for each label and flag
    return counts.withColumn("share", F.try_divide("n", total)).filter("kind <> 'total'")


def tier_comparison(reports: DataFrame, a: str, b: str, values: list[str], order: list[str]) -> DataFrame:
    """Newest report of tiers a and b of each ticker side by side, in one aggregation; tickers lacking one keep nulls."""
    last = lambda t: F.max_by(F.struct(*values), F.when(F.col("tier") == t, F.struct(*order)))
    both = reports.filter(F.col("tier").isin(a, b)).groupBy("ticker").agg(last(a).alias("_a"), last(b).alias("_b"))
    return both.select("ticker", *[F.col(f"_a.{v}").alias(f"{v}_a") for v in values], *[F.col(f"_b.{v}").alias(f"{v}_b") for v in values])


def collection_summary(runs: DataFrame) -> DataFrame:
    """runs (tier, status, cost, flags array) -> by tier: done, failed, skipped, cost and flags in all."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return runs.groupBy("tier").agg(n("done"), n("failed"), n("skipped"), F.sum(num_or_null(F.col("cost"))).alias("cost"), F.sum(F.coalesce(F.size("flags"), F.lit(0))).alias("flags"))
