"""Universe tables: sector map, membership changes, security master, panels of members and their gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosspanel.functions.coerce import cik10, date_or_null, norm_ticker


def sector_map(rows: DataFrame) -> DataFrame:
    """rows (page_id, row_no, cells map by normalised header) -> ticker, sector, sub_industry, cik; rows lacking symbol or sector go, the first of a ticker stays."""
    cell = lambda *names: F.coalesce(*[F.nullif(F.try_element_at("cells", F.lit(n)), F.lit("")) for n in names])
    named = rows.select("page_id", "row_no", norm_ticker(cell("symbol", "ticker", "tickersymbol")).alias("ticker"), cell("gicssector", "sector").alias("sector"), cell("gicssubindustry", "subindustry").alias("sub_industry"), cik10(cell("cik")).alias("cik"))
    some = named.filter("ticker is not null and sector is not null")
    return some.groupBy("ticker").agg(F.min_by(F.struct("sector", "sub_industry", "cik"), F.struct("page_id", "row_no")).alias("r")).select("ticker", "r.*")


def membership_changes(rows: DataFrame) -> DataFrame:
    """rows (row_no, cells array: date, added, name, removed, name, reason) -> (date, ticker, kind, reason, seq); shorter rows and unreadable dates go."""
    day = date_or_null(F.get("cells", F.lit(0)))
    some = rows.filter(F.size("cells") >= 6).withColumn("date", day).filter("date is not null")
    each = F.explode(F.array(*[F.struct(F.get("cells", F.lit(i)).alias("raw"), F.lit(kind).alias("kind")) for i, kind in ((1, "added"), (3, "removed"))]))
    return some.select("date", "row_no", F.get("cells", F.lit(5)).alias("reason"), each.alias("e")).filter("trim(e.raw) <> ''").select("date", norm_ticker(F.col("e.raw")).alias("ticker"), "e.kind", "reason", F.col("row_no").alias("seq"))


def _sector(first: Column, second: Column, section: Column) -> tuple[Column, Column]:
    source = F.when(first.isNotNull(), "features").when(second.isNotNull(), "sector_map").when(section.isNotNull(), "section").otherwise("missing")
    return F.coalesce(first, second, section), source


def security_master(tickers: DataFrame, ids: DataFrame, features: DataFrame, sectors: DataFrame) -> DataFrame:
    """tickers (ticker, section) with cik, sector and where it comes from: features first, then the map, then the list's section."""
    f, m = features.select("ticker", F.col("sector").alias("_f")), sectors.select("ticker", F.col("sector").alias("_m"))
    rows = tickers.join(ids.select("ticker", "cik"), "ticker", "left").join(f, "ticker", "left").join(m, "ticker", "left")
    sector, source = _sector(F.col("_f"), F.col("_m"), F.col("section"))
    return rows.withColumns({"sector": sector, "sector_source": source}).drop("_f", "_m")


def universe_snapshot(master: DataFrame, changes: DataFrame) -> DataFrame:
    """One row: tickers, shares with cik and sector, span of the change dates, and how many tickers lack an id."""
    share = lambda c: F.avg(F.col(c).isNotNull().cast("double"))
    one = master.agg(F.count("*").alias("tickers"), share("cik").alias("cik_share"), share("sector").alias("sector_share"), F.count(F.when(F.col("cik").isNull(), 1)).alias("unmatched"))
    return one.crossJoin(changes.agg(F.count("*").alias("changes"), F.min("date").alias("first_change"), F.max("date").alias("last_change")))  # one row each


def month_ends(spans: DataFrame) -> DataFrame:
    """spans (first, last), one row -> (date): month ends from the month of first up to last."""
    months = F.explode(F.sequence(F.trunc("first", "month"), F.trunc("last", "month"), F.expr("interval 1 month")))
    return spans.select("last", months.alias("month")).select(F.last_day("month").alias("date"), "last").filter("date <= last").select("date")


def membership_gap(panel: DataFrame, known: DataFrame, ids: DataFrame) -> DataFrame:
    """One row on the members (date, ticker) that the known tickers lack: how many, with and without an id, mean and largest share a month."""
    lacking = panel.join(known.select("ticker").distinct().withColumn("_k", F.lit(1)), "ticker", "left").join(ids.select("ticker").distinct().withColumn("_i", F.lit(1)), "ticker", "left")
    monthly = lacking.groupBy("date").agg(F.avg(F.col("_k").isNull().cast("double")).alias("share")).agg(F.avg("share").alias("mean_share"), F.max("share").alias("max_share"))
    names = lacking.filter("_k is null").groupBy("ticker").agg(F.max("_i").alias("_i")).agg(F.count("*").alias("missing"), F.count("_i").alias("with_id"), F.count(F.when(F.col("_i").isNull(), 1)).alias("without_id"))
    return names.crossJoin(monthly)  # one row each


def add_date_filter(panel: DataFrame, changes: DataFrame) -> DataFrame:
    """panel with added_on and eligible: names that joined after the row's date are not. Names without an addition always are."""
    first = changes.filter("kind = 'added'").groupBy("ticker").agg(F.min("date").alias("added_on"))
    return panel.join(first, "ticker", "left").withColumn("eligible", F.coalesce(F.col("added_on") <= F.col("date"), F.lit(True)))


def gap_by_month(members: DataFrame, covered: DataFrame, dates: DataFrame) -> DataFrame:
    """members (date, ticker) in the months of dates against covered (date, ticker): (month, members, missing, share)."""
    month = F.trunc("date", "month").alias("month")
    wanted = members.select(month, "ticker").join(dates.select(month).distinct(), "month", "left_semi").distinct()
    have = covered.select(month, "ticker").distinct().withColumn("_h", F.lit(1))
    missing = F.count(F.when(F.col("_h").isNull(), 1))
    return wanted.join(have, ["month", "ticker"], "left").groupBy("month").agg(F.count("*").alias("members"), missing.alias("missing"), (missing / F.count("*")).alias("share"))


def add_context(panel: DataFrame, sectors: DataFrame) -> DataFrame:
    """panel with its sector, or the map's where it has none."""
    m = sectors.select("ticker", F.col("sector").alias("_m"))
    return panel.join(m, "ticker", "left").withColumn("sector", F.coalesce("sector", "_m")).drop("_m")


def cross_table(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """(table, value): values of the key that some table has and this one lacks."""
    seen = None
    for name, df in tables.items():
        one = df.select(F.lit(name).alias("table"), F.col(key).cast("string").alias("value")).distinct()
        seen = one if seen is None else seen.unionByName(one)
    names = F.array(*[F.lit(n) for n in tables])
    lacking = seen.groupBy("value").agg(F.collect_set("table").alias("_in")).select("value", F.explode(F.array_except(names, F.col("_in"))).alias("table"))
    return lacking.select("table", "value")


def coverage_window(panel: DataFrame, wanted: DataFrame, first: Column, last: Column, days: int = 7) -> DataFrame:
    """(ticker, reason) of the wanted tickers whose rows do not span first to last within some days: absent, late_start or early_end."""
    spans = panel.groupBy("ticker").agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    reason = F.when(F.col("_a").isNull(), "absent").when(F.datediff("_a", first) > days, "late_start").when(F.datediff(last, "_b") > days, "early_end")
    return wanted.select("ticker").distinct().join(spans, "ticker", "left").select("ticker", reason.alias("reason")).filter("reason is not null")


def replace_unless_empty(df: DataFrame, path: str) -> bool:
    """Overwrite the table at path, but never with an empty result; whether it was written."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").parquet(path)
    return True
