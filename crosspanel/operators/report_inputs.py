"""Valuation reports as JSON text -> typed inputs in one pass, with every reason for which a report cannot be used.

Histories and forecasts are maps of years. A report with reasons is set apart with all of them; the others get their defaults
and a forecast without gaps, and three scenarios with the overrides of bull and bear merged over the base.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from crosspanel.operators.report_json import COLUMNS, DRIVERS, FIGURES, reader
from crosspanel.operators.reports import MODES


def normalized(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """raw with historical, years, forecast (a map without gaps for each driver), base (figures with defaults), bull and bear (years,
    forecast and base of these scenarios), flags and reasons (empty: usable), read from its JSON text.

    Years are all those that the forecast names, without any the declared number (five) after the last common year of
    revenue and profit. Gaps take the year before's value; before the first stand zero growth, the target or latest
    margin, and the latest ratios to revenue. A zero that is given stays zero. Rows with reasons have null in all of these but historical.
    An override's year counts where it has a value; years of its own are added, with the other drivers carried on. Maps are in the order of years.
    """
    rows = raw.mapInArrow(reader(payload), StructType([*raw.schema.fields, *StructType.fromDDL(", ".join(f"{n} {t}" for n, t in COLUMNS.items())).fields]))
    top = F.from_json(payload, "map<string,string>")
    text = [F.nullif(F.trim(F.try_element_at(top, F.lit(n))), F.lit("")).alias(n) for n in ("company_name", "ticker", "currency") if n not in raw.columns]
    return rows.select(*raw.columns, *text, *COLUMNS)


def split(normal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The usable reports, and the others with their reasons alone."""
    own = [c for c in normal.columns if c not in COLUMNS]
    return normal.filter(F.size("reasons") == 0).drop("reasons"), normal.filter(F.size("reasons") > 0).select(*own, "reasons")


def scenarios(usable: DataFrame) -> DataFrame:
    """Three rows a report: scenario, years, forecast and base, those of bull and bear merged over the report's."""

    def one(mode: str) -> Column:
        of = "" if mode == "base" else f"{mode}."
        return F.struct(F.lit(mode).alias("scenario"), *[F.col(f"{of}{n}").alias(n) for n in ("years", "forecast", "base")])

    kept = [n for n in usable.columns if n not in ("years", "forecast", "base", "bull", "bear")]
    return usable.select(*kept, F.explode(F.array(*[one(m) for m in MODES])).alias("_s")).select(*kept, "_s.*")


def for_projection(rows: DataFrame) -> DataFrame:
    """scenarios as operators.reports.valued takes them: yearly structs, the last revenue and working capital, figures by name."""
    year = lambda y: F.struct(*[F.try_element_at(F.col(f"forecast.{d}"), y).alias(n) for d, n in zip(DRIVERS, ("growth", "ebit_margin", "da", "capex", "nwc"), strict=True)])
    h = lambda n: F.col(f"historical.{n}.values")
    at = F.array_max(F.map_keys(h("revenue")))
    names = {"nol_balance": "nol", "nol_utilization_pct": "nol_utilization", "terminal_exit_ebitda_multiple": "exit_multiple", "terminal_method": "method", "diluted_shares": "shares", "current_price": "price"}
    kept = [n for n in rows.columns if n not in ("historical", "years", "forecast", "base")]
    return rows.select(
        *kept, F.transform("years", year).alias("years"), F.try_element_at(h("revenue"), at).alias("revenue0"), F.coalesce(F.try_element_at(h("nwc"), at), F.lit(0.0)).alias("nwc0"),
        *[F.col(f"base.{f}").alias(names.get(f, f)) for f in (*FIGURES, "terminal_method")])
