"""Column builders: coercion of loose values, guarded arithmetic, small collection functions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(x: Column) -> Column:
    """Six decimals, away from exact half-way values: equal in any engine that computes in doubles."""
    return F.floor(x * 1e6 + 0.5001234567) / 1e6


def norm_ticker(c: Column) -> Column:
    return F.translate(F.upper(F.trim(c)), ".", "-")


def cik10(c: Column) -> Column:
    digits = F.regexp_replace(c.cast("string"), r"[^0-9]", "")
    return F.when(digits != "", F.lpad(digits, 10, "0"))


def num_or_null(c: Column) -> Column:
    """A finite double or null."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def int_or_null(c: Column) -> Column:
    return c.try_cast("int")


def date_or_null(c: Column) -> Column:
    return F.coalesce(F.try_to_date(c, "yyyy-MM-dd"), F.try_to_date(c, "MMMM d, yyyy"))


def safe_div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x evaluated once however often f uses it."""
    return F.get(F.transform(F.array(x), lambda v: f(v)), F.lit(0))


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with the columns, each evaluated once a row: the optimiser copies no expression past a generator."""
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_c")).select(*kept, "_c.*")


def parse_amount(c: Column, ratio: bool = False) -> Column:
    """Text amount: (x) is negative, % and a trailing x go, separators and currency signs too; words for missing give null.

    A percentage is divided by 100, and as a ratio so is a plain number above one in size.
    """

    def number(text: Column) -> Column:
        percent, negative = F.rlike(text, F.lit(r"%\s*\)?$")), F.startswith(text, F.lit("(")) & F.endswith(text, F.lit(")"))
        plain = F.regexp_replace(F.regexp_replace(text, r"[,_\s$€£¥()%]", ""), r"x$", "")
        value = F.when(text.isin("", "n/a", "na", "none", "null", "nan", "-", "--"), None).otherwise(plain.try_cast("double"))
        return F.struct(value.alias("value"), percent.alias("percent"), negative.alias("negative"))

    def signed(n: Column) -> Column:
        value = F.when(n["negative"], -F.abs(n["value"])).otherwise(n["value"])
        return F.when((n["percent"] | (F.abs(n["value"]) > 1)) if ratio else n["percent"], value / 100).otherwise(value)

    return bound(bound(F.lower(F.trim(c.cast("string"))), number), signed)


def annualized(now: Column, later: Column, years: Column) -> Column:
    return F.when((now > 0) & (later > 0) & (years > 0), F.pow(later / now, 1 / years) - 1)


def md_link_url(c: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(F.trim(c), r"^\[[^\]]+\]\((https?://[^)]+)\)$", 1), F.lit("")), c)


def year_map(c: Column) -> Column:
    """JSON object year -> number as a map of the years 1900 to 2500 with finite numbers."""
    loose = F.from_json(c, "map<string,string>")
    typed = F.map_from_entries(F.transform(F.map_entries(loose), lambda e: F.struct(e["key"].try_cast("int"), num_or_null(e["value"]))))
    return F.map_filter(typed, lambda k, v: k.between(1900, 2500) & v.isNotNull())


def latest_ratio(num: Column, den: Column) -> Column:
    year = F.array_max(F.array_intersect(F.map_keys(num), F.map_keys(den)))
    return F.try_divide(F.try_element_at(num, year), F.try_element_at(den, year))


def flags_add(flags: Column, flag: Column | str) -> Column:
    return F.array_union(F.coalesce(flags, F.array().cast("array<string>")), F.array(F.lit(flag) if isinstance(flag, str) else flag))


def fill_years(series: Column, years: Column, default: Column) -> Column:
    """A map with all of years (array of int): series' value, else that of the year before in the list, at first default."""
    start = F.struct(default.cast("double").alias("last"), F.array().cast("array<double>").alias("values"))

    def step(a: Column, year: Column) -> Column:
        value = F.coalesce(F.try_element_at(series, year), a["last"])
        return F.struct(value.alias("last"), F.concat(a["values"], F.array(value)).alias("values"))

    return F.map_from_arrays(years, F.aggregate(years, start, step, lambda a: a["values"]))


def merge_years(base: Column, override: Column, years: Column) -> Column:
    """A map with all of years: override's value, else base's filled forward from its first year's. Null without a base."""
    filled = F.map_values(fill_years(base, years, F.try_element_at(base, F.array_min(F.map_keys(base)))))
    merged = F.zip_with(years, filled, lambda year, value: F.coalesce(F.try_element_at(override, year), value))
    return F.when(F.size(base) > 0, F.map_from_arrays(years, merged))


def missing_fields(names: list[str]) -> Column:
    """Names of the columns that are null, in the order given."""
    return F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in names]))


# Price of a million prompt tokens and of a million output tokens, by tier.
TIER_PRICES = {"cheap": (0.20, 1.25), "full": (2.50, 15.00)}


def llm_cost(tier: Column, prompt: Column, completion: Column, reasoning: Column) -> Column:
    """Cost to six decimals; reasoning counts as output, counts that are null as zero, another tier gives null."""
    n = lambda c: F.coalesce(c, F.lit(0))
    costs = {t: n(prompt) / 1e6 * one + (n(completion) + n(reasoning)) / 1e6 * other for t, (one, other) in TIER_PRICES.items()}
    return F.round(F.coalesce(*[F.when(tier == t, cost) for t, cost in costs.items()]), 6)


# Names that a sector's text may hold, by template; the first template that fits is taken.
SECTOR_NAMES = {
    "software": ["software", "saas", "systems software", "application software", "cloud"],
    "semiconductors": ["semiconductor", "semiconductors", "chip", "chips"],
    "energy": ["energy", "oil", "gas", "exploration", "production", "midstream"],
    "industrials": ["industrial", "industrials", "machinery", "aerospace", "transportation"],
    "healthcare": ["healthcare", "health care", "pharma", "biotech", "medical", "managed care", "medtech"],
    "utilities": ["utility", "utilities", "electric utilities", "multi-utilities", "water utilities"],
    "consumer": ["consumer", "retail", "restaurant", "staples", "discretionary", "brand"],
    "general": ["general", "unknown"],
}


def letters_and_digits(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def sector_template(c: Column) -> Column:
    """Template whose name or other names the text holds, letters and digits only; general for none, empty or null."""
    text = letters_and_digits(c)
    fits = [(key, "|".join(re.sub("[^a-z0-9]+", "", n) for n in (key, *names))) for key, names in SECTOR_NAMES.items()]
    return F.coalesce(*[F.when(text.rlike(pattern), key) for key, pattern in fits], F.lit("general"))
