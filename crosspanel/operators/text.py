"""Text features of filings as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosspanel.operators import parts


# The terms of each group.
TERMS = {
    "positive_tone": ["improved", "increase", "growth", "strong demand", "expanded margin", "record", "favorable", "resilient"],
    "negative_tone": ["decline", "decrease", "weakness", "adverse", "impairment", "challenging", "deterioration", "unfavorable"],
    "uncertainty": ["uncertain", "uncertainty", "may adversely", "could adversely", "unable to predict", "volatile", "risk", "risks"],
    "management_hedging": ["may", "could", "might", "believe", "expect", "intend", "estimate", "subject to"],
    "capital_allocation_discipline": ["return capital", "share repurchase", "dividend", "capital allocation", "disciplined investment", "free cash flow"],
    "competitive_pressure": ["competitive", "competition", "pricing pressure", "market share", "new entrants", "substitute products"],
    "pricing_power": ["price increase", "pricing power", "favorable pricing", "price realization", "premium", "mix shift"],
    "demand_weakness": ["demand weakness", "lower demand", "soft demand", "reduced demand", "volume decline", "customer destocking"],
    "supply_chain_stress": ["supply chain", "supplier disruption", "shortage", "logistics", "inventory constraints", "lead times"],
    "regulatory_pressure": ["regulatory", "regulation", "litigation", "compliance", "antitrust", "government investigation"],
    "accounting_aggressiveness": ["material weakness", "restatement", "internal control", "non-gaap", "adjusted ebitda", "critical accounting estimate"],
    "guidance_credibility": ["guidance", "outlook", "forecast", "expects", "reaffirm", "withdrew guidance", "updated guidance"],
}
_EDGE = r"[\p{L}\p{N}_]"


def terms_in(text: Column, groups: dict[str, list[str]]) -> Column:
    """All terms of all groups that stand in the text as whole words, in one pass: at each word the longest that begins there.

    The terms that begin a longer one (`may` in `may adversely`) are counted with it by group_count.
    """
    every = sorted({t.lower() for terms in groups.values() for t in terms if t}, key=lambda t: (-len(t), t))
    # By first letter, so that most words are given up after one comparison for each letter.
    letters = {t[0]: [s[1:] for s in every if s[0] == t[0]] for t in every}
    some = "|".join(rf"\Q{c}\E(?:{'|'.join(rf'\Q{rest}\E' for rest in rests)})" for c, rests in sorted(letters.items()))
    return F.regexp_extract_all(F.lower(text), F.lit(rf"(?<!{_EDGE})(?=({some})(?!{_EDGE}))"), F.lit(1))


def group_count(found: Column, groups: dict[str, list[str]], group: str) -> Column:
    """Occurrences of a group's terms among the terms found in a text."""
    every, own = {t.lower() for terms in groups.values() for t in terms}, [t.lower() for t in groups[group]]
    wordy = re.compile(r"\w")
    begins = lambda t, long: t == long or long.startswith(t) and not wordy.match(long[len(t)])
    weight = {long: sum(begins(t, long) for t in own) for long in every}

    def times(n: int) -> Column:
        those = [long for long, w in weight.items() if w == n]
        return n * F.size(F.filter(found, lambda t: t.isin(those)))

    return sum((times(n) for n in sorted({w for w in weight.values() if w})), F.lit(0))


def keyword_count(text: Column, terms: list[str]) -> Column:
    """Whole-word occurrences of the terms, lower-cased; a word ends at anything but letters, digits and `_`."""
    groups = {"all": terms}
    return group_count(terms_in(text, groups), groups, "all")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[A-Za-z][A-Za-z0-9_'-]*"))


def density(count: Column, words: Column) -> Column:
    """Ten occurrences in a thousand words are one, the most; zero without words."""
    return F.coalesce(F.least(F.lit(1.0), F.try_divide(count * 1000.0, words) / 10), F.lit(0.0))


def tone(positive: Column, negative: Column) -> Column:
    return F.coalesce(F.try_divide(positive - negative, positive + negative), F.lit(0.0))


def token_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z0-9_]{2,}"), F.lit(0)))


def novelty(docs: DataFrame, by: list[str], order: list[str], key: str, text: str = "text") -> DataFrame:
    """(key, prior_<key>, novelty): how new the tokens of each text are against those of the text before it in order.

    Only keys are put in order (in parts, so that a hot `by` is no single task); token sets are joined to them by key, which
    tells rows apart. Null without a prior text or without tokens in both.
    """
    prior = parts.previous(docs.select(*dict.fromkeys([*by, *order, key])), by, order, [key]).select(key, f"prior_{key}")
    tokens = docs.select(F.col(key).alias("_k"), token_set(F.col(text)).alias("_t"))
    now = prior.join(tokens, prior[key] == F.col("_k")).drop("_k").withColumnRenamed("_t", "_now")
    both = now.join(tokens.withColumnRenamed("_t", "_then"), F.col(f"prior_{key}") == F.col("_k"), "left")
    return both.select(key, f"prior_{key}", jaccard_novelty(F.col("_now"), F.col("_then")).alias("novelty"))


def jaccard_novelty(tokens: Column, prior: Column) -> Column:
    return 1 - F.try_divide(F.size(F.array_intersect(tokens, prior)), F.size(F.array_union(tokens, prior)))
