"""Filing text and model responses: text features, request gates, validation, ingestion in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions.coerce import computed, sector_template
from crosspanel.operators import parts
from crosspanel.operators import text as T

# The features of a response, in order; changes range from -1, all others from 0, up to 1.
FEATURES = [
    "tone_change", "uncertainty_change", "risk_factor_novelty", "management_hedging", "capital_allocation_discipline", "competitive_pressure",
    "pricing_power", "demand_weakness", "supply_chain_stress", "regulatory_pressure", "accounting_aggressiveness", "guidance_credibility",
]
# Keys of a response, and keys that must appear nowhere in it.
KEYS = ["ticker", "filing_accession", "filing_form", "feature_values", "feature_evidence", "quality_flags", "parse_failure_rate"]
FORBIDDEN = ["raw_ai_implied_irr", "mechanical_dcf_implied_irr", "ai_minus_mechanical_irr", "ai_factor_residual", "return", "future_return", "price_target"]
EVIDENCE_KEYS = ["section", "rationale", "short_quote"]
QUOTE_WORDS, SHORT_WORDS = 25, 200


def _words(names: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def text_features(filings: DataFrame, order: list[str], key: str, groups: dict[str, list[str]] = T.TERMS) -> DataFrame:
    """filings (ticker, form, text, status, key and the order columns) -> all but the text, with the twelve FEATURES and flags.

    Changes and novelty are against the previous extracted filing of ticker and form in order; filings that were not
    extracted are left out. Terms of all groups are found in one pass over a text. What is put in order are keys and
    two numbers a filing, in parts, and token sets are joined by key, which tells filings apart.
    """
    some = filings.filter("status = 'extracted'")
    rest = [c for c in filings.columns if c != "text"]
    read = some.select(*rest, T.terms_in(F.col("text"), groups).alias("_found"), T.word_count(F.col("text")).alias("_words"))
    n = {g: T.group_count(F.col("_found"), groups, g) for g in groups}
    dense = {g: T.density(c, F.col("_words")) for g, c in n.items() if not g.endswith("_tone")}
    made = read.select(*rest, "_words", T.tone(n["positive_tone"], n["negative_tone"]).alias("_tone"), *[c.alias(g) for g, c in dense.items()])
    made = parts.checkpointed(made)  # range partitions are chosen by a pass of their own over the rows
    before = parts.previous(made, ["ticker", "form"], order, ["_tone", "uncertainty", key])
    new = T.novelty(some, ["ticker", "form"], order, key).select(F.col(key).alias("_k"), F.col("novelty").alias("risk_factor_novelty"))
    out = before.join(new, before[key] == F.col("_k"), "left")
    out = out.withColumns({"tone_change": F.col("_tone") - F.col("prior__tone"), "uncertainty_change": F.col("uncertainty") - F.col("prior_uncertainty")})
    flags = F.array_compact(F.array(F.when(F.col("_words") < SHORT_WORDS, F.lit("short_text")), F.when(F.col(f"prior_{key}").isNull(), F.lit("missing_prior_text_for_change_features"))))
    return out.select(*rest, *FEATURES, flags.alias("flags"))


def llm_requests(corpus: DataFrame, prompt: str) -> DataFrame:
    """corpus (ticker, accn, form, date_limited_source, download_status, content_hash, path, flags) with request_status, flags and prompt.

    Gates in order: not date-limited, not downloaded, no hash, no path; what passes is ready. prompt has {ticker}, {form} and {accn}.
    """
    gate = F.when(~F.coalesce(F.col("date_limited_source"), F.lit(False)), "blocked_not_date_limited").when(F.coalesce(F.col("download_status"), F.lit("")) != "downloaded", "blocked_not_downloaded")
    gate = gate.when(F.col("content_hash").isNull(), "blocked_missing_hash").when(F.col("path").isNull(), "blocked_missing_path").otherwise("ready")
    out = corpus.withColumn("request_status", gate)
    flags = F.when(F.col("request_status") == "ready", F.col("flags")).otherwise(F.array_union("flags", F.array("request_status")))
    return out.withColumns({"flags": flags, "prompt": F.when(F.col("request_status") == "ready", render(F.lit(prompt), {n: F.col(n) for n in ("ticker", "form", "accn")}))})


def render(template: Column, values: dict[str, Column]) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


def render_prompts(tickers: DataFrame, templates: DataFrame) -> DataFrame:
    """tickers (ticker, sector) joined with templates (sector, template, context lines) by the template whose name or other
    names the sector's text holds; the row of sector `general` serves the rest.

    Templates are one row a sector, so the small side is broadcast.
    """
    fallback = templates.filter("sector = 'general'").select(F.col("template").alias("_t"), F.col("context").alias("_c"))
    named = templates.select(F.col("sector").alias("_named"), "template", "context")
    rows = tickers.join(F.broadcast(named), sector_template(F.col("sector")) == F.col("_named"), "left").crossJoin(F.broadcast(fallback))  # one row
    lines = F.array_join(F.transform(F.coalesce("context", "_c"), lambda c: F.concat(F.lit("- "), c)), "\n")
    return rows.select("ticker", "sector", render(F.coalesce("template", "_t"), {"ticker": F.col("ticker"), "context": lines}).alias("prompt"))


def _object(v: Column) -> Column:
    """A JSON object as a map; null for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def _is(v: Column, *kinds: str) -> Column:
    """Whether a JSON value is of one of the kinds; no value is of none."""
    return F.coalesce(F.rlike(F.schema_of_variant(v), F.lit(f"^({'|'.join(kinds)})")), F.lit(False))


_NUMBER = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")


def _text(v: Column) -> Column:
    return F.when(_is(v, "STRING"), F.try_variant_get(v, "$", "string"))


def _listed(tag: str | Column, found: Column) -> Column:
    tag = F.lit(tag) if isinstance(tag, str) else tag
    return F.when(F.size(found) > 0, F.concat(tag, F.lit(":"), F.array_join(F.array_sort(found), ",")))


def _value_errors(values: Column) -> Column:
    def wrong(f: Column) -> Column:
        v = F.try_element_at(values, f)
        number = F.try_variant_get(v, "$", "double")
        low = F.when(f.endswith("_change"), -1.0).otherwise(0.0)
        bad = F.when(v.isNotNull() & ~_is(v, *_NUMBER, "VOID"), "_not_numeric_or_null").when(_is(v, *_NUMBER) & ~number.between(low, 1.0), "_out_of_range")
        return F.concat(f, bad)

    names = F.map_keys(values)
    sides = F.array(_listed("feature_values_missing", F.array_except(_words(FEATURES), names)), _listed("feature_values_extra", F.array_except(names, _words(FEATURES))))
    return F.concat(sides, F.transform(_words(FEATURES), wrong))


def _evidence_errors(evidence: Column) -> Column:
    def of_item(f: Column, item: Column) -> Column:
        found, quote = _object(item), F.try_element_at(_object(item), F.lit("short_quote"))
        lacking = lambda k: F.when(F.coalesce(_text(F.try_element_at(found, F.lit(k))), F.lit("")) == "", F.concat(f, F.lit(f"_evidence_missing_{k}")))
        told = F.array(
            _listed(F.concat(f, F.lit("_evidence_unexpected_keys")), F.array_except(F.map_keys(found), _words(EVIDENCE_KEYS))), lacking("section"), lacking("rationale"),
            F.when(_is(quote, "STRING") & (F.size(F.split(F.trim(_text(quote)), r"\s+")) > QUOTE_WORDS), F.concat(f, F.lit("_evidence_quote_too_long"))),
            F.when(quote.isNotNull() & ~_is(quote, "STRING", "VOID"), F.concat(f, F.lit("_evidence_quote_not_string"))))
        return F.when(found.isNull(), F.array(F.concat(f, F.lit("_evidence_item_must_be_object")))).otherwise(told)

    def of_feature(f: Column) -> Column:
        v = F.try_element_at(evidence, f)
        items = F.try_variant_get(v, "$", "array<variant>")
        return F.when(~_is(v, "ARRAY"), F.array(F.concat(f, F.lit("_evidence_must_be_list")))).otherwise(F.flatten(F.transform(items, lambda item: of_item(f, item))))

    names = F.map_keys(evidence)
    sides = F.array(_listed("feature_evidence_missing", F.array_except(_words(FEATURES), names)), _listed("feature_evidence_extra", F.array_except(names, _words(FEATURES))))
    return F.concat(sides, F.flatten(F.transform(_words(FEATURES), of_feature)))


def validate(responses: DataFrame, requests: DataFrame) -> DataFrame:
    """responses (response_id, payload JSON text) joined with requests (ticker, accn, form) on the accession -> with status and errors.

    status is valid, invalid or unknown_request. A payload is parsed once into typed values, so that a number in
    quotes is no number; each level is a column of its own. errors name the feature at fault; forbidden keys are looked for at every depth.
    """
    none = F.array().cast("array<string>")
    top = lambda k: F.try_element_at("_top", F.lit(k))
    plain = lambda k: F.try_variant_get(top(k), "$", "string")
    read = computed(responses, {"_top": _object(F.try_parse_json("payload"))})
    read = computed(read, {"accn": plain("filing_accession"), "_values": _object(top("feature_values")), "_evidence": _object(top("feature_evidence"))})
    known = requests.select(F.col("accn").alias("accn"), F.col("ticker").cast("string").alias("_ticker"), F.col("form").alias("_form"))
    rows = read.join(known, "accn", "left")
    keys, rate, flags = F.map_keys("_top"), top("parse_failure_rate"), top("quality_flags")
    share = F.try_variant_get(rate, "$", "double")
    anywhere = F.array_intersect(F.regexp_extract_all("payload", F.lit(r'"([^"\\]+)"\s*:'), F.lit(1)), _words(FORBIDDEN))
    differs = lambda k, own: F.when(F.col("_ticker").isNotNull() & (F.coalesce(plain(k), F.lit("None")) != F.coalesce(F.col(own), F.lit("None"))), F.lit(f"{k}_mismatch"))
    words = F.try_variant_get(flags, "$", "array<variant>")
    errors = F.array(
        _listed("unexpected_top_level_keys", F.array_except(keys, _words(KEYS))), _listed("missing_top_level_keys", F.array_except(_words(KEYS), keys)), _listed("forbidden_experiment_c_keys", anywhere),
        differs("ticker", "_ticker"), differs("filing_form", "_form"),
        F.when(~_is(rate, *_NUMBER), F.lit("parse_failure_rate_must_be_number")).when(~share.between(0.0, 1.0), F.lit("parse_failure_rate_out_of_range")),
        F.when(~_is(flags, "ARRAY") | F.exists(words, lambda w: ~_is(w, "STRING")), F.lit("quality_flags_must_be_string_list")),
        F.when(F.col("_values").isNull(), F.lit("feature_values_must_be_object")))
    cited = F.when(F.col("_evidence").isNull(), F.array(F.lit("feature_evidence_must_be_object"))).otherwise(_evidence_errors(F.col("_evidence")))
    found = F.concat(errors, F.when(F.col("_values").isNull(), none).otherwise(_value_errors(F.col("_values"))), cited)
    rows = computed(rows, {"errors": F.when(F.col("_top").isNull(), F.array(F.lit("not_an_object"))).otherwise(F.array_compact(found))})
    status = F.when(F.col("_ticker").isNull(), "unknown_request").when(F.size("errors") > 0, "invalid").otherwise("valid")
    return rows.withColumn("status", status).drop("_ticker", "_form", "_top", "_values", "_evidence")


def feature_panel(validated: DataFrame) -> DataFrame:
    """A row for each valid response with its twelve features as columns."""
    return validated.filter("status = 'valid'").select("response_id", "accn", *[F.get_json_object("payload", f"$.feature_values.{f}").try_cast("double").alias(f) for f in FEATURES])


def request_status(requests: DataFrame, validated: DataFrame) -> DataFrame:
    """requests with extraction_status: valid if any response was, else invalid, else not_run. One aggregation and one join on accn."""
    best = validated.filter("accn is not null").groupBy("accn").agg(F.max(F.when(F.col("status") == "valid", 1).otherwise(0)).alias("_ok"))
    status = F.when(F.col("_ok") == 1, "valid").when(F.col("_ok") == 0, "invalid").otherwise("not_run")
    return requests.join(best, "accn", "left").withColumn("extraction_status", status).drop("_ok")


def summaries(rows: DataFrame, by: list[str], flags: str) -> DataFrame:
    """(kind, name, n): counts by each column and by flag."""
    one = F.array(*[F.struct(F.lit(b).alias("kind"), F.col(b).cast("string").alias("name")) for b in by])
    flagged = F.transform(flags, lambda f: F.struct(F.lit("flag").alias("kind"), f.alias("name")))
    return rows.select(F.explode(F.concat(one, F.coalesce(flagged, F.array().cast("array<struct<kind:string,name:string>>")))).alias("e")).groupBy("e.kind", "e.name").agg(F.count("*").alias("n"))


def readiness(requests: DataFrame) -> DataFrame:
    """(blocker, n): what keeps the experiment from running; no rows when it can."""
    counts = requests.agg(F.count("*").alias("total"), F.count(F.when(F.col("request_status") == "ready", 1)).alias("ready"), F.count(F.when(F.col("request_status") == "blocked_not_downloaded", 1)).alias("waiting"))
    checks = F.array_compact(F.array(
        F.when(F.col("total") == 0, F.struct(F.lit("no_requests").alias("blocker"), F.lit(0).cast("long").alias("n"))),
        F.when(F.col("ready") == 0, F.struct(F.lit("nothing_ready").alias("blocker"), F.col("total").alias("n"))),
        F.when(F.col("waiting") > 0, F.struct(F.lit("not_downloaded").alias("blocker"), F.col("waiting").alias("n")))))
    return counts.select(F.explode(checks).alias("c")).select("c.blocker", "c.n")
