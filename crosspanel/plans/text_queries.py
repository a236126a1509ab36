"""Queries on filing text, model responses and file-like sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from crosspanel.functions.coerce import settle
from crosspanel.operators import responses as O
from crosspanel.plans.registry import GROUPS, PLAIN_SQL, R, WORD_SQL, count_sql, query
from crosspanel.sources import files, proxy

_DENSE = {g: f"coalesce(least(1.0, {g} * 1000.0 / nullif(words, 0) / 10), 0)" for g in GROUPS if not g.endswith("_tone")}


@query(f"""WITH d AS (SELECT doc_id, source, text, {PLAIN_SQL} AS plain, {WORD_SQL} AS words, list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9_]{{2,}}')) AS tokens FROM documents WHERE text IS NOT NULL),
  n AS (SELECT doc_id, source, words, tokens, {', '.join(f'{count_sql(t)} AS {g}' for g, t in GROUPS.items())} FROM d),
  t AS (SELECT doc_id, source, words, tokens, coalesce((positive_tone - negative_tone) * 1.0 / nullif(positive_tone + negative_tone, 0), 0) AS tone, {', '.join(f'{x} AS {g}' for g, x in _DENSE.items())} FROM n),
  p AS (SELECT *, lag(tone) OVER w AS t0, lag(uncertainty) OVER w AS u0, lag(tokens) OVER w AS k0 FROM t WINDOW w AS (PARTITION BY source ORDER BY doc_id))
  SELECT doc_id, {R('tone - t0')} AS tone_change, {R('uncertainty - u0')} AS uncertainty_change, CASE WHEN k0 IS NOT NULL THEN {R('1 - len(list_intersect(tokens, k0)) * 1.0 / nullif(len(list_distinct(list_concat(tokens, k0))), 0)')} END AS risk_factor_novelty,
    {', '.join(f'{R(g)} AS {g}' for g in _DENSE if g != 'uncertainty')}, concat_ws(',', CASE WHEN words < 200 THEN 'short_text' END, CASE WHEN t0 IS NULL THEN 'missing_prior_text_for_change_features' END) AS flags FROM p""")
def text_features(spark, sf):
    d = proxy.table(spark, sf, "documents")
    filings = d.select("doc_id", F.col("source").alias("ticker"), F.lit("10-K").alias("form"), "text", F.when(F.col("text").isNull(), "failed").otherwise("extracted").alias("status"))
    t = O.text_features(filings, ["doc_id"], "doc_id", GROUPS)
    return t.select("doc_id", *[settle(F.col(c)).alias(c) for c in O.FEATURES], F.array_join("flags", ",").alias("flags"))


_GATE = """CASE WHEN o_orderstatus = 'P' THEN 'blocked_not_date_limited' WHEN o_orderkey % 5 = 0 THEN 'blocked_not_downloaded' WHEN o_orderkey % 7 = 0 THEN 'blocked_missing_hash' WHEN o_orderkey % 11 = 0 THEN 'blocked_missing_path' ELSE 'ready' END"""
_REQ = f"requests AS (SELECT o_custkey AS ticker, 'A' || o_orderkey AS accn, o_orderpriority AS form, o_orderkey AS k, {_GATE} AS request_status FROM orders)"


def requests(spark, sf):
    k = F.col("o_orderkey")
    corpus = proxy.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("ticker"), F.concat(F.lit("A"), k.cast("string")).alias("accn"), F.col("o_orderpriority").alias("form"), k.alias("k"), (F.col("o_orderstatus") != "P").alias("date_limited_source"),
        F.when(k % 5 == 0, "failed").otherwise("downloaded").alias("download_status"), F.when(k % 7 != 0, F.hex(k)).alias("content_hash"), F.when(k % 11 != 0, F.lit("x")).alias("path"), F.array().cast("array<string>").alias("flags"))
    return O.llm_requests(corpus, "Read filing {accn} ({form}) of {ticker}.")


@query(f"WITH {_REQ} SELECT accn, request_status, CASE WHEN request_status = 'ready' THEN '' ELSE request_status END AS flags, CASE WHEN request_status = 'ready' THEN 'Read filing ' || accn || ' (' || form || ') of ' || ticker || '.' END AS prompt FROM requests")
def llm_requests(spark, sf):
    return requests(spark, sf).select("accn", "request_status", F.array_join("flags", ",").alias("flags"), "prompt")


@query(f"WITH {_REQ} SELECT 'request_status' AS kind, request_status AS name, count(*) AS n FROM requests GROUP BY 2 UNION ALL SELECT 'form', form, count(*) FROM requests GROUP BY 2 UNION ALL SELECT 'flag', request_status, count(*) FROM requests WHERE request_status <> 'ready' GROUP BY 2")
def text_summaries(spark, sf):
    return O.summaries(requests(spark, sf), ["request_status", "form"], "flags")


@query(f"WITH {_REQ} SELECT 'not_downloaded' AS blocker, count(*) AS n FROM requests WHERE request_status = 'blocked_not_downloaded' HAVING count(*) > 0")
def readiness(spark, sf):
    return O.readiness(requests(spark, sf))


def _responses(spark, sf):
    """One response an order: a mistake of one kind for some, several for a few, no request for others."""
    k = F.col("o_orderkey")
    when = lambda n, bad, good: F.when(k % n == 0, bad).otherwise(good)

    def value(i: int, f: str):
        right = F.when(k % 9 == i, "2.5").when(k % 10 == i, "null").otherwise(((k + i) % 100 / 100).cast("string"))
        return F.format_string(f'"{f}":%s', when(61, '"0.5"', right) if f == "pricing_power" else right)

    values = F.concat_ws(",", *[value(i, f) for i, f in enumerate(O.FEATURES)])
    item = F.format_string('{"section":"%s","rationale":"r","short_quote":"%s"%s}', when(41, "", "1A"), when(13, F.repeat(F.lit("word "), 26), "a short quote"), when(37, ',"source":"x"', ""))
    others = ",".join(f'"{f}":[]' for f in O.FEATURES[1:-1] if f != "management_hedging")
    evidence = F.format_string(f'"tone_change":[%s],{others},"management_hedging":%s%s', item, when(47, "{}", "[]"), when(43, "", f',"{O.FEATURES[-1]}":[]'))
    body = F.format_string(
        '{"ticker":"%s","filing_accession":"%s","filing_form":"%s","feature_values":{%s},"feature_evidence":{%s},"quality_flags":%s,"parse_failure_rate":%s%s}',
        F.when(k % 19 == 0, "ZZ").otherwise(F.col("o_custkey").cast("string")), F.concat(F.when(k % 23 == 0, "X").otherwise("A"), k.cast("string")), F.col("o_orderpriority"), values, evidence,
        when(53, '"x"', "[]"), F.when(k % 59 == 0, "null").when(k % 29 == 0, "1.5").otherwise("0.1"), when(17, ',"price_target":3', ""))
    return proxy.table(spark, sf, "orders").select(k.alias("response_id"), F.when(k % 31 == 0, "[1]").otherwise(body).alias("payload"))


_BAD = {0: "tone_change", 1: "uncertainty_change", 2: "risk_factor_novelty", 3: "management_hedging", 4: "capital_allocation_discipline", 5: "competitive_pressure", 6: "pricing_power", 7: "demand_weakness", 8: "supply_chain_stress"}
_VALID = f"""v AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 31 = 0 THEN 'not_an_object' ELSE concat_ws(',', CASE WHEN o_orderkey % 17 = 0 THEN 'unexpected_top_level_keys:price_target,forbidden_experiment_c_keys:price_target' END,
    CASE WHEN o_orderkey % 19 = 0 AND o_orderkey % 23 <> 0 THEN 'ticker_mismatch' END, CASE WHEN o_orderkey % 59 = 0 THEN 'parse_failure_rate_must_be_number' WHEN o_orderkey % 29 = 0 THEN 'parse_failure_rate_out_of_range' END, CASE WHEN o_orderkey % 53 = 0 THEN 'quality_flags_must_be_string_list' END,
    {', '.join(f"CASE {'WHEN o_orderkey % 61 = 0 THEN ' + chr(39) + f + '_not_numeric_or_null' + chr(39) if f == 'pricing_power' else ''} WHEN o_orderkey % 9 = {i} THEN '{f}_out_of_range' END" for i, f in _BAD.items())},
    CASE WHEN o_orderkey % 43 = 0 THEN 'feature_evidence_missing:guidance_credibility' END, CASE WHEN o_orderkey % 37 = 0 THEN 'tone_change_evidence_unexpected_keys:source' END, CASE WHEN o_orderkey % 41 = 0 THEN 'tone_change_evidence_missing_section' END,
    CASE WHEN o_orderkey % 13 = 0 THEN 'tone_change_evidence_quote_too_long' END, CASE WHEN o_orderkey % 47 = 0 THEN 'management_hedging_evidence_must_be_list' END, CASE WHEN o_orderkey % 43 = 0 THEN 'guidance_credibility_evidence_must_be_list' END) END AS errors, o_orderkey % 31 = 0 OR o_orderkey % 23 = 0 AS unknown FROM orders)"""


def _validated(spark, sf):
    return O.validate(_responses(spark, sf), requests(spark, sf))


@query(f"WITH {_VALID} SELECT k AS response_id, CASE WHEN unknown THEN 'unknown_request' WHEN errors <> '' THEN 'invalid' ELSE 'valid' END AS status, errors FROM v")
def validate_responses(spark, sf):
    return _validated(spark, sf).select("response_id", "status", F.array_join("errors", ",").alias("errors"))


@query(f"WITH {_REQ}, {_VALID} SELECT accn, CASE WHEN unknown THEN 'not_run' WHEN errors <> '' THEN 'invalid' ELSE 'valid' END AS extraction_status FROM requests JOIN v ON v.k = requests.k")
def ingest_responses(spark, sf):
    return O.request_status(requests(spark, sf), _validated(spark, sf)).select("accn", "extraction_status")


@query("""SELECT c_custkey AS ticker, c_mktsegment AS sector, CASE c_mktsegment WHEN 'MACHINERY' THEN 'Study ' || c_custkey || ':' || chr(10) || '- orders' || chr(10) || '- margins' ELSE 'Look at ' || c_custkey || chr(10) || '- growth' END AS prompt FROM customer""")
def render_prompts(spark, sf):
    """Sectors as they are written choose a template by the names it holds."""
    t = spark.createDataFrame([("industrials", "Study {ticker}:\n{context}", ["orders", "margins"]), ("energy", "Drill {ticker}", []), ("general", "Look at {ticker}\n{context}", ["growth"])], "sector string, template string, context array<string>")
    return O.render_prompts(proxy.table(spark, sf, "customer").select(F.col("c_custkey").alias("ticker"), F.col("c_mktsegment").alias("sector")), t)


@query("SELECT o_custkey AS ticker, o_orderkey AS accn, CASE o_orderstatus WHEN 'F' THEN 'revenue' WHEN 'O' THEN 'profit' ELSE 'assets' END AS field, o_totalprice AS value, CAST(o_orderdate AS DATE) AS \"end\" FROM orders WHERE o_orderkey % 5 <> 0")
def flatten_company_facts(spark, sf):
    """A document for each customer, its facts by tag of order status; a figure that is no number is no fact."""
    k = F.col("o_orderkey")
    o = proxy.table(spark, sf, "orders")
    fact = F.struct(F.when(k % 5 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string")).alias("val"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("end"), k.cast("string").alias("accn"))
    tags = o.groupBy("o_custkey", "o_orderstatus").agg(F.struct(F.create_map(F.lit("USD"), F.collect_list(fact)).alias("units")).alias("body"))
    docs = tags.groupBy(F.col("o_custkey").alias("ticker")).agg(F.to_json(F.struct(F.create_map(F.lit("us-gaap"), F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "body")))).alias("facts"))).alias("json"))
    specs = spark.createDataFrame([("us-gaap", "F", "revenue", 0), ("us-gaap", "O", "profit", 0), ("us-gaap", "P", "assets", 0)], "taxonomy string, tag string, field string, rank int")
    return files.flatten_company_facts(docs, specs).select("ticker", F.col("accn").cast("long").alias("accn"), "field", "value", "end")


@query("SELECT n_nationkey AS page_id, CAST(row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) AS INTEGER) AS row_no, CAST(s_suppkey AS VARCHAR) AS symbol, trim(regexp_replace(s_name, '\\s+', ' ', 'g')) AS security, '' AS gicssector FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def extract_html_tables(spark, sf):
    s = proxy.table(spark, sf, "supplier")
    row = F.concat(F.lit("<tr><td>"), F.col("s_suppkey").cast("string"), F.lit("[1]</td><td> "), F.col("s_name"), F.lit(" </td></tr>"))
    body = s.groupBy(F.col("s_nationkey").cast("long").alias("page_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", row.alias("r")))), lambda x: x["r"]), "").alias("rows"))
    head = F.lit("<table id='other'><tr><td>no</td></tr></table><table id='constituents'><tr><th>Symbol</th><th>Security</th><th>GICS&nbsp;Sector</th></tr>")
    t = files.extract_html_tables(body.select("page_id", F.concat(head, "rows", F.lit("</table>")).alias("html")), "constituents")
    return t.select(F.col("page_id").cast("int").alias("page_id"), "row_no", *[F.col("cells")[c].alias(c) for c in ("symbol", "security", "gicssector")])


@query("""SELECT conv_id, turn, text AS content, CASE WHEN turn % 3 = 0 THEN '{"a":' || turn || '}' END AS object, CASE WHEN turn % 3 = 0 THEN 'code_fence' ELSE '' END AS warnings, CASE WHEN turn % 3 <> 0 THEN 'no_json_object' END AS failure FROM (
  SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '```json' || chr(10) || '{"a":' || turn || '} trailing' || chr(10) || '```' ELSE 'plain' END AS text FROM conversations)""")
def clean_llm_content(spark, sf):
    turn = F.col("turn")
    fenced = F.concat(F.lit('```json\n{"a":'), turn.cast("string"), F.lit("} trailing\n```"))
    whole = F.to_json(F.struct(F.array(F.struct(F.struct(F.when(turn % 3 == 0, fenced).otherwise("plain").alias("content")).alias("message"))).alias("choices")))
    listed = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(F.lit("plain").alias("text"))).alias("content")).alias("message"))).alias("choices")))
    c = proxy.table(spark, sf, "conversations").select("conv_id", "turn", F.when(turn % 3 == 2, listed).otherwise(whole).alias("body"))
    return files.clean_llm_content(c).select("conv_id", "turn", "content", "object", F.array_join("warnings", ",").alias("warnings"), "failure")


@query("""WITH p AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) = 1 THEN p_type END AS opens FROM part), s AS (SELECT *, last_value(opens IGNORE NULLS) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS section FROM p)
  SELECT p_brand AS file, upper(replace(trim(p_name), '.', '-')) AS ticker, arg_min(section, p_partkey) AS section, min(p_partkey) * 2 AS line_no FROM s GROUP BY 1, 2""")
def sectioned_lines(spark, sf):
    """Part names of a brand as a list of tickers under sections named by type."""
    p = proxy.table(spark, sf, "part")
    first = F.row_number().over(Window.partitionBy("p_brand", "p_type").orderBy("p_partkey")) == 1
    rows = p.withColumn("_first", first).select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("k"), F.explode(F.when(F.col("_first"), F.array(F.concat(F.lit("# "), "p_type"), F.col("p_name"))).otherwise(F.array("p_name"))).alias("value"))
    lines = rows.withColumn("line_no", F.col("k") * 2 - F.col("value").startswith("#").cast("int"))
    return files.sectioned_lines(lines)
