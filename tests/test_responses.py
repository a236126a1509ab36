"""Responses: validation, the stream against the batch, sources and sinks."""

import json

import pytest

from crosspanel.operators import responses as O
from crosspanel.sources import files
from crosspanel.streaming import responses as S


def payload(accn="A1", ticker="T", **changes):
    body = {
        "ticker": ticker, "filing_accession": accn, "filing_form": "10-K", "feature_values": {f: 0.5 for f in O.FEATURES}, "feature_evidence": {f: [] for f in O.FEATURES},
        "quality_flags": [], "parse_failure_rate": 0.0}
    return json.dumps(body | changes)


@pytest.fixture
def requests(spark):
    return spark.createDataFrame([("T", "A1", "10-K"), ("T", "A2", "10-K")], "ticker string, accn string, form string")


def cited(**changes):
    return {f: [] for f in O.FEATURES} | changes


CASES = {
    1: (payload(), "valid", []),
    2: (payload(feature_values={f: None for f in O.FEATURES}), "valid", []),
    3: (payload(feature_values={f: -0.5 for f in O.FEATURES}), "invalid", [f"{f}_out_of_range" for f in O.FEATURES if not f.endswith("_change")]),
    4: (payload(feature_values={f: "x" for f in O.FEATURES[:1]}), "invalid", [f"feature_values_missing:{','.join(sorted(O.FEATURES[1:]))}", "tone_change_not_numeric_or_null"]),
    5: (payload(feature_evidence=cited(tone_change=[{"section": "1", "rationale": "r", "return": 1}])), "invalid", ["forbidden_experiment_c_keys:return", "tone_change_evidence_unexpected_keys:return"]),
    6: (payload(accn="B"), "unknown_request", []),
    7: (payload(ticker="X", parse_failure_rate=2), "invalid", ["ticker_mismatch", "parse_failure_rate_out_of_range"]),
    8: ("[1, 2]", "unknown_request", ["not_an_object"]),
    9: (payload(feature_evidence=cited(pricing_power=[{"section": "1", "short_quote": "w " * 26}])), "invalid", ["pricing_power_evidence_missing_rationale", "pricing_power_evidence_quote_too_long"]),
    10: ("not json", "unknown_request", ["not_an_object"]),
    11: (None, "unknown_request", ["not_an_object"]),
    12: (payload(feature_evidence=cited(tone_change="no", demand_weakness=[3, {"section": "", "rationale": "r", "short_quote": 5}])), "invalid", ["tone_change_evidence_must_be_list", "demand_weakness_evidence_item_must_be_object", "demand_weakness_evidence_missing_section", "demand_weakness_evidence_quote_not_string"]),
    13: (payload(feature_evidence=[], feature_values=3, quality_flags=["a", 1], parse_failure_rate=True), "invalid", ["parse_failure_rate_must_be_number", "quality_flags_must_be_string_list", "feature_values_must_be_object", "feature_evidence_must_be_object"]),
    14: (payload(feature_values={f: 0.5 for f in O.FEATURES} | {"other": 1}, feature_evidence={f: [] for f in O.FEATURES[1:]} | {"more": []}), "invalid", ["feature_values_extra:other", "feature_evidence_missing:tone_change", "feature_evidence_extra:more", "tone_change_evidence_must_be_list"]),
    15: (payload(feature_evidence=cited(tone_change=[{"section": "1", "rationale": "r", "short_quote": None}]), feature_values={f: True for f in O.FEATURES[:1]} | {f: 0 for f in O.FEATURES[1:]}), "invalid", ["tone_change_not_numeric_or_null"]),
}


def test_validation(spark, requests):
    rows = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], "response_id int, payload string")
    got = {r.response_id: (r.status, r.errors) for r in O.validate(rows, requests).collect()}
    assert got == {k: v[1:] for k, v in CASES.items()}


def test_status_and_panel(spark, requests):
    rows = spark.createDataFrame([(1, payload()), (2, payload(ticker="X"))], "response_id int, payload string")
    v = O.validate(rows, requests)
    assert {r.accn: r.extraction_status for r in O.request_status(requests, v).collect()} == {"A1": "valid", "A2": "not_run"}
    assert [r.tone_change for r in O.feature_panel(v).collect()] == [0.5]


def test_stream_drops_repeated_ids_and_equals_the_batch(spark, requests, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    record = lambda i, body: json.dumps({"response_id": i, "received": "2026-01-01 00:00:00", "response_json": body})
    (source / "a.jsonl").write_text("\n".join([record("r1", payload()), "", record("r1", payload()), record("r2", payload(ticker="X"))]))

    def run():
        stream = S.ingest(S.response_stream(spark, str(source)), requests)
        S.start(stream, str(out / "valid"), str(out / "bad"), str(tmp_path / "state"), once=True).awaitTermination(120)

    run()
    (source / "b.jsonl").write_text("\n".join([record("r2", payload()), record("r3", payload(accn="A2"))]))
    run()
    valid, bad = (sorted(r.response_id for r in spark.read.parquet(str(out / n)).collect()) for n in ("valid", "bad"))
    assert valid == ["r1", "r3"] and bad == ["r2"]


def test_request_gates(spark):
    rows = [("A", False, "downloaded", "h", "p"), ("B", True, "failed", None, None), ("C", True, "downloaded", None, None), ("D", True, "downloaded", "h", None), ("E", True, "downloaded", "h", "p"), ("F", None, None, None, None)]
    df = spark.createDataFrame([("T", a, "10-K", *rest, []) for a, *rest in rows], "ticker string, accn string, form string, date_limited_source boolean, download_status string, content_hash string, path string, flags array<string>")
    got = {r.accn: (r.request_status, r.prompt) for r in O.llm_requests(df, "{accn} of {ticker}").collect()}
    assert got["E"] == ("ready", "E of T") and [got[k][0].removeprefix("blocked_") for k in "ABCDF"] == ["not_date_limited", "not_downloaded", "missing_hash", "missing_path", "not_date_limited"]
    assert got["A"][1] is None


def test_reports_and_lines(spark, tmp_path):
    (tmp_path / "brk.b_2026-03-20_full.json").write_text('{"x": 1}')
    (tmp_path / "other.json").write_text('{"ticker": "aa", "_meta": {"generated_at": "2026-01-02T03:04:05"}}')
    (tmp_path / "bad.json").write_text("[1")
    got = {(r.ticker, str(r.date)) for r in files.read_reports(spark, str(tmp_path)).collect()}
    assert got == {("BRK-B", "2026-03-20"), ("AA", "2026-01-02")}
    (tmp_path / "r.jsonl").write_text('{"response_json": "{\\"a\\": 1}"}\n\n{"response": {"b": 2}}\n{"c": 3}\n7\n')
    assert [r.payload and json.loads(r.payload) for r in files.read_responses_jsonl(spark, str(tmp_path / "r.jsonl")).collect()] == [{"a": 1}, {"b": 2}, {"c": 3}, None]


def test_artifacts_keep_columns_when_empty(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a"])], "k int, flags array<string>")
    files.write_artifact(df, str(tmp_path / "x.csv"))
    assert files.read_table(spark, str(tmp_path / "x.csv")).collect() == [(1, '["a"]')]
    files.write_artifact(df.limit(0), str(tmp_path / "y"))
    assert files.read_table(spark, str(tmp_path / "y")).columns == ["k", "flags"]


def test_prices_never_fall_back_to_adjusted(spark):
    df = spark.createDataFrame([("2026-01-02", "a.b", None, 3.0), ("2026-01-05", "a.b", 4.0, None)], "date string, ticker string, close double, adj_close double")
    assert [tuple(r)[2:] for r in files.prices_long(df).orderBy("date").collect()] == [(None, 3.0), (4.0, 4.0)]


def test_nested_tables_are_passed_over(spark):
    html = "<table id=t><tr><th>A b</th><th>C[1]</th></tr><tr><td>x <table><tr><td>in</td></tr></table></td></tr></table>"
    got = files.extract_html_tables(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string"), "t").collect()
    assert len(got) == 1 and got[0].cells["c"] == ""
