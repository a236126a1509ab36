"""Sources and sinks: reports, response lines, tables, company facts as JSON, ticker lists, HTML tables, artifacts."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crosspanel.functions.coerce import date_or_null, norm_ticker

FACT = "struct<val:string,end:string,start:string,filed:string,accn:string,fy:string,form:string>"


def flatten_company_facts(documents: DataFrame, specs: DataFrame) -> DataFrame:
    """documents (ticker, json: taxonomy -> tag -> units -> unit -> facts) and specs (taxonomy, tag, field, rank) -> typed facts.

    Facts whose value is no number are dropped; specs is a small fixed list, so it is broadcast.
    """
    tags = documents.select("ticker", F.explode(F.from_json(F.get_json_object("json", "$.facts"), f"map<string,map<string,struct<units:map<string,array<{FACT}>>>>>")).alias("taxonomy", "tags"))
    units = tags.select("ticker", "taxonomy", F.explode("tags").alias("tag", "body")).join(F.broadcast(specs), ["taxonomy", "tag"])
    one = units.select("ticker", "taxonomy", "field", "rank", F.explode("body.units").alias("unit", "facts")).select("ticker", "taxonomy", "field", "rank", "unit", F.explode("facts").alias("f"))
    day = lambda c: date_or_null(F.col(c))
    return one.select("ticker", "taxonomy", "field", "rank", "unit", F.col("f.val").try_cast("double").alias("value"), day("f.start").alias("start"), day("f.end").alias("end"), day("f.filed").alias("filed"), "f.accn", F.col("f.fy").try_cast("int").alias("fy"), "f.form").filter("value is not null")


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """(ticker, date, payload) of every *.json that holds an object; ticker and date come from the payload, else from the file's name, else from its metadata."""
    files = spark.read.text(f"{folder}/*.json", wholetext=True).select("value", F.col("_metadata.file_name").alias("name"))
    at = lambda p: F.get_json_object("value", p)
    named = lambda k: F.nullif(F.regexp_extract("name", r"^([A-Za-z.\-]+)_(\d{4}-\d{2}-\d{2})", k), F.lit(""))
    objects = files.filter(F.json_object_keys("value").isNotNull())
    return objects.select(norm_ticker(F.coalesce(at("$.ticker"), named(1))).alias("ticker"), F.coalesce(date_or_null(named(2)), date_or_null(F.substring(at("$._meta.generated_at"), 1, 10))).alias("date"), F.col("value").alias("payload"))


def read_responses_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(payload) of every line that is not blank: response_json, else response, else the record; null where that is no object."""
    lines = spark.read.text(path).filter("trim(value) <> ''")
    payload = F.coalesce(F.get_json_object("value", "$.response_json"), F.get_json_object("value", "$.response"), F.col("value"))
    return lines.select(F.when(F.json_object_keys(payload).isNotNull(), payload).alias("payload"))


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header for paths that end in .csv (give a schema to spare a pass over the data), else Parquet."""
    if path.endswith(".csv"):
        return (spark.read.schema(schema) if schema else spark.read.option("inferSchema", True)).option("header", True).csv(path)
    return spark.read.parquet(path)


def write_artifact(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet, or CSV for paths that end in .csv with nested columns as JSON; an empty table keeps its columns."""
    if not path.endswith(".csv"):
        df.write.mode("overwrite").parquet(path, partitionBy=partition_by)
        return
    nested = {f.name: F.to_json(f.name) for f in df.schema if f.dataType.typeName() in ("array", "map", "struct")}
    df.withColumns(nested).write.mode("overwrite").csv(path, header=True)


def prices_long(wide: DataFrame) -> DataFrame:
    """wide (date, ticker, close, adj_close) -> (ticker, date, raw_close, adjusted_close): adjusted falls back to close, raw never to adjusted."""
    return wide.select(norm_ticker(F.col("ticker")).alias("ticker"), F.to_date("date").alias("date"), F.col("close").cast("double").alias("raw_close"), F.coalesce(F.col("adj_close"), F.col("close")).cast("double").alias("adjusted_close"))


def sectioned_lines(lines: DataFrame) -> DataFrame:
    """lines (file, line_no, value): `#` comments of four words at most and without a colon open a section; the rest are tickers, the first of each kept."""
    value = F.trim("value")
    comment = F.trim(F.regexp_replace(value, "^#+", ""))
    opens = value.startswith("#") & ~comment.contains(":") & (F.size(F.split(comment, r"\s+")) <= 4) & (comment != "")
    w = Window.partitionBy("file").orderBy("line_no")
    marked = lines.withColumn("section", F.last(F.when(opens, comment), ignorenulls=True).over(w)).filter(~value.startswith("#") & (value != ""))
    rows = marked.withColumn("ticker", norm_ticker(F.trim(F.split(value, "#")[0])))
    return rows.groupBy("file", "ticker").agg(F.min_by("section", "line_no").alias("section"), F.min("line_no").alias("line_no"))


class _Cells(HTMLParser):
    """Rows of cell texts of the table with an id, or of all tags of a kind when it has none."""

    def __init__(self, table_id: str):
        super().__init__()
        self.table_id, self.depth, self.rows, self.cell = table_id, 0, [], None

    def handle_starttag(self, tag, attrs):
        if tag == "table" and (self.depth or dict(attrs).get("id") == self.table_id):
            self.depth += 1
        elif self.depth == 1 and tag == "tr":
            self.rows.append([])
        elif self.depth == 1 and tag in ("td", "th") and self.rows:
            self.cell = []

    def handle_endtag(self, tag):
        if tag == "table" and self.depth:
            self.depth -= 1
        elif self.depth == 1 and tag in ("td", "th") and self.cell is not None:
            self.rows[-1].append("".join(self.cell))
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def extract_html_tables(pages: DataFrame, table_id: str) -> DataFrame:
    """pages (page_id, html) -> (page_id, row_no, cells map): the rows of the table under normalised header names, short rows padded with ''."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for page, html in zip(b["page_id"], b["html"], strict=True):
                parser = _Cells(table_id)
                parser.feed(html or "")
                out += [(page, i, row) for i, row in enumerate(r for r in parser.rows if r)]
            yield pd.DataFrame(out, columns=["page_id", "row_no", "cells"])

    raw = pages.select("page_id", "html").mapInPandas(run, "page_id long, row_no int, cells array<string>")
    clean: Column = F.transform("cells", lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"\[[^\]]*\]", ""), r"\s+", " ")))
    rows = raw.withColumn("cells", clean)
    head = rows.filter("row_no = 0").select("page_id", F.transform("cells", lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")).alias("header"))
    padded = F.transform("header", lambda h, i: F.struct(h.alias("key"), F.coalesce(F.get(F.col("cells"), i), F.lit("")).alias("value")))
    return rows.filter("row_no > 0").join(head, "page_id").select("page_id", "row_no", F.map_from_entries(padded).alias("cells"))


def clean_llm_content(responses: DataFrame) -> DataFrame:
    """responses (response_id, body JSON) with content (first choice's text), object (first decodable JSON object in it) and warnings.

    Content may be a string, an object with text or value, or a list of these. Rows without an object have the reason as `failure`.
    """
    raw = F.get_json_object("body", "$.choices[0].message.content")
    part = "array<struct<text:string,value:string>>"
    parts = F.array_join(F.transform(F.from_json(raw, part), lambda p: F.coalesce(p["text"], p["value"], F.lit(""))), "")
    text = F.when(raw.startswith("["), parts).otherwise(F.coalesce(F.get_json_object(raw, "$.text"), F.get_json_object(raw, "$.value"), raw))
    bare = F.regexp_replace(F.regexp_replace(text, r"```[A-Za-z]*", ""), r"^\s+|\s+$", "")
    start = F.locate("{", F.col("_bare"))
    # The parser reads one value and ignores what follows it; where the first brace begins none, later ones are tried.
    read = lambda tail: F.get_json_object(tail, "$")
    first = read(F.substring(F.col("_bare"), start, F.length("_bare")))
    cut = F.split("_bare", r"\{")
    tails = F.transform(F.sequence(F.lit(2), F.size(cut)), lambda i: read(F.concat(F.lit("{"), F.array_join(F.slice(cut, i, F.size(cut)), "{"))))
    later = F.get(F.filter(tails, lambda x: F.json_object_keys(x).isNotNull()), F.lit(0))
    found = F.when(start > 0, F.coalesce(F.when(F.json_object_keys(first).isNotNull(), first), later))
    out = responses.withColumns({"content": text, "_bare": bare}).withColumn("object", found)
    warnings = F.array_compact(F.array(F.when(F.col("content").contains("```"), F.lit("code_fence")), F.when(start > 1, F.lit("leading_text"))))
    failure = F.when(F.col("content").isNull(), "missing_content").when(F.col("object").isNull(), "no_json_object")
    return out.withColumns({"warnings": warnings, "failure": failure}).drop("_bare")
