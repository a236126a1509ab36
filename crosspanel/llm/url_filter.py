"""URL filters: explicit host-and-path rules, and a path-template tree learned from labelled pages.

Everything is DataFrame work. Paths are first reduced to templates (digits and hexadecimal names become `*`) and
counted for each host; the tree is then grown over these counts level by level: below each node, children whose labels
do not differ from those of their siblings together become the wildcard branch, and so do those without labels to tell
by where they are many and rare. A
template is rejected where its smoothed share of bad labels is high.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.llm.common import checkpoint

#: Levels of the tree; what lies deeper is one last segment.
LEVELS = 5
#: A node with more children keeps, of those whose labels tell nothing, only those with this share of its pages.
MANY, SHARE = 20, 0.1
#: Standard errors by which a branch must differ from its siblings to stay apart.
APART = 1.96
#: Pseudo-labels at the overall rate, and the share of bad labels from which a template is rejected.
PRIOR, REJECT = 10.0, 0.5


@dataclass(frozen=True)
class Rule:
    allow: bool
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_host(url: str | Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    rest = _after_scheme(url)
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: str | Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: str | Column) -> Column:
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest fitting rule, null where none fits."""
    text = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        text = F.when(fits, F.lit(r.text)).otherwise(text)
        verdict = F.when(fits, F.lit("allow" if r.allow else "block")).otherwise(verdict)
    return text, verdict


def segments(path: str) -> Column:
    """LEVELS segments; digits and hexadecimal names of eight and more are wildcards; absent ones are empty."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(path), r"[0-9a-f]{8,}(-[0-9a-f]{4,})*", "*"), r"[0-9]+", "*")
    parts = F.split(F.regexp_replace(plain, "^/", ""), "/", LEVELS)
    return F.transform(F.sequence(F.lit(1), F.lit(LEVELS)), lambda i: F.coalesce(F.try_element_at(parts, i), F.lit("")))


def templates(pages: DataFrame) -> DataFrame:
    """pages (host, path, bad: 1, 0 or null) -> (host, raw, template, purity), a row for each host and raw path shape."""
    counts = pages.select("host", segments("path").alias("raw"), "bad").groupBy("host", "raw").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    counts = checkpoint(counts)  # short: a row for each host and path shape
    total = counts.agg(F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
    tree = counts.withColumn("template", F.col("raw"))
    for level in range(1, LEVELS + 1):
        above = F.slice("template", 1, level - 1)
        tree = tree.withColumn("above", above).withColumn("child", F.element_at("template", level))
        children = tree.groupBy("host", "above", "child").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
        node = Window.partitionBy("host", "above")
        children = children.select("host", "above", "child", _wildcard(node).alias("wild"))
        tree = tree.join(children, ["host", "above", "child"])
        changed = F.when(F.col("wild"), F.lit("*")).otherwise(F.col("child"))
        tree = checkpoint(tree.withColumn("template", F.concat("above", F.array(changed), F.slice("template", level + 1, LEVELS))).drop("above", "child", "wild"))
    judged = tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")).crossJoin(F.broadcast(total))  # total is one row
    rate = F.coalesce(F.try_divide("all_bad", "all_labelled"), F.lit(0.0))
    purity = (F.col("bad") + PRIOR * rate) / (F.col("labelled") + PRIOR)
    return tree.select("host", "raw", "template").join(judged.select("host", "template", purity.alias("purity")), ["host", "template"])


def _wildcard(node) -> Column:
    """True for a child that joins the wildcard branch of its node; an absent segment ends a path and stays."""
    many = (F.count("*").over(node) > MANY) & (F.col("n") < SHARE * F.sum("n").over(node))
    others, others_bad = F.sum("labelled").over(node) - F.col("labelled"), F.sum("bad").over(node) - F.col("bad")
    pooled = F.try_divide(F.sum("bad").over(node), F.sum("labelled").over(node))
    gap = F.abs(F.try_divide("bad", "labelled") - F.try_divide(others_bad, others))
    error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), "labelled") + F.try_divide(F.lit(1.0), others)))
    apart = F.coalesce(gap > APART * error, F.lit(False))
    alike = F.coalesce(gap <= APART * error, F.lit(False)) & (F.count("*").over(node) > 1)
    return ((many & ~apart) | alike) & (F.col("child") != "")


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[Rule]) -> DataFrame:
    """pages (page_id, url), labels (page_id, bad 0/1) -> page_id, host, path, rule, verdict, template, purity.

    A fitting rule decides, the longest if several; elsewhere a page whose template's purity is REJECT or more is
    blocked. Null urls and those without `://` have empty host and path and are one template. Rows that repeat a page
    are judged each; several labels of a page count as the worst; without labels nothing is blocked but by rules.
    Other columns are ignored; no rows give no rows.
    """
    worst = labels.groupBy("page_id").agg(F.max("bad").cast("long").alias("bad")).filter("page_id is not null")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url_host("url").alias("host"), url_path("url").alias("path"))
    tree = templates(rows.join(worst, "page_id", "left"))
    found = rows.withColumn("raw", segments("path")).join(tree, ["host", "raw"], "left")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return found.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity")
