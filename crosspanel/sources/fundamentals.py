"""The driver tables as company facts with accessions, and as one row of fundamentals per company."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosspanel.functions.coerce import settle
from crosspanel.sources.proxy import table

FIELDS = ["revenue", "net_income", "total_assets", "long_debt", "short_debt", "tangible", "intangible", "cost"]


def company_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly facts of each supplier, three candidates a field; the fourth quarter's filing is the 10-K."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    price, when = F.col("l_extendedprice"), F.when
    total = lambda x: settle(F.sum(x))
    sums = l.groupBy(F.col("l_suppkey").alias("ticker"), F.trunc("l_shipdate", "quarter").alias("start"), (F.ascii("l_returnflag") - 65).alias("rank")).agg(
        total(price).alias("revenue"), total(price * F.col("l_discount")).alias("net_income"), total(F.col("l_quantity") * 1000).alias("total_assets"),
        total(when(F.col("l_linestatus") == "F", price * F.col("l_tax"))).alias("long_debt"), total(when(F.col("l_linestatus") == "O", price * F.col("l_tax"))).alias("short_debt"),
        total(when(F.col("l_quantity") > 25, F.col("l_quantity"))).alias("tangible"), total(when(F.col("l_quantity") <= 5, F.col("l_quantity"))).alias("intangible"),
        total(when(F.col("l_returnflag") != "A", price * (1 - F.col("l_discount")))).alias("cost"))
    long = sums.unpivot(["ticker", "start", "rank"], FIELDS, "field", "value").filter("value is not null")
    end = F.date_sub(F.add_months("start", 3), 1)
    accn = F.concat(F.col("ticker").cast("string"), F.lit("-"), F.date_format("filed", "yyyyMMdd"))
    return long.withColumn("end", end).withColumn("filed", F.date_add("end", 45)).withColumns({
        "accn": accn, "fy": F.year("end"), "form": when(F.month("end") == 12, "10-K").otherwise("10-Q"), "taxonomy": when((F.col("field") == "cost") & (F.col("ticker") % 2 == 0), "dei").otherwise("us-gaap")})


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of fundamentals per supplier, with sector and some missing values."""
    l, s, n, r = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation", "region"))
    price, qty = F.col("l_extendedprice"), F.col("l_quantity")
    total = lambda x: settle(F.sum(x))
    f = l.groupBy(F.col("l_suppkey").alias("ticker")).agg(
        settle(F.avg(price / qty)).alias("raw_close"), F.count("*").cast("double").alias("shares"), total(price * F.col("l_discount")).alias("ocf"), total(-price * F.col("l_tax") / 2).alias("capex"),
        total(F.when(F.col("l_returnflag") == "R", price * F.col("l_tax"))).alias("total_debt"), total(price * F.col("l_discount") * F.col("l_tax") * 10).alias("ebit"), total(qty * 100).alias("equity"),
        total(F.when(F.col("l_linestatus") == "F", price * F.col("l_discount"))).alias("net_income"), total(F.when(qty > 10, price * 0.3)).alias("gross_profit"), total(price).alias("revenue"),
        total(qty * 2000).alias("assets"), total(F.when(F.col("l_shipdate") < "1998-01-01", qty * 4000)).alias("prior_assets"), total(F.when(qty > 40, price)).alias("current_assets"),
        total(F.when(qty < 10, price)).alias("current_liabilities"))
    named = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)  # nations and regions are fixed
    named = named.select(F.col("s_suppkey").alias("ticker"), F.col("r_name").alias("sector"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("cash"))
    return f.join(named, "ticker")
