"""Running sums, ranks, quantiles, previous rows and as-of joins in which no task holds a whole key.

Rows are dealt to range partitions by key and order, so that a long key lies in several parts that follow each other.
What a part needs of those before it is one small row for each key and part (a sum, a last row), carried along in a
window over these heads alone. Rows are dealt once and checkpointed, so that all steps see the same parts.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_BEFORE = Window.unboundedPreceding, -1


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only where it is unset, on one machine, a new one."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: it survives lost executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def key_of(by: list[str]) -> Column:
    """The columns as one: nulls inside compare as equal."""
    return F.struct(*by) if by else F.struct(F.lit(0).alias("all"))


def in_parts(df: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """df (_key, order columns and others) with _part: parts follow each other by key and order; equal rows share one."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(df.repartitionByRange(parts, "_key", *order).withColumn("_part", F.spark_partition_id()))


def _heads(sums: DataFrame, carried: Column) -> DataFrame:
    """(_key, _part, _carried): a row for each key and part, so a key has as many as there are parts at most."""
    return sums.select("_key", "_part", carried.over(Window.partitionBy("_key").orderBy("_part").rowsBetween(*_BEFORE)).alias("_carried"))


def running_sum(df: DataFrame, order: list[str], amount: str, name: str, parts: int | None = None) -> DataFrame:
    """df (_key, order, amount) with name: the sum of amount over the rows of its key before it in order (which must tell rows apart)."""
    dealt = in_parts(df, order, parts)
    heads = _heads(dealt.groupBy("_key", "_part").agg(F.sum(amount).alias("_sum")), F.sum("_sum"))
    inside = F.sum(amount).over(Window.partitionBy("_key", "_part").orderBy(*order).rowsBetween(*_BEFORE))
    both = dealt.withColumn("_inside", inside).join(heads, ["_key", "_part"])
    return both.withColumn(name, F.coalesce("_inside", F.lit(0)) + F.coalesce("_carried", F.lit(0))).drop("_part", "_inside", "_carried")


def value_counts(df: DataFrame, by: list[str], x: Column | str, parts: int | None = None) -> DataFrame:
    """(_key, _x, times, before, n): each value of a key, how often, how many rows have a lesser one and how many any.

    Values are counted before they are dealt out, so a value that most rows share is one row.
    """
    value = F.col(x) if isinstance(x, str) else x
    counts = df.select(key_of(by).alias("_key"), value.alias("_x")).filter("_x is not null").groupBy("_key", "_x").agg(F.count("*").alias("times"))
    below = running_sum(counts, ["_x"], "times", "before", parts)
    return below.join(below.groupBy("_key").agg(F.sum("times").alias("n")), "_key")


def ranked(df: DataFrame, by: list[str], columns: dict[str, str], parts: int | None = None) -> DataFrame:
    """df with a percentile for each of columns (name -> column): 0 to 1 by average rank, 0.5 where a key has one value, null for nulls."""
    out = checkpointed(df) if len(columns) > 1 else df  # read once for each column
    for name, x in columns.items():
        found = value_counts(df, by, x, parts)
        place = F.when(F.col("n") == 1, 0.5).otherwise((F.col("before") + (F.col("times") - 1) / 2) / (F.col("n") - 1))
        places = found.select("_key", "_x", place.alias("_place"))
        out = out.withColumns({"_key": key_of(by), "_x": F.col(x)}).join(places, ["_key", "_x"], "left").withColumnRenamed("_place", name).drop("_key", "_x")
    return out


def first_rows(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The k first rows of df in order, with their place from 1: each task keeps k, then one task sorts what they kept."""
    top = df.orderBy(*order).limit(k)
    return top.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def quantiles(df: DataFrame, by: list[str], columns: list[str], shares: list[float], parts: int | None = None) -> DataFrame:
    """(by, column_0, column_1, ...): exact quantiles of each column at the shares, linear between neighbours; null without values."""
    long = df.select(key_of(by).alias("_k"), *[F.col(c).cast("double").alias(c) for c in columns]).unpivot("_k", columns, "_c", "_v")
    found = value_counts(long, ["_k", "_c"], "_v", parts)
    spot = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(s)).alias("share")) for i, s in enumerate(shares)]))
    each = found.withColumn("_s", spot).withColumn("_at", F.col("_s.share") * (F.col("n") - 1))
    within = lambda at: (F.col("before") <= at) & (at < F.col("before") + F.col("times"))
    low, high = F.floor("_at"), F.ceil("_at")
    ends = each.filter(within(low) | within(high)).groupBy("_key", "_s.i", "_at").agg(F.max(F.when(within(low), F.col("_x"))).alias("lo"), F.max(F.when(within(high), F.col("_x"))).alias("hi"))
    value = F.when(low == high, F.col("lo")).otherwise(F.col("lo") * (high - F.col("_at")) + F.col("hi") * (F.col("_at") - low))
    flat = ends.select(F.col("_key._k").alias("_k"), F.concat_ws("_", "_key._c", F.col("i").cast("string")).alias("name"), value.alias("v"))
    wide = flat.groupBy("_k").pivot("name", [f"{c}_{i}" for c in columns for i in range(len(shares))]).agg(F.first("v"))
    keys = df.select(key_of(by).alias("_k")).distinct()
    return keys.join(wide, "_k", "left").select(*[F.col(f"_k.{b}").alias(b) for b in by], *wide.columns[1:])


def previous(df: DataFrame, by: list[str], order: list[str], values: list[str], parts: int | None = None) -> DataFrame:
    """df with prior_<value> for each value: that of the row before in order within by, null for the first. order must tell rows apart."""
    told, inside = F.struct(*values), Window.partitionBy("_key", "_part").orderBy(*order)
    dealt = in_parts(df.withColumn("_key", key_of(by)), order, parts)
    last = dealt.groupBy("_key", "_part").agg(F.max_by(told, F.struct(*order)).alias("_last"))
    heads = _heads(last, F.last("_last"))
    # Only the first row of a part looks beyond it.
    both = dealt.withColumns({"_lag": F.lag(told).over(inside), "_first": F.row_number().over(inside) == 1}).join(heads, ["_key", "_part"], "left")
    prior = F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_lag"))
    return both.withColumn("_prior", prior).select(*df.columns, *[F.col(f"_prior.{v}").alias(f"prior_{v}") for v in values])


def asof(probes: DataFrame, events: DataFrame, by: list[str], probe_ts: str, event_ts: str, values: list[str], strict: bool = False, forward: bool = False, order: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """As operators.asof.asof, with probes and events of a key in as many tasks as its length needs.

    A probe that meets no event in its part has the last one of the parts before (forward: the first of those after).
    """
    order = order or []
    left = probes.select(key_of(by).alias("_key"), F.col(probe_ts).alias("_ts"), F.lit(1).alias("_side"), F.struct(*probes.columns).alias("_probe"))
    right = events.filter(F.col(event_ts).isNotNull() & F.coalesce(*[F.col(v).cast("string") for v in values]).isNotNull())
    right = right.select(key_of(by).alias("_key"), F.col(event_ts).alias("_ts"), F.lit(0).alias("_side"), F.struct(*values).alias("_event"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    dealt = in_parts(left.unionByName(right, allowMissingColumns=True), ["_ts"], parts)
    turn = lambda c: c.desc() if forward else c.asc()
    # At equal times an event sorts before the probe that may see it; such rows share a part.
    side = -F.col("_side") if strict else F.col("_side")
    keys = [turn(F.col("_ts")), side.asc(), *[turn(F.col(f"_o{i}")) for i in range(len(order))]]
    inside = Window.partitionBy("_key", "_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumn("_seen", F.last("_event", ignorenulls=True).over(inside)).filter("_side = 1")
    at = F.struct("_ts", *[f"_o{i}" for i in range(len(order))])
    some = dealt.filter("_side = 0").groupBy("_key", "_part").agg((F.min_by if forward else F.max_by)("_event", at).alias("_last"))
    every = dealt.select("_key", "_part").distinct().join(some, ["_key", "_part"], "left")
    way = Window.partitionBy("_key").orderBy(turn(F.col("_part"))).rowsBetween(*_BEFORE)
    heads = every.select("_key", "_part", F.last("_last", ignorenulls=True).over(way).alias("_carried"))
    both = local.join(heads, ["_key", "_part"], "left").withColumn("_found", F.coalesce("_seen", "_carried"))
    return both.select("_probe.*", *[F.col(f"_found.{v}").alias(v) for v in values])
