"""As-of joins: both sides are united and one window carries the last event to each probe. One shuffle by key, no range join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(probes: DataFrame, events: DataFrame, by: list[str], probe_ts: str, event_ts: str, values: list[str], strict: bool = False, forward: bool = False, order: list[str] | None = None) -> DataFrame:
    """probes with the values of the last event at or before probe_ts (strict: before; forward: the first after or at).

    Events with a null time or all values null are no events. Of events at one time the last by `order` counts. Probes
    without an event keep null values. Columns of probes keep their names; values must not clash with them.
    """
    order = order or []
    named = F.struct(*[F.col(v) for v in values])
    left = probes.select(*by, F.col(probe_ts).alias("_ts"), F.lit(1).alias("_side"), F.struct(*probes.columns).alias("_probe"))
    right = events.filter(F.col(event_ts).isNotNull() & F.coalesce(*[F.col(v).cast("string") for v in values]).isNotNull())
    right = right.select(*by, F.col(event_ts).alias("_ts"), F.lit(0).alias("_side"), named.alias("_event"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    both = left.unionByName(right, allowMissingColumns=True)
    # At equal times an event sorts before the probe that may see it.
    side = F.col("_side") if not strict else -F.col("_side")
    keys: list[Column] = [F.col("_ts").desc() if forward else F.col("_ts").asc(), side.asc(), *[(F.col(f"_o{i}").desc() if forward else F.col(f"_o{i}").asc()) for i in range(len(order))]]
    window = Window.partitionBy(*by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_seen", F.last("_event", ignorenulls=True).over(window)).filter("_side = 1")
    return seen.select("_probe.*", *[F.col(f"_seen.{v}").alias(v) for v in values])
