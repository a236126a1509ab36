"""Distributed sums, ranks, quantiles, lags and as-of joins against pandas and against the one-task forms."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosspanel.operators import parts, xsec
from crosspanel.operators.asof import asof


@pytest.fixture(scope="module")
def rows(spark):
    """One key has most rows; ties, nulls, a null key."""
    rng = np.random.default_rng(8)
    n = 600
    key = np.where(rng.random(n) < 0.8, "hot", rng.choice(["a", "b"], n))
    data = [(int(i), None if i % 50 == 7 else str(k), int(t), None if i % 11 == 0 else float(x)) for i, (k, t, x) in enumerate(zip(key, rng.integers(0, 300, n), rng.integers(0, 40, n) / 4, strict=True))]
    df = spark.createDataFrame(data, "id long, k string, t int, x double").repartition(3)
    df.cache()
    return df


def compared(a, b, key="id"):
    one, two = (d.toPandas().sort_values(key).reset_index(drop=True) for d in (a, b))
    pd.testing.assert_frame_equal(one, two[one.columns], check_dtype=False)


@pytest.mark.parametrize("by", [[], ["k"]])
def test_ranks(rows, by):
    want = rows.withColumn("p", xsec.pct_rank_01(F.col("x"), by))
    compared(parts.ranked(rows, by, {"p": "x"}, 7).select("id", "p"), want.select("id", "p"))


@pytest.mark.parametrize("by", [[], ["k"]])
def test_quantiles(rows, by):
    shares = [0.0, 0.01, 1 / 3, 0.5, 0.99, 1.0]
    got = parts.quantiles(rows.withColumn("none", F.lit(None).cast("double")), by, ["x", "none"], shares, 5)
    want = rows.groupBy(*by).agg(*[F.percentile("x", F.lit(s)).alias(f"x_{i}") for i, s in enumerate(shares)])
    key = [str(r) for r in got.columns if r in by]
    assert got.filter("none_3 is not null").count() == 0
    a, b = (sorted([tuple("~" if v is None else f"{v:.9f}" if isinstance(v, float) else v for v in r) for r in d.select(*key, *[f"x_{i}" for i in range(6)]).collect()]) for d in (got, want))
    assert a == b


def test_previous_row(spark, rows):
    from pyspark.sql import Window

    want = rows.withColumns({"prior_x": F.lag("x").over(Window.partitionBy("k").orderBy("t", "id")), "prior_id": F.lag("id").over(Window.partitionBy("k").orderBy("t", "id"))})
    got = parts.previous(rows, ["k"], ["t", "id"], ["x", "id"], 9)
    compared(got, want)
    assert in_several_parts(rows) > 1


def in_several_parts(rows):
    """Parts that the rows of the long key are in."""
    return parts.in_parts(rows.withColumn("_key", parts.key_of(["k"])), ["t", "id"], 9).filter("k = 'hot'").select("_part").distinct().count()


@pytest.mark.parametrize(("strict", "forward"), [(False, False), (True, False), (False, True), (True, True)])
def test_asof_in_parts(rows, strict, forward):
    events = rows.filter("id % 5 = 0").select("k", F.col("t").alias("at"), F.col("id").alias("seq"), F.col("x").alias("v"))
    probes = rows.filter("id % 5 <> 0").select("id", "k", "t")
    args = (["k"], "t", "at", ["v", "seq"], strict, forward, ["seq"])
    compared(parts.asof(probes, events, *args, parts=8), asof(probes, events, *args))


def test_odd_frames(spark, rows):
    none = rows.limit(0)
    assert parts.ranked(none, ["k"], {"p": "x"}).count() == 0 and parts.quantiles(none, ["k"], ["x"], [0.5]).count() == 0
    assert parts.previous(none, ["k"], ["id"], ["x"]).count() == 0 and parts.asof(none, rows.select("k", F.col("t").alias("at"), F.col("x").alias("v")), ["k"], "t", "at", ["v"]).count() == 0
    alone = parts.asof(rows, none.select("k", F.col("t").alias("at"), F.col("x").alias("v")), ["k"], "t", "at", ["v"])
    assert alone.count() == rows.count() and alone.filter("v is not null").count() == 0
    top = parts.first_rows(rows, [F.col("x").desc_nulls_last(), F.col("id")], 3).collect()
    assert [r.place for r in top] == [1, 2, 3]
