"""Queries on streams: files written from the tables, read as they would arrive, until none is left."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.operators.parts import checkpoint_folder
from crosspanel.plans.registry import query
from crosspanel.sources import proxy
from crosspanel.streaming import responses as S

#: Hours at which a file of arrivals ends; the last file brings a time after all others, so that everything falls due.
_FILES = (2, 4, 6)
_CLOSE = "2030-01-01 00:00:00"
_ASKED = "timestamp_seconds(1767225600 + (conv_id * 37 % 480) * 60 + turn)"


def _arrivals(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Turns of users ask, turns of assistants answer the turn before, some of them after the hour."""
    c = proxy.table(spark, sf, "conversations").filter("conv_id is not null and turn is not null").withColumn("turn", F.col("turn").cast("long"))
    key = lambda turn: F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string"))
    asked = c.filter("role = 'user'").select(key(F.col("turn")).alias("accn"), F.expr(_ASKED).alias("asked"))
    late = F.expr(f"{_ASKED} + make_interval(0, 0, 0, 0, 0, (conv_id * 7 + turn) % 90, 0)")
    given = c.filter("role = 'assistant'").select(key(F.col("turn") - 1).alias("accn"), key(F.col("turn")).alias("response_id"), late.alias("answered"))
    return asked, given


def _as_stream(spark, rows: DataFrame, at: str, folder: str) -> DataFrame:
    """rows as a stream of one file folder after the other, in order of time."""
    edges = [F.timestamp_seconds(F.lit(1767225600 + h * 3600)) for h in _FILES]
    part = sum((F.when(F.col(at) >= e, 1).otherwise(0) for e in edges), F.lit(0))
    for i in range(len(_FILES) + 1):
        rows.filter(part == i).coalesce(1).write.parquet(f"{folder}/{i}")
    end = {c: F.lit(_CLOSE).cast("timestamp") if c == at else F.lit("end") for c in rows.columns}
    spark.range(1).select(*[v.alias(c) for c, v in end.items()]).coalesce(1).write.parquet(f"{folder}/{len(_FILES) + 1}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


@query("""WITH c AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, epoch_ms(CAST((1767225600 + (conv_id * 37 % 480) * 60 + turn) * 1000 AS BIGINT)) AS t0 FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
  q AS (SELECT conv_id || '-' || turn AS accn, t0 AS asked FROM c WHERE role = 'user'),
  r AS (SELECT conv_id || '-' || (turn - 1) AS accn, conv_id || '-' || turn AS response_id, t0 + to_minutes(CAST((conv_id * 7 + turn) % 90 AS INTEGER)) AS answered FROM c WHERE role = 'assistant')
  SELECT q.accn, response_id, CAST(epoch(answered) - epoch(asked) AS BIGINT) AS seconds, response_id IS NULL AS never_answered FROM q LEFT JOIN r ON q.accn = r.accn AND answered BETWEEN asked AND asked + INTERVAL 1 HOUR""")
def ingest_responses_stream(spark, sf):
    """Requests and answers as two streams of files, joined with state that expires; what no answer came for is reported."""
    folder = f"{checkpoint_folder(spark)}/{uuid.uuid4()}"
    asked, given = _arrivals(spark, sf)
    joined = S.answers(_as_stream(spark, asked, "asked", f"{folder}/asked"), _as_stream(spark, given, "answered", f"{folder}/given"))
    run = joined.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    out = spark.read.schema(joined.schema).parquet(f"{folder}/out").filter("accn <> 'end'")
    return out.select("accn", "response_id", (F.unix_timestamp("answered") - F.unix_timestamp("asked")).alias("seconds"), F.col("response_id").isNull().alias("never_answered"))
