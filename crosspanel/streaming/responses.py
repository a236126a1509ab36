"""Model responses that arrive as JSON lines: validated against the requests, repeated ids dropped, sorted into valid and quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from crosspanel.operators.responses import validate


def response_stream(spark: SparkSession, folder: str, files_at_once: int = 1000) -> DataFrame:
    """(response_id, received, payload) of the lines of arriving files. A record carries its payload as response_json, as response, or is it.

    received is the record's time, else that of its file; blank lines are skipped.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files_at_once).text(folder).select("value", F.col("_metadata.file_modification_time").alias("_at")).filter("trim(value) <> ''")
    at = lambda k: F.get_json_object("value", f"$.{k}")
    payload = F.coalesce(at("response_json"), at("response"), F.col("value"))
    return lines.select(F.coalesce(at("response_id"), F.sha2("value", 256)).alias("response_id"), F.coalesce(F.try_to_timestamp(at("received")), "_at").alias("received"), payload.alias("payload"))


def ingest(stream: DataFrame, requests: DataFrame, within: str = "2 days") -> DataFrame:
    """Validated responses; an id that comes again within the time counts once, so state stays bounded by it. requests is static."""
    return validate(stream.withWatermark("received", within).dropDuplicatesWithinWatermark(["response_id"]), requests)


def answers(requests: DataFrame, responses: DataFrame, within: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """requests (accn, asked) and responses (accn, response_id, answered), both streams or both tables -> a row for each response that comes
    within the time of its request, and one without response_id for each request that never has such a response.

    As streams, both are kept as state by accn until the watermarks (late behind the newest time of each) have passed the
    time in which an answer may come; what is then unanswered is reported, so state is bounded by that time.
    """
    asked, answered = requests.withWatermark("asked", late).alias("q"), responses.withWatermark("answered", late).alias("r")
    in_time = F.expr(f"q.accn = r.accn AND r.answered BETWEEN q.asked AND q.asked + INTERVAL {within}")
    return asked.join(answered, in_time, "leftOuter").select("q.accn", "q.asked", "r.response_id", "r.answered")


def start(validated: DataFrame, valid_folder: str, quarantine_folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Each micro-batch is written to a folder of its number, so a batch that is run again after a failure replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        batch.filter("status = 'valid'").write.mode("overwrite").parquet(f"{valid_folder}/batch={number}")
        batch.filter("status <> 'valid'").write.mode("overwrite").parquet(f"{quarantine_folder}/batch={number}")
        batch.unpersist()

    writer = validated.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
