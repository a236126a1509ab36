"""Batches of the pipeline's stages: what a worker holds at once goes by bytes of text, not by rows."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")


def test_batches_of_a_stage_are_bounded_by_bytes(spark, monkeypatch):
    def sizes(docs):
        return docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"]) for b in batches), "n long, bytes long")

    monkeypatch.setattr(pipeline.exact_dedup, "drop_exact_duplicates", sizes)
    docs = spark.range(0, 6000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 3000).alias("text"))
    try:
        got = dict(pipeline.STAGES)["exact_dedup"](spark, docs, "").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    assert sum(r.n for r in got) == 6000 and max(r.bytes for r in got) < 3 << 20


def test_a_bound_of_the_session_stays(spark, monkeypatch):
    monkeypatch.setattr(pipeline.exact_dedup, "drop_exact_duplicates", lambda docs: docs)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")
    try:
        dict(pipeline.STAGES)["exact_dedup"](spark, spark.range(1), "")
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1m"
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
