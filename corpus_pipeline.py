"""A corpus pipeline of five stages: each takes all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from crosspanel.llm import decontaminate, exact_dedup, near_dedup, packing, toxicity
from crosspanel.llm.common import checkpoint, table
from crosspanel.llm.queries import WORDS

#: Bytes of texts in an Arrow batch. Spark's own bound is 10,000 rows: some 20 MB that the JVM's allocator keeps for each
#: arena, and that each Python worker holds beside its tokenizers.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20

def small_batches(stage: Callable) -> Callable:
    """stage, with the session's Arrow batches held to BATCH_BYTES, unless the session sets a bound of its own.

    The bound remains set afterwards, as what a stage returns has yet to run. Batches are more then; rows are the same.
    """

    @wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if BATCH not in spark.conf.getAll:
            spark.conf.set(BATCH, str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return bounded


@small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


@small_batches
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


@small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs)


@small_batches
def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, WORDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, checkpointed between stages."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpoint(docs)
    return docs


#: Near-duplicate search and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
