"""Shared folder, table access and joins on identifier lists."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Identifiers that may be broadcast: 16 bytes each with the key of a text, 16 MB in all; longer lists are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def use_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the folder in spark.checkpoint.dir; only where that is unset (local tests) to a new one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = sc.getConf().get("spark.checkpoint.dir")
    if not shared and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: it survives lost executors, and Spark removes it once nothing refers to it."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def stored_at(df: DataFrame, *by: str) -> str:
    """Path of df written as a table, in folders by the columns named, to the folder of checkpoints."""
    use_checkpoints(df.sparkSession)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4()}"
    df.write.partitionBy(*by).parquet(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """Written as a table and read back: smaller than a checkpoint, and read by column."""
    return df.sparkSession.read.schema(df.schema).parquet(stored_at(df))


def scratch(df: DataFrame) -> DataFrame:
    """df stored for as long as the driver runs: its file system deletes the table when the JVM ends."""
    path, spark = stored_at(df), df.sparkSession
    held = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(held)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Memory that a worker's allocators keep goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidied(run: Callable) -> Callable:
    """run (batches -> batches), and then the memory that its arrays had goes back to the system.

    Spark's workers live on to the next stages; what the allocators keep of each stage's peak would add up.
    """

    @wraps(run)
    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidy


def text_key(text: str | Column = "text") -> Column:
    """A hash of a text; beside the doc_id it tells rows apart that repeat an id with other texts."""
    return F.xxhash64((F.col(text) if isinstance(text, str) else text).cast("string"))


def _free(docs: DataFrame) -> str:
    """A name that no column of docs has."""
    return "_" * (1 + max(map(len, docs.columns)))


def _joined(docs: DataFrame, ids: DataFrame, key: Column, how: str) -> DataFrame:
    """docs joined to ids (doc_id, key and others) by id and key, nulls alike; key is the expression for docs. A short
    list is broadcast, so that docs are not shuffled. docs alone decide which names are free: ids' own two are renamed."""
    ident, other = f"{_free(docs)}i", f"{_free(docs)}k"
    ids = checkpoint(ids.withColumnsRenamed({"doc_id": ident, "key": other}))
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(side, F.col("doc_id").cast("long").eqNullSafe(F.col(ident)) & (key == F.col(other)), how)


def rows_of(docs: DataFrame, named: DataFrame, key: Column | None = None) -> DataFrame:
    """Rows of docs (doc_id, text) that named (doc_id, key, others) names, with the other columns of named."""
    others = [c for c in named.columns if c not in ("doc_id", "key")]
    return _joined(docs, named, text_key() if key is None else key, "inner").select(*docs.columns, *others)


def without_rows(docs: DataFrame, verdict: DataFrame, key: Column | None = None) -> DataFrame:
    """docs without the rows whose doc_id and key do not stay by verdict (doc_id, key, stays: a row for each of docs).

    Of rows that agree in doc_id and key, and stay, one is left. All columns of docs stay, whatever their names.
    """
    key = text_key() if key is None else key
    counted = checkpoint(verdict.groupBy("doc_id", "key").agg(F.max("stays").alias("stays"), F.count("*").alias("n")))
    left = _joined(docs, counted.filter("not stays").select("doc_id", "key"), key, "left_anti")
    twice = counted.filter("stays and n > 1").select("doc_id", "key")
    if twice.isEmpty():
        return left
    tag = _free(docs)
    again = _joined(left, twice, key, "left_semi").withColumn(tag, key).dropDuplicates(["doc_id", tag]).select(docs.columns)
    return _joined(left, twice, key, "left_anti").unionByName(again)
