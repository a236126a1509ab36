"""Token counts of documents in flat, unindexed token files.

A file is a run of token ids of fixed width in which an end-of-document id closes each document. Blocks of it are
searched on their own with one vectorised comparison; a block knows the lengths of the documents that lie inside it
and the tokens before its first and after its last separator. A prefix scan over these few numbers of each block
gives what an open document brings into the next block and how many documents came before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crosspanel.llm.common import checkpoint
from crosspanel.llm.tokens import byte_tokenizer

BLOCK_TOKENS = 1 << 16


def read_token_files(spark: SparkSession, path: str, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Raw token files (each under 2 GB) as blocks: file, block, payload. Only Spark's reader touches the path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                data = memoryview(content.as_buffer()) if content.is_valid else memoryview(b"")
                for n, at in enumerate(range(0, len(data), width * block_tokens)):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([bytes(data[at : at + width * block_tokens])], pa.binary())], names=["file", "block", "payload"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, block long, payload binary")


def token_blocks(docs: DataFrame, tokenizer: str, end_id: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """docs tokenised into flat files, one for each partition: file, block, payload (16-bit ids), and apart from the
    payload doc_ids, the ids in file order of the documents begun since the block before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, name = byte_tokenizer(tokenizer).encode_ordinary, str(TaskContext.get().partitionId())
        held, ids, n, begun = [], 0, 0, []

        def out(size: int) -> pa.RecordBatch:
            nonlocal held, ids, n, begun
            flat = np.concatenate(held)
            held, ids = [flat[size:]], len(flat) - min(size, len(flat))
            made = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([flat[:size].tobytes()], pa.binary()), pa.array([begun], pa.list_(pa.int64()))], names=["file", "block", "payload", "doc_ids"])
            n, begun = n + 1, []
            return made

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                part = np.array([*encode(text or ""), end_id], dtype="<u2")
                begun.append(doc)
                held.append(part)
                ids += len(part)
                while ids >= block_tokens:
                    yield out(block_tokens)
        if ids:
            yield out(block_tokens)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "file string, block long, payload binary, doc_ids array<long>")


def scan_blocks(blocks: DataFrame, end_id: int, width: int = 2) -> DataFrame:
    """file, block, head and tail (tokens before the first and after the last separator; head is null without one),
    separators, inner (lengths between separators), and any column of blocks but the payload."""
    rest = [f for f in blocks.schema.fields if f.name not in ("file", "block", "payload")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads, tails, counts, inner = [], [], [], []
            for payload in b.column("payload").to_pylist():
                ids = np.frombuffer(payload or b"", dtype=f"<u{width}")
                at = np.flatnonzero(ids == end_id)
                heads.append(int(at[0]) if len(at) else None)
                tails.append(len(ids) - int(at[-1]) - 1 if len(at) else len(ids))
                counts.append(len(at))
                inner.append((np.diff(at) - 1).tolist())
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("block"), pa.array(heads, pa.int64()), pa.array(tails, pa.int64()), pa.array(counts, pa.int64()), pa.array(inner, pa.list_(pa.int64())), *(b.column(f.name) for f in rest)], names=["file", "block", "head", "tail", "separators", "inner", *(f.name for f in rest)])

    kinds = ["file string, block long, head long, tail long, separators long, inner array<long>", *(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)]
    return blocks.mapInArrow(run, ", ".join(kinds))


def stitch(scanned: DataFrame) -> DataFrame:
    """(file, ordinal, n_tokens, closed): each document of each file in order; the last may lack its separator."""
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    runs = scanned.withColumn("run", F.sum((F.col("separators") > 0).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # Tokens open after each block: its tail and, back to the last separator, all before it.
    runs = runs.withColumn("open", F.sum("tail").over(Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.withColumn("carried", F.coalesce(F.lag("open").over(order), F.lit(0))).withColumn("first", F.coalesce(F.sum("separators").over(before), F.lit(0)))
    runs = runs.withColumn("last", F.lead("block").over(order).isNull())
    inside = runs.filter("separators > 0").select("file", "first", F.posexplode(F.concat(F.array(F.col("head") + F.col("carried")), "inner")).alias("nth", "n_tokens"))
    closed = inside.select("file", (F.col("first") + F.col("nth")).alias("ordinal"), "n_tokens", F.lit(True).alias("closed"))
    open_end = runs.filter("last and open > 0").select("file", (F.col("first") + F.col("separators")).alias("ordinal"), F.col("open").alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(open_end)


def document_token_counts(docs: DataFrame, tokenizer: str, end_id: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, file, ordinal, n_tokens) of each row of docs, counted in the flat files that docs are tokenised into.

    n_tokens leaves out the separator: null and empty texts count zero. Rows that repeat an id are counted each; a
    null id stays null. No rows give no rows; other columns are ignored.
    """
    scanned = checkpoint(scan_blocks(token_blocks(docs, tokenizer, end_id, block_tokens), end_id))
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begun = scanned.withColumn("first", F.coalesce(F.sum(F.size("doc_ids")).over(order), F.lit(0)))
    names = begun.select("file", "first", F.posexplode("doc_ids").alias("nth", "doc_id")).select("file", (F.col("first") + F.col("nth")).alias("ordinal"), "doc_id")
    return stitch(scanned.drop("doc_ids")).join(names, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "n_tokens")
