"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

A window that shares no shingle with an item has similarity zero to it, so windows are placed only where a shingle of
the text is one of the benchmark's: one window for each offset at which the shared shingle would lie in the item. Each
window's fingerprint is looked up in a multi-index of the items' fingerprints: eight blocks of eight bits, of which
one at least differs in two bits or fewer whenever the whole differs in 23 or fewer. What lies within the radius is
verified by the weighted Jaccard similarity of the shingle multisets. Weights are those of the whole benchmark; tasks
read its items block by block from a table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm import words as W
from crosspanel.llm.common import checkpoint, stored_at, tidied

#: Bytes of benchmark text that a task holds at once (its index takes some forty times as many), with ITEM more for
#: each item; a larger benchmark is worked through in blocks, each read once for HELD bytes of documents.
BLOCK, ITEM, HELD = 1 << 22, 100, 1 << 27
#: Differing bits within which an item is a candidate; at most 23. At similarity 0.8 about 10 differ (deviation 3).
RADIUS = 20
_TABLE_BITS = 20


class MultiIndex:
    """Fingerprints by each of their eight bytes, entered under every byte value within two bits."""

    _near = [np.flatnonzero(np.bitwise_count(np.arange(256, dtype=np.uint8) ^ np.uint8(v)) <= 2) for v in range(256)]

    def __init__(self, fps: np.ndarray):
        self.fps = fps
        self.lists: list[list[np.ndarray]] = []
        for block in range(8):
            value = ((fps >> np.uint64(8 * block)) & np.uint64(255)).astype(np.int64)
            at = [np.flatnonzero(value == v) for v in range(256)]
            self.lists.append([np.sort(np.concatenate([at[n] for n in self._near[v]])) for v in range(256)])

    def within(self, fp: int, radius: int) -> np.ndarray:
        some = np.unique(np.concatenate([self.lists[block][(fp >> (8 * block)) & 255] for block in range(8)]))
        return some[np.bitwise_count(self.fps[some] ^ np.uint64(fp)) <= radius]


def _shingled(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw, at = W.text_bytes(texts)
    starts, ends, first = W.spans(raw, at, "mark")
    h, to = W.shingle_hashes(W.word_hashes(raw, starts, ends), first, k)
    return h, to, np.diff(first)


class Frequencies:
    """Items of the whole benchmark and how many have each shingle; those that one item or none has are not listed."""

    def __init__(self, items: int, listed: np.ndarray, count: np.ndarray):
        order = np.argsort(listed)
        self.items, self.listed, self.count = items, listed[order], count[order]

    def weights(self, h: np.ndarray) -> np.ndarray:
        if not len(self.listed):
            return np.full(len(h), np.log1p(self.items))
        at = np.minimum(np.searchsorted(self.listed, h), len(self.listed) - 1)
        return np.log1p(self.items / np.where(self.listed[at] == h, self.count[at], 1))


class Benchmark:
    """The items of at least k words (or of exactly k for k below the usual shingle), ready for search."""

    def __init__(self, ids: list[int], texts: list[str], k: int, frequencies: Frequencies):
        self.k, self.ids, self.frequencies = k, np.array(ids, dtype=np.int64), frequencies
        h, to, self.words = _shingled(pa.array(texts, pa.string()), k)
        order = np.argsort(h, kind="stable")
        self.sorted, item, place = h[order], np.repeat(np.arange(len(ids)), np.diff(to))[order], (np.arange(len(h)) - np.repeat(to[:-1], np.diff(to)))[order]
        self.item, self.place = item, place
        self.table = np.zeros(1 << _TABLE_BITS, dtype=bool)
        self.table[(h & np.uint64((1 << _TABLE_BITS) - 1)).astype(np.int64)] = True
        self.bags = [np.unique(h[a:b], return_counts=True) for a, b in zip(to[:-1], to[1:], strict=True)]
        self.totals = [float(frequencies.weights(s) @ c) for s, c in self.bags]
        self.index = MultiIndex(W.simhash(h, to)[:, 0])

    def similarity(self, item: int, window: np.ndarray) -> float:
        bag, held = self.bags[item]
        seen, count = np.unique(window, return_counts=True)
        weight = self.frequencies.weights(seen)
        at = np.minimum(np.searchsorted(bag, seen), len(bag) - 1)
        shared = float(weight @ np.where(bag[at] == seen, np.minimum(count, held[at]), 0))
        return shared / (float(weight @ count) + self.totals[item] - shared)

    def search(self, h: np.ndarray, to: np.ndarray, similarity: float) -> Iterator[tuple[int, int, float, int, int]]:
        """(row, item, similarity, first word, words) of the best window for each row and item."""
        maybe = np.flatnonzero(self.table[(h & np.uint64((1 << _TABLE_BITS) - 1)).astype(np.int64)])
        low = np.searchsorted(self.sorted, h[maybe], "left")
        many = np.searchsorted(self.sorted, h[maybe], "right") - low
        maybe, low, many = maybe[many > 0], low[many > 0], many[many > 0]
        if not len(maybe):
            return
        hit = np.repeat(maybe, many)
        entry = np.repeat(low, many) + np.arange(len(hit)) - np.repeat(np.cumsum(many) - many, many)
        row = np.searchsorted(to, hit, "right") - 1
        span = self.words[self.item[entry]] - self.k + 1
        start = np.clip(hit - self.place[entry], to[row], np.maximum(to[row + 1] - span, to[row]))
        windows = np.unique(np.stack([row, start, np.minimum(start + span, to[row + 1])], axis=1), axis=0)
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        ends = windows[:, 2]
        for r, a, b in zip(windows[:, 0].tolist(), windows[:, 1].tolist(), ends.tolist(), strict=True):
            window = h[a:b]
            fp = int(W.simhash(window, np.array([0, b - a]))[0, 0])
            for item in self.index.within(fp, RADIUS).tolist():
                if (r, item) in best and best[r, item][0] >= 1:
                    continue
                s = self.similarity(item, window)
                if s >= similarity and s > best.get((r, item), (0.0,))[0]:
                    best[r, item] = (s, a - int(to[r]), b - a + self.k - 1)
        for (r, item), found in best.items():
            yield r, item, *found


@dataclass(frozen=True)
class Tables:
    """Where the benchmark's items, by block, and its shingle frequencies were written; these two paths and three
    numbers are all that the driver holds."""

    items: str
    frequencies: str
    blocks: int
    n_items: int
    k: int


def _rows(path: str) -> pa.Table:
    """A table that Spark wrote to the shared folder, read in a task."""
    system, at = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path) if ":" in path else f"file://{path}")
    files = [f.path for f in system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True)) if f.path.endswith(".parquet")]
    read = [pq.ParquetFile(system.open_input_file(f)).read() for f in sorted(files)]
    return pa.concat_tables(read) if read else pa.table({})


@lru_cache(maxsize=1)
def _frequencies(tables: Tables) -> Frequencies:
    t = _rows(tables.frequencies)
    if not t.num_rows:
        return Frequencies(tables.n_items, np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
    return Frequencies(tables.n_items, np.asarray(t.column("shingle")).view(np.uint64), np.asarray(t.column("items")))


@lru_cache(maxsize=1)
def _block(tables: Tables, block: int) -> list[Benchmark]:
    """One Benchmark for each shingle size that occurs in a block, its items in order."""
    t = _rows(f"{tables.items}/block={block}")
    held = sorted(zip(*(t.column(c).to_pylist() for c in ("item_id", "text")), strict=True)) if t.num_rows else []
    _, _, n = _shingled(pa.array([text for _, text in held], pa.string()), tables.k)
    size = np.minimum(n, tables.k).tolist()
    return [Benchmark([r[0] for r, m in zip(held, size, strict=True) if m == s], [r[1] for r, m in zip(held, size, strict=True) if m == s], s, _frequencies(tables)) for s in sorted({m for m in size if m})]


def benchmark_tables(benchmark: DataFrame, k: int) -> Tables | None:
    """Writes the benchmark, cut into blocks of about BLOCK bytes, and how many items of all have each shingle."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text") + ITEM).alias("bytes")).first()["bytes"]
    if not size:
        return None
    blocks = -(-size // BLOCK)
    where = stored_at(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int")).repartition("block"), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, to, _ = _shingled(b.column("text"), k)
            h, to = W.distinct(h, to)
            first = np.zeros(len(h), dtype=np.int64)
            first[to[:-1][np.diff(to) > 0]] = 1
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(first)], names=["shingle", "first"])

    met = items.select("text").mapInArrow(tidied(run), "shingle long, first long").groupBy("shingle").agg(F.count("*").alias("items"), F.sum("first").alias("first"))
    met = checkpoint(met)
    n = met.agg(F.sum("first")).first()[0] or 0
    return Tables(where, stored_at(met.filter("items > 1").select("shingle", "items")), blocks, n, k)


def _found(batches: Iterator[pa.RecordBatch], tables: Tables, similarity: float) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
    """Each batch with what _scan finds in all blocks; with several, so many batches are held as share their reading."""
    held: list[pa.RecordBatch] = []

    def scanned() -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
        found: list[list[tuple]] = [[] for _ in held]
        for block in range(tables.blocks):
            for b, some in zip(held, found, strict=True):
                some += _scan(b, "text", _block(tables, block), similarity)
        yield from zip(held, found, strict=True)

    for b in batches:
        held.append(b)
        if tables.blocks == 1 or sum(x.nbytes for x in held) > HELD:
            yield from scanned()
            held = []
    yield from scanned()


def _scan(batch: pa.RecordBatch, text: str, parts: list[Benchmark], similarity: float) -> Iterator[tuple[int, int, float, int, int]]:
    raw, at = W.text_bytes(batch.column(text))
    for i, j in W.blocks(at):
        part, offsets = raw[at[i] : at[j]], at[i : j + 1] - at[i]
        starts, ends, first = W.spans(part, offsets, "mark")
        words = W.word_hashes(part, starts, ends)
        for b in parts:
            h, to = W.shingle_hashes(words, first, b.k)
            for r, item, *rest in b.search(h, to, similarity):
                yield i + r, int(b.ids[item]), *rest


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words): for each row and item the most similar window.

    Words are runs of letters, digits and non-ASCII bytes, A-Z lower-cased. An item of fewer than k words is one
    shingle. Weights are log(1 + items / items that have the shingle). Null or blank texts and items match nothing;
    rows repeated in docs are repeated in the result; of equal windows the first counts. Other columns are ignored.
    """
    schema = "doc_id long, item_id long, similarity double, start_word int, n_words int"
    tables = benchmark_tables(benchmark, k)
    if tables is None:
        return docs.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in _found(batches, tables, similarity):
            ids = b.column("doc_id").take(pa.array([x[0] for x in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([x[i] for x in found], kind) for i, kind in ((1, pa.int64()), (2, pa.float64()), (3, pa.int32()), (4, pa.int32())))], names=["doc_id", "item_id", "similarity", "start_word", "n_words"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without the rows that hold a passage of the benchmark; all columns stay."""
    tables = benchmark_tables(benchmark, k)
    if tables is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in _found(batches, tables, similarity):
            keep = np.ones(b.num_rows, dtype=bool)
            keep[[x[0] for x in found]] = False
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(tidied(run), docs.schema)
