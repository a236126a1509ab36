"""Best-fit packing of tokenised documents after Martello-Toth dominance reduction.

Bins see only lengths, so the instance is the histogram of piece lengths: at most `capacity` numbers, whatever the
corpus. It alone reaches the driver, where it is reduced and packed into patterns with multiplicities. The pieces
then find their places in parallel: the i-th piece of a length takes the i-th slot of that length.

Reduction, for each length left from the longest on, until no rule fixes any, with r the room beside it:
* a partner of exactly r fills the bin, which dominates every alternative;
* if no two remaining pieces fit into r together, the longest single piece that fits dominates;
* if nothing fits, the piece stays alone.
Each fixes as many bins at once as there are pieces of both lengths. What no rule fixes is packed best-fit decreasing.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.llm.common import checkpoint, tidied
from crosspanel.llm.tokens import PackedEncoder

CAPACITY = 4096
#: Ranks within one length are counted in so many groups of documents.
RANK_GROUPS = 256
#: Texts encoded at once.
TEXTS = 500


@dataclass
class Pattern:
    """Bins of the same content: lengths in order of place, and how many such bins there are."""

    lengths: list[int]
    bins: int
    fixed: bool = field(default=False)


def _lengths_left(count: list[int]) -> list[int]:
    return [n for n in range(1, len(count)) if count[n]]


def _dominant(count: list[int], held: list[int], length: int, capacity: int) -> Pattern | None:
    """The bins that dominance fixes for a piece of that length; held are the lengths left."""
    room = capacity - length
    count[length] -= 1
    at = bisect.bisect_right(held, room) - 1
    while at >= 0 and not count[held[at]]:
        at -= 1
    partner = held[at] if at >= 0 else 0
    least = next((n for n in held if count[n]), 0)
    alone = partner == least and count[least] == 1
    count[length] += 1
    if not partner:
        return Pattern([length], count[length], True)
    if partner == room or 2 * least > room or alone:
        return Pattern([length, partner], count[length] // 2 if partner == length else min(count[length], count[partner]), True)
    return None


def reduce_by_dominance(count: list[int], capacity: int) -> list[Pattern]:
    """Takes from count what dominance fixes; returns the fixed patterns. Passes over all lengths, the longest first,
    until one fixes nothing."""
    fixed, before = [], -1
    while len(fixed) != before:
        before, held = len(fixed), _lengths_left(count)
        for length in held[::-1]:
            while count[length] and (p := _dominant(count, held, length, capacity)):
                for n in p.lengths:
                    count[n] -= p.bins
                fixed.append(p)
                held = _lengths_left(count)
    return fixed


def best_fit_decreasing(count: list[int], capacity: int) -> list[Pattern]:
    """Bins of equal content move together: each step fills the tightest group of open bins that takes the length."""
    open_bins: dict[int, list[Pattern]] = {}
    rooms: list[int] = []  # sorted keys of open_bins
    done: list[Pattern] = []

    def put(p: Pattern, room: int) -> None:
        if not room:
            done.append(p)
            return
        if room not in open_bins:
            open_bins[room] = []
            bisect.insort(rooms, room)
        open_bins[room].append(p)

    for length in range(len(count) - 1, 0, -1):
        left = count[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                p = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room], rooms[at]
            else:
                room = capacity
                p = Pattern([], -(-left // (capacity // length)))
            each = room // length
            full = min(p.bins, left // each)
            if full:
                put(Pattern(p.lengths + [length] * each, full), room - each * length)
                left -= full * each
                p.bins -= full
            if left and p.bins:
                some = min(left, each)
                put(Pattern(p.lengths + [length] * some, 1), room - some * length)
                left -= some
                p.bins -= 1
            if p.bins and p.lengths:
                put(p, room)
        count[length] = 0
    return done + [p for ps in open_bins.values() for p in ps]


def pack_lengths(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    count = [0] * (capacity + 1)
    for length, n in histogram.items():
        count[length] = n
    return reduce_by_dominance(count, capacity) + best_fit_decreasing(count, capacity)


class Slots:
    """For the i-th piece of a length its sequence and offset, from arrays as long as the patterns are."""

    def __init__(self, patterns: list[Pattern]):
        rows, first = [], 0
        for p in patterns:
            offset, places = 0, {}
            for n in p.lengths:
                places.setdefault(n, []).append(offset)
                offset += n
            for n, at in places.items():
                rows.append((n, first, p.bins, at))
            first += p.bins
        rows.sort(key=lambda r: (r[0], r[1]))
        self.places = np.array([x for r in rows for x in r[3]], dtype=np.int32)
        self.each = np.array([len(r[3]) for r in rows], dtype=np.int64)
        self.place_at = np.concatenate([[0], np.cumsum(self.each)])
        self.length = np.array([r[0] for r in rows], dtype=np.int64)
        self.sequence = np.array([r[1] for r in rows], dtype=np.int64)
        size = self.each * np.array([r[2] for r in rows], dtype=np.int64)
        before = np.cumsum(size) - size
        self.base = before  # all slots in order of length
        starts = np.searchsorted(self.length, np.arange(self.length.max(initial=0) + 2))
        self.of_length = np.append(before, size.sum())[starts]

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = self.of_length[length] + rank
        row = np.searchsorted(self.base, slot, "right") - 1
        inside = slot - self.base[row]
        return self.sequence[row] + inside // self.each[row], self.places[self.place_at[row] + inside % self.each[row]]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and an end id, cut only where longer than capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = PackedEncoder(tokenizer), end_id.to_bytes(4, "little")
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for first in range(0, b.num_rows, TEXTS):
                texts = b.column("text").slice(first, TEXTS).fill_null("").to_pylist()
                for i, ids in enumerate(encode(texts), first):
                    ids += end
                    for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        row.append(i)
                        piece.append(n)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut (with a column length of 1..capacity) and the columns sequence_id and offset of the packing."""
    group = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(RANK_GROUPS)).cast("int")
    cut = cut.withColumn("_group", group).withColumn("_nth", F.row_number().over(Window.partitionBy("length", "_group").orderBy("doc_id", "piece", "ids_crc32")).cast("long") - 1)
    cut = checkpoint(cut)
    counts = cut.groupBy("length", "_group").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most capacity rows
    slots = Slots(pack_lengths(histogram, capacity))
    ranked = cut.join(before.select("length", "_group", F.coalesce("_before", F.lit(0)).alias("_before")), ["length", "_group"])
    names = [c for c in cut.columns if not c.startswith("_")]
    ranked = ranked.select(*names, (F.col("_before") + F.col("_nth")).alias("_rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = slots.of(np.asarray(b.column("length")), np.asarray(b.column("_rank")))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(sequence), pa.array(offset.astype(np.int64))], names=[*names, "sequence_id", "offset"])

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name in names]
    return ranked.mapInArrow(tidied(run), ", ".join([*kinds, "sequence_id long", "offset long"]))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are a piece of one end id. Rows that repeat an id are packed each for itself; a null id is
    kept. Ties between pieces of a length are settled by doc_id, piece and checksum. No rows give no rows; other
    columns are ignored.
    """
    return place(pieces(docs, tokenizer, capacity, end_id), capacity)
