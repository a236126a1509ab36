"""Removal of long repeated passages by compaction of the de Bruijn graph of words.

Every run of `window` words is an edge of the graph, from the sequence of its first words to that of its last. An edge
that occurs twice anywhere is a repeated passage, and all words under it go. Edges are not shuffled one by one: those that follow each
other in a text and share their anchor (the least hash among the shorter k-mers inside) form a path, which is cut alike
wherever the same words stand. A join by anchors tells which paths repeat. Where all paths through an anchor are one
and the same, nothing branches there and the path is kept compact: all its edges repeat. Where paths
through an anchor differ, each distinct path is broken into its edges, once, at its source, and the edges are counted
with the times of their paths. What repeats goes back to the coordinates of the texts by joins: a bit mask for each path.

Texts are kept in compressed runs of some megabytes, each of which is cut again where it is needed, so that only hashes
travel. Equal edges have equal anchors: identity of a path or an edge is two 64-bit hashes, of anchor and whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm import words as W
from crosspanel.llm.common import release, scratch, tidied

#: Bytes of text and rows that a run has at most; a longer text is a run of its own.
RUN_BYTES, RUN_ROWS = 8 << 20, 1 << 16
_RUNS = "run long, anchor long, path long, times long, texts binary"
_EDGES = "anchor long, path long, edge long, bit int, times long"
_OUT = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, text string"
#: Edges of a path: one bit each in a long.
_BITS = 62


def anchor_size(window: int) -> int:
    """Words of the k-mers that anchor windows: a quarter of the window, or as many as leave a path 62 edges."""
    if window < 1:
        raise ValueError("a window has one word or more")
    return max(1, window // 4, window - _BITS + 1)


class Paths:
    """Paths of texts (raw, at): anchor, whole and size (edges) of each, its first word and its text's row."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, window: int):
        k = anchor_size(window)
        starts, ends, self.first = W.spans(raw, at)
        n = len(starts)
        self.window, self.rows = window, np.zeros(0, dtype=np.int64)
        self.anchor = self.whole = np.zeros(0, dtype=np.uint64)
        self.start = self.size = self.rows
        edges = np.maximum(np.diff(self.first) - window + 1, 0)
        full = np.flatnonzero(edges)
        if not len(full):
            return
        self.up, self.down = W._Powers.to(max(len(raw), n))
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)], out=total[1:])
        words = W.mix((total[ends] - total[starts]) * self.down[starts])
        self.total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(words * self.up[:n], out=self.total[1:])
        kmer = W.mix((self.total[k:] - self.total[:-k]) * self.down[: n - k + 1])
        least, span, width = kmer, 1, window - k + 1
        while 2 * span <= width:
            least, span = np.minimum(least[:-span], least[span:]), 2 * span
        if width > span:
            least = np.minimum(least[: span - width], least[width - span :])
        # A path ends where the least hash changes, or where its leftmost place drops out.
        cut = np.ones(len(least), dtype=bool)
        cut[1:] = (least[1:] != least[:-1]) | (kmer[: len(least) - 1] == least[:-1])
        cut[self.first[full]] = True
        whole_text = np.zeros(len(least) + 1, dtype=np.int8)
        whole_text[self.first[full]] += 1
        np.subtract.at(whole_text, self.first[full] + edges[full], 1)
        self.start = np.flatnonzero(cut & (np.cumsum(whole_text[:-1], dtype=np.int8) > 0))
        self.rows = np.searchsorted(self.first, self.start, "right") - 1
        end = np.minimum(np.append(self.start[1:], len(least)), self.first[self.rows] + edges[self.rows])
        self.size, self.anchor = end - self.start, least[self.start]
        self.whole = self._hash(self.start, self.size + window - 1)

    def _hash(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return W.mix((self.total[start + size] - self.total[start]) * self.down[start] + np.asarray(size).astype(np.uint64) * np.uint64(W.BASE))

    def edges(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the paths numbered which: for each edge its path's number, its place in it, and its hash."""
        size = self.size[which]
        path = np.repeat(which, size)
        bit = np.arange(len(path)) - np.repeat(np.cumsum(size) - size, size)
        return path, bit, self._hash(self.start[path] + bit, self.window)

    def covered(self, which: np.ndarray, masks: np.ndarray) -> np.ndarray:
        """For each word: does it lie under an edge that the mask of its path has?"""
        size = self.size[which]
        bit = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        on = (np.repeat(masks, size) >> bit) & 1 == 1
        at = (np.repeat(self.start[which], size) + bit)[on]
        step = np.bincount(at, minlength=self.first[-1] + 1) - np.bincount(at + self.window, minlength=self.first[-1] + 1)
        return np.cumsum(step[: self.first[-1]]) > 0


def _packed(ids: list[pa.Array], texts: list[pa.Array]) -> bytes:
    sink, table = pa.BufferOutputStream(), pa.table({"doc_id": pa.chunked_array(ids), "text": pa.chunked_array(texts)})
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as writer:
        writer.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def _blocks(packed: pa.Scalar, window: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, Paths]]:
    """Ids, bytes, offsets and paths of some texts of a run at a time."""
    table = pa.ipc.open_stream(packed.as_buffer()).read_all().combine_chunks()
    raw, at = W.text_bytes(table.column("text"))
    for i, j in W.blocks(at):
        part, inside = raw[at[i] : at[j]], at[i : j + 1] - at[i]
        yield table.column("doc_id").slice(i, j - i), part, inside, Paths(part, inside, window)


def _match(paths: Paths, anchor: np.ndarray, whole: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the paths that (anchor, whole) has, and where; order sorts whole."""
    if not len(order) or not len(paths.whole):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = order[np.minimum(np.searchsorted(whole, paths.whole, sorter=order), len(order) - 1)]
    found = np.flatnonzero((whole[at] == paths.whole) & (anchor[at] == paths.anchor))
    return found, at[found]


def _unsigned(table: pa.Table, name: str) -> np.ndarray:
    return np.asarray(table.column(name)).view(np.uint64)


def cut_runs(docs: DataFrame, window: int) -> DataFrame:
    """Rows of two kinds, stored: (run, texts) of each run, and (run, anchor, path, times) of each distinct path in it."""

    def rows(run: int, ids: list[pa.Array], texts: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        packed = pa.scalar(_packed(ids, texts), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([run]), *(pa.nulls(1, pa.int64()) for _ in range(3)), pa.array([packed.as_py()], pa.binary())], names=names)
        parts = [(p.anchor, p.whole) for *_, p in _blocks(packed, window)]
        anchor, whole = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, dtype=np.uint64),) * 2
        order = np.lexsort((whole, anchor))
        anchor, whole = anchor[order], whole[order]
        new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1]))[: len(anchor)])
        times = np.diff(np.append(new, len(anchor)))
        for i in range(0, len(new), 50_000):
            at = new[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), run)), pa.array(anchor[at].view(np.int64)), pa.array(whole[at].view(np.int64)), pa.array(times[i : i + 50_000]), pa.nulls(len(at), pa.binary())], names=names)

    anchor_size(window)  # here already it refuses windows of no word
    names = ["run", "anchor", "path", "times", "texts"]

    @tidied
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, held, size, count = TaskContext.get().partitionId() << 32, [], 0, 0
        for batch in batches:
            text = batch.column("text").cast(pa.large_string())
            _, at = W.text_bytes(text)
            for i, j in W.blocks(at):
                more = int(at[j] - at[i])
                if held and (size + more > RUN_BYTES or count + j - i > RUN_ROWS):
                    yield from rows(run, *zip(*held, strict=True))
                    run, held, size, count = run + 1, [], 0, 0
                held.append((batch.column("doc_id").slice(i, j - i), text.slice(i, j - i)))
                size, count = size + more, count + j - i
        if held:
            yield from rows(run, *zip(*held, strict=True))

    return scratch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(runs, _RUNS))


def repeated_paths(cut: DataFrame) -> DataFrame:
    """(run, anchor, path, times, branches) of the paths whose anchor occurs twice or more, stored. branches: other paths go
    through that anchor; where none does, all edges of the path repeat."""
    paths = cut.filter("anchor is not null").select("run", "anchor", "path", "times")
    anchors = paths.groupBy("anchor").agg(F.sum("times").alias("all_times"), F.min("path").alias("least"), F.max("path").alias("most")).filter("all_times >= 2")
    return scratch(paths.join(anchors.select("anchor", (F.col("least") != F.col("most")).alias("branches")), "anchor").select("run", "anchor", "path", "times", "branches"))


def edge_masks(cut: DataFrame, repeated: DataFrame, window: int) -> DataFrame:
    """(anchor, path, mask) of the paths that branch and have repeated edges: a bit for each repeated edge."""

    def expand(texts: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if asked.num_rows:
            anchor, whole, times = _unsigned(asked, "anchor"), _unsigned(asked, "path"), np.asarray(asked.column("times"))
            order, told = np.argsort(whole), np.zeros(asked.num_rows, dtype=bool)
            for _, _, _, paths in _blocks(texts.column("texts")[0], window):
                which, at = _match(paths, anchor, whole, order)
                at, one = np.unique(at, return_index=True)
                which, at = which[one][~told[at]], at[~told[at]]
                told[at] = True
                path, bit, edge = paths.edges(which)
                found.append((paths.anchor[path].view(np.int64), paths.whole[path].view(np.int64), edge.view(np.int64), bit.astype(np.int32), np.repeat(times[at], paths.size[which])))
        kinds = (np.int64, np.int64, np.int64, np.int32, np.int64)
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, dtype=kind) for kind in kinds]
        release()
        return pa.table(dict(zip(("anchor", "path", "edge", "bit", "times"), columns, strict=True)))

    asked = repeated.filter("branches").groupBy("anchor", "path").agg(F.sum("times").alias("times"), F.min("run").alias("source"))
    runs = cut.filter("texts is not null").select("run", "texts")
    edges = scratch(runs.groupBy("run").cogroup(asked.groupBy("source")).applyInArrow(expand, _EDGES))
    twice = edges.groupBy("anchor", "edge").agg(F.sum("times").alias("n")).filter("n >= 2").select("anchor", "edge")
    return edges.join(twice, ["anchor", "edge"]).groupBy("anchor", "path").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, spans (removed words, start to end), text (the others).

    A word goes if it lies in a window of so many words (runs of characters other than ASCII white space) of its
    text whose words also stand, in order, at any other place of any text; windows are judged before anything goes. Kept words are
    joined by one space. Null and blank texts have no words; texts shorter than a window stay. Rows that repeat
    an id are texts of their own. No rows give no rows; columns other than doc_id and text are ignored.
    A text is held whole in one task, and all else by runs of 8 MB.
    """
    cut = cut_runs(docs, window)
    repeated = repeated_paths(cut)
    masks = edge_masks(cut, repeated, window)

    def judge(texts: pa.Table, known: pa.Table) -> pa.Table:
        anchor, whole, mask = _unsigned(known, "anchor"), _unsigned(known, "path"), np.asarray(known.column("mask"))
        order, out = np.argsort(whole), []
        for ids, raw, at, paths in _blocks(texts.column("texts")[0], window):
            which, where = _match(paths, anchor, whole, order)
            gone, first, data = paths.covered(which, mask[where]), paths.first, raw.tobytes()
            removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[first])
            # Edges of removed spans, also where one text's meets the next one's.
            edge = np.zeros(len(gone) + 1, dtype=bool)
            edge[1:-1] = gone[1:] != gone[:-1]
            edge[[0, -1]] = True
            edge[first] = True
            step = np.flatnonzero(edge)
            span = np.stack([step[:-1], step[1:]], axis=1)[gone[step[:-1]]] if len(gone) else np.zeros((0, 2), dtype=np.int64)
            place = np.searchsorted(span[:, 0], first)
            kept, stay = [], ~gone
            for i, (a, b, s, e) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True)):
                word = data[s:e].split() if removed[i] < b - a else []
                kept.append(b" ".join(compress(word, stay[a:b].tolist()) if removed[i] else word))
            begin = first[np.searchsorted(first, span[:, 0], "right") - 1] if len(span) else span[:, 0]
            spans = pa.ListArray.from_arrays(pa.array(place, pa.int32()), pa.StructArray.from_arrays([pa.array(span[:, 0] - begin), pa.array(span[:, 1] - begin)], names=["start", "end"]))
            out.append(pa.table({"doc_id": ids, "n_words": np.diff(first), "n_removed": removed, "spans": spans, "text": pa.array(kept, pa.binary()).cast(pa.string())}))
        release()
        return pa.concat_tables(out)

    settled = repeated.filter("not branches").select(F.col("run").alias("of"), "anchor", "path", F.lit(-1).cast("long").alias("mask"))
    branching = repeated.filter("branches").join(masks, ["anchor", "path"]).select(F.col("run").alias("of"), "anchor", "path", "mask")
    runs = cut.filter("texts is not null").select("run", "texts")
    return runs.groupBy("run").cogroup(settled.unionByName(branching).groupBy("of")).applyInArrow(judge, _OUT)
