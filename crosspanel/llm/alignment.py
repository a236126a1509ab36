"""Alignment of two tokenizers: which token of one covers bytes of which token of the other, and how widely.

Both tokenizers cut the same bytes. The union of their token ends cuts a text into pieces that lie in one token of
each: these are the links; the ends that both have cut it into groups. The pairs of ids that are linked are the terms of an
inverted index. Its postings are bitmaps of documents, one container for each pair and block of documents: a sorted list
of places, or one bit for each place where more than an eighth have one. How often a document has the pair is written
beside them in bit planes, plane k holding bit k of (times - 1) of each document that the bitmap names. Containers of
different blocks are disjoint, so the popcount of their union, the documents that hold a pair, is a sum that Spark
combines before it shuffles; documents get their scores from the postings of their block, joined to the counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm import words as W
from crosspanel.llm.common import release, scratch, tidied
from crosspanel.llm.tokens import byte_tokenizer

#: Documents and bytes of text that a block has at most; a longer text is a block of its own.
PLACES, BLOCK_BYTES = 4096, 16 << 20
#: Documents of a block from which a container has a bit for each place (two bytes a document otherwise).
DENSE = PLACES // 8
#: Of the pairs' containers, a pair with over one in so many is joined by broadcast: fewer pairs than that.
COMMON = 100_000
#: A pair of ids is one number, a * WIDTH + b.
WIDTH = 1 << 32
_POSTINGS = "block long, pair long, n_docs long, n_links long, places binary, planes binary, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, groups array<string>"
_SCORES = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


class Aligner:
    """The two tokenizers of a worker: a byte-level vocabulary of ranks, and one of pieces with byte fall-back."""

    def __init__(self, a: str, b: str):
        import sentencepiece

        self.a = byte_tokenizer(a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        self.a_size = np.array([len(self.a.decode_single_token_bytes(i)) for i in range(self.a.max_token_value + 1)])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.b_size = np.array([*map(len, self.b_bytes)])
        self.decimal = pa.array([str(i) for i in range(max(len(self.a_size), len(self.b_size)))])

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of a and b of each text; none for a text that is null, empty, or that b's bytes do not give back."""
        found, none = ([], []), np.zeros(0, dtype=np.int64)
        for text, ids_b in zip(texts, self.b.encode([t or "" for t in texts], num_threads=1), strict=True):
            ids_a, raw = none, f" {text}".encode()
            ids_b = np.array(ids_b if text else [], dtype=np.int64)
            if text and self.b_size[ids_b].sum() == len(raw) and b"".join(map(self.b_bytes.__getitem__, ids_b.tolist())) == raw:
                ids_a = self.a.encode_to_numpy(f" {text}", disallowed_special=()).astype(np.int64)
            found[0].append(ids_a)
            found[1].append(ids_b if len(ids_a) else none)
        return found


@lru_cache(maxsize=2)
def aligner(a: str, b: str) -> Aligner:
    return Aligner(a, b)


class Aligned:
    """Links and groups of some texts: row, id of a and id of b of each link; tokens and groups of each row."""

    def __init__(self, tools: Aligner, texts: list[str | None]):
        a, b = tools.encode(texts)
        self.tools, self.n_a, self.n_b = tools, np.array([*map(len, a)], dtype=np.int64), np.array([*map(len, b)], dtype=np.int64)
        self.a, self.b = (np.concatenate([*x, np.zeros(0, dtype=np.int64)]) for x in (a, b))
        end_a, end_b = np.cumsum(tools.a_size[self.a]), np.cumsum(tools.b_size[self.b])
        size = int(end_a[-1]) if len(end_a) else 0
        marks = np.zeros((2, size), dtype=bool)
        marks[0, end_a - 1] = marks[1, end_b - 1] = True
        piece = np.flatnonzero(marks[0] | marks[1])
        upto_a, upto_b = (np.cumsum(m, dtype=np.int64) for m in marks)
        self.link_a, self.link_b = self.a[upto_a[piece] - marks[0, piece]], self.b[upto_b[piece] - marks[1, piece]]
        both = np.flatnonzero(marks[0] & marks[1])
        self.group_a, self.group_b = (np.concatenate([[0], upto[both]]) for upto in (upto_a, upto_b))
        row_end = np.concatenate([[0], end_a])[np.cumsum(self.n_a)] if size else np.zeros(len(texts), dtype=np.int64)
        self.row = np.searchsorted(row_end, piece, "right")
        self.group_at = np.concatenate([[0], np.searchsorted(both, row_end)])

    def groups(self) -> list[str]:
        """The groups of each row as text: ids of a, a bar, ids of b; a semicolon between groups."""

        def listed(values: pa.Array, at: np.ndarray, by: str) -> pa.Array:
            return pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), values), by)

        sides = [listed(self.tools.decimal.take(pa.array(ids)), at, ",") for ids, at in ((self.a, self.group_a), (self.b, self.group_b))]
        return listed(pc.binary_join_element_wise(*sides, "|"), self.group_at, ";").to_pylist()


def containers(pair: np.ndarray, place: np.ndarray, times: np.ndarray) -> dict[str, pa.Array]:
    """Postings of one block from (pair, place, times): a row for each pair."""
    order = np.lexsort((place, pair))
    pair, place, times = pair[order], place[order], times[order]
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])[: len(pair)])
    n = np.diff(np.append(first, len(pair)))
    row = np.repeat(np.arange(len(first)), n)
    rank = np.arange(len(pair)) - first[row]
    # Bitmaps: the sparse ones first, so that their places are one run of bytes.
    dense = n >= DENSE
    sparse_bytes = place[~dense[row]].astype("<u2").tobytes()
    bits = np.zeros((int(dense.sum()), PLACES), dtype=bool)
    bits[(np.cumsum(dense) - 1)[row[dense[row]]], place[dense[row]]] = True
    rows = np.concatenate([np.flatnonzero(~dense), np.flatnonzero(dense)])
    sizes = np.where(dense, PLACES // 8, 2 * n)[rows]
    places = _binary(sparse_bytes + np.packbits(bits, axis=1, bitorder="little").tobytes(), sizes)
    # Planes of (times - 1), as many as the largest needs.
    extra = times - 1
    deep = np.array([int(x).bit_length() for x in range(256)])
    most = np.maximum.reduceat(extra, first) if len(first) else extra
    planes = np.zeros(len(first), dtype=np.int64)
    while most.any():
        planes, most = planes + deep[most & 255] * (most < 256) + 8 * (most >= 256), most >> 8
    stride = (n + 7) >> 3
    size = planes * stride
    at = np.cumsum(size[rows]) - size[rows]
    begin = np.empty_like(at)
    begin[rows] = at
    bit = np.zeros(8 * int(size.sum()), dtype=bool)
    for k in range(int(planes.max(initial=0))):
        on = np.flatnonzero((planes[row] > k) & ((extra >> k) & 1 == 1))
        bit[8 * (begin[row[on]] + k * stride[row[on]]) + rank[on]] = True
    links = np.add.reduceat(times, first) if len(first) else times
    return {"pair": pa.array(pair[first][rows]), "n_docs": pa.array(n[rows]), "n_links": pa.array(links[rows]), "places": places, "planes": _binary(np.packbits(bit, bitorder="little").tobytes(), size[rows])}


def _binary(data: bytes, sizes: np.ndarray) -> pa.Array:
    at = np.concatenate([[0], np.cumsum(sizes)]).astype("<i8")
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data)]).cast(pa.binary())


def _ragged(sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values of a binary column, and the size of each."""
    values = [*map(bytes, column.to_pylist())]
    return np.frombuffer(b"".join(values), dtype=np.uint8), np.array([*map(len, values)], dtype=np.int64)


def postings_of(n: np.ndarray, places: pa.ChunkedArray, planes: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What containers wrote: row, place and times of each document of each posting. n: documents of each."""
    raw, size = _flat(places)
    end = np.cumsum(size)
    row = np.repeat(np.arange(len(n)), n)
    place = np.empty(len(row), dtype=np.int64)
    dense = n >= DENSE
    of_dense = dense[row]
    sparse = np.flatnonzero(~dense)
    at = np.repeat((end - size)[sparse], 2 * n[sparse]) + _ragged(2 * n[sparse])
    place[~of_dense] = raw[at].view("<u2")
    full = np.flatnonzero(dense)
    for i in range(0, len(full), 256):
        part = full[i : i + 256]
        bits = np.unpackbits(raw[(end - size)[part, None] + np.arange(PLACES // 8)], axis=1, bitorder="little")
        place[np.concatenate([np.arange(a, a + k) for a, k in zip((np.cumsum(n) - n)[part].tolist(), n[part].tolist(), strict=True)])] = np.nonzero(bits)[1]
    raw, size = _flat(planes)
    stride = (n + 7) >> 3
    deep, begin, rank = size // stride, np.cumsum(size) - size, _ragged(n)
    bit, times = np.unpackbits(raw, bitorder="little"), np.ones(len(row), dtype=np.int64)
    for k in range(int(deep.max(initial=0))):
        on = np.flatnonzero(deep[row] > k)
        times[on] += bit[8 * (begin[row[on]] + k * stride[row[on]]) + rank[on]].astype(np.int64) << k
    return row, place, times


def index_pairs(docs: DataFrame, a: str, b: str, digest: bool = False) -> DataFrame:
    """The inverted index, stored, as rows of two kinds: (block, pair, n_docs, n_links, places, planes) for each pair of
    a block of documents, and (block, doc_ids, n_a, n_b, n_groups, groups) for the block; groups as text or its SHA-256."""
    kinds = [pa.int64()] * 4 + [pa.binary()] * 2 + [pa.list_(pa.int64())] * 4 + [pa.list_(pa.string())]
    schema = pa.schema(list(zip(("block", "pair", "n_docs", "n_links", "places", "planes", "doc_ids", "n_a", "n_b", "n_groups", "groups"), kinds, strict=True)))

    def block_rows(block: int, parts: list) -> Iterator[pa.RecordBatch]:
        doc_ids, n_a, n_b, n_groups, groups, keys, times = zip(*parts, strict=True)
        told = [pa.concat_arrays(doc_ids).to_pylist(), *(np.concatenate(x).tolist() for x in (n_a, n_b, n_groups)), [g for x in groups for g in x]]
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, [block, *[None] * 5, *told], strict=True))], schema)
        pair = np.concatenate([k[0] for k in keys])
        made = containers(pair, np.concatenate([k[1] for k in keys]), np.concatenate(times))
        for i in range(0, len(made["pair"]), 50_000):
            part = {k: v.slice(i, 50_000) for k, v in made.items()}
            size = len(part["pair"])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, block)), *part.values(), *(pa.nulls(size, f.type) for f in list(schema)[6:])], schema=schema)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools, block = aligner(a, b), TaskContext.get().partitionId() << 32
        held, count, size = [], 0, 0
        for batch in batches:
            _, at = W.text_bytes(batch.column("text"))
            for i, j in [(x, y) for s, e in W.blocks(at) for x in range(s, e, PLACES // 4) for y in [min(e, x + PLACES // 4)]]:
                if held and (count + j - i > PLACES or size + at[j] - at[i] > BLOCK_BYTES):
                    yield from block_rows(block, held)
                    block, held, count, size = block + 1, [], 0, 0
                found = Aligned(tools, batch.column("text").slice(i, j - i).to_pylist())
                groups = found.groups()
                if digest:
                    groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                pair = found.link_a * WIDTH + found.link_b
                order = np.lexsort((pair, found.row))
                pair, row = pair[order], found.row[order]
                new = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (row[1:] != row[:-1]))[: len(pair)])
                held.append((batch.column("doc_id").slice(i, j - i), found.n_a, found.n_b, np.diff(found.group_at), groups, (pair[new], (row[new] + count).astype(np.int32)), np.diff(np.append(new, len(pair)))))
                count, size = count + j - i, size + int(at[j] - at[i])
        if held:
            yield from block_rows(block, held)

    return scratch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _POSTINGS))


def pair_counts(index: DataFrame) -> DataFrame:
    """(a, b, n_docs, n_links, containers, best): documents and links of each pair of ids in all; best: no pair of this
    a has more documents."""
    pairs = index.filter("pair is not null").groupBy("pair").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"), F.count("*").alias("containers"))
    counts = pairs.select(F.expr(f"pair div {WIDTH}").alias("a"), F.expr(f"pair % {WIDTH}").alias("b"), "n_docs", "n_links", "containers", "pair")
    # As many rows as a's vocabulary has ids.
    highest = counts.groupBy("a").agg(F.max("n_docs").alias("highest"))
    return counts.join(F.broadcast(highest), "a").select("a", "b", "n_docs", "n_links", "containers", (F.col("n_docs") == F.col("highest")).alias("best"), "pair")


def align(docs: DataFrame, a: str, b: str, digest: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    a is a byte-level vocabulary of ranks and reads a space and the text, b a model of pieces that puts that space
    itself; control strings in texts are plain text. A link is a pair of tokens that share bytes; its count is how many
    rows of docs have that pair of ids linked. n_best: links whose count is the highest that their id of a has with
    any id of b, ties included; count_sum: counts of all links. groups: `a1,a2|b1;a3|b2`, or with digest its SHA-256. Texts that are null or
    empty, or whose bytes b changes, have no tokens: zeros, and '' for groups. Rows that repeat an id are documents of
    their own. No rows give no rows; columns other than doc_id and text are ignored. Texts are held whole; a task holds one block.
    """
    index = index_pairs(docs, a, b, digest)
    counts = scratch(pair_counts(index).select("pair", "n_docs", "containers", "best"))
    total = counts.agg(F.sum("containers")).first()[0] or 0
    common = F.col("containers") * COMMON > total
    postings = index.filter("pair is not null").select("block", "pair", F.col("n_docs").alias("n"), "places", "planes")
    frequent = counts.filter(common).select("pair", "n_docs", "best")
    rare = counts.filter(~common).select("pair", "n_docs", "best")
    known = postings.join(F.broadcast(frequent), "pair").unionByName(postings.join(F.broadcast(frequent.select("pair")), "pair", "left_anti").join(rare, "pair"))

    def score(block: pa.Table, found: pa.Table) -> pa.Table:
        doc_ids = block.column("doc_ids")[0].values
        n = np.asarray(found.column("n"))
        row, place, times = postings_of(n, found.column("places"), found.column("planes"))
        sums = np.zeros((3, len(doc_ids)), dtype=np.int64)
        best = found.column("best").to_numpy(zero_copy_only=False).astype(np.int64)[row]
        for out, x in zip(sums, (times, times * best, times * np.asarray(found.column("n_docs"))[row]), strict=True):
            np.add.at(out, place, x)
        release()
        return pa.table({"doc_id": doc_ids, **{c: block.column(c)[0].values for c in ("n_a", "n_b", "n_groups")}, "n_links": sums[0], "n_best": sums[1], "count_sum": sums[2], "groups": block.column("groups")[0].values})

    blocks = index.filter("pair is null").select("block", "doc_ids", "n_a", "n_b", "n_groups", "groups")
    return blocks.groupBy("block").cogroup(known.select(F.col("block").alias("of"), "n", "n_docs", "best", "places", "planes").groupBy("of")).applyInArrow(score, _SCORES)
