"""Exact deduplication by compressed radix (Patricia) tries.

Texts go to owners, partitions chosen by length and content hash. An owner inserts each full byte string into a trie
whose terminal nodes hold the smallest identifier and the number of rows. Before the shuffle every Arrow batch is
passed through a trie of its own and what it repeats through one of the task, so that of a group of copies however
large few rows of a task reach the owner. Only groups of two and more leave the owners; their verdict is joined back to
the rows by SHA-256, a join that adaptive execution splits where one group is hot.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.llm.common import text_key, tidied, without_rows

#: Bytes of labels and nodes (NODE each, with what it holds) that an owner keeps in memory; beyond them the largest
#: subtree goes to a task-private file. COMBINED is what a task holds of repeated texts before the shuffle.
TRIE_BYTES, NODE, COMBINED = 256 << 20, 400, 32 << 20

_OWNED = "length int, sha binary, text string, keep_id long, group_size long"


class Trie:
    """A compressed radix trie over byte strings: an edge per node, terminals with [smallest id, rows, tag].

    Keys count from byte `depth` on; what lies before is alike in all. When it exceeds `limit` bytes, the child of
    the root with the most bytes is spilled: its entries go to an unlinked temporary file, later ones with the same
    first byte are appended, and `groups` reads each file back into a trie that starts where its keys first differ.
    """

    def __init__(self, limit: int = TRIE_BYTES, depth: int = 0):
        self.limit, self.depth, self.bytes, self.terminals = limit, depth, 0, 0
        self.root: list = [b"", {}, None]  # label, children by first byte, terminal
        self.weight: dict[int, int] = {}
        self.spilled: dict[int, object] = {}

    def add(self, key: bytes, ident: int | None, rows: int, tag: object) -> None:
        head = key[self.depth] if len(key) > self.depth else -1
        if head in self.spilled:
            self._write(self.spilled[head], key[self.depth :], ident, rows, tag)
            return
        grown = self._insert(key, ident, rows, tag)
        self.bytes += grown
        self.weight[head] = self.weight.get(head, 0) + grown
        self.terminals += grown > 0
        if self.bytes > self.limit and self.terminals > 1:
            self._spill(max((h for h in self.weight if h >= 0), key=self.weight.get))

    def _insert(self, key: bytes, ident: int | None, rows: int, tag: object) -> int:
        """Bytes that the trie has grown by: nothing for a key that it has."""
        node, at, forks = self.root, self.depth, 0
        while True:
            if at == len(key):
                if node[2] is None:
                    node[2] = [ident, rows, tag]
                    return NODE * (1 + forks)
                node[2][0] = smaller(node[2][0], ident)
                node[2][1] += rows
                return 0
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = [key[at:], {}, [ident, rows, tag]]
                return len(key) - at + NODE * (1 + forks)
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same = common_prefix(label, key, at)
            fork = [label[:same], {label[same]: child}, None]
            child[0] = label[same:]
            node[1][key[at]] = fork
            node, at, forks = fork, at + same, 1

    def _walk(self, node: list, prefix: bytes) -> Iterator[tuple[bytes, list]]:
        todo = [(node, prefix)]
        while todo:
            node, prefix = todo.pop()
            key = prefix + node[0]
            if node[2] is not None:
                yield key, node[2]
            todo += [(child, key) for child in node[1].values()]

    def _spill(self, head: int) -> None:
        out = tempfile.TemporaryFile()
        child = self.root[1].pop(head, None)
        if child is not None:
            for key, (ident, rows, tag) in self._walk(child, b""):
                self._write(out, key, ident, rows, tag)
        self.bytes -= self.weight.pop(head)
        self.terminals = len(self.weight)
        self.spilled[head] = out

    @staticmethod
    def _write(out, key: bytes, ident: int | None, rows: int, tag: bytes) -> None:
        out.write(len(key).to_bytes(8, "little") + (b"\0" * 9 if ident is None else b"\1" + ident.to_bytes(8, "little", signed=True)) + rows.to_bytes(8, "little") + len(tag).to_bytes(2, "little") + tag + key)

    def entries(self) -> Iterator[tuple[bytes, list]]:
        """Each key that is in memory with its terminal."""
        yield from self._walk(self.root, b"")

    def groups(self) -> Iterator[list]:
        """[smallest id, rows, tag] of each distinct key."""
        for _, terminal in self._walk(self.root, b""):
            yield terminal
        self.root = [b"", {}, None]
        for file in self.spilled.values():
            first, alike = None, 0
            for key, *_ in self._read(file):
                first, alike = (key, len(key)) if first is None else (first, common_prefix(first[:alike], key, 0))
            inner = Trie(self.limit, alike)
            for entry in self._read(file):
                inner.add(*entry)
            file.close()
            yield from inner.groups()

    @staticmethod
    def _read(file) -> Iterator[tuple[bytes, int | None, int, bytes]]:
        file.seek(0)
        while head := file.read(27):
            size, rows, tags = (int.from_bytes(head[a:b], "little") for a, b in ((0, 8), (17, 25), (25, 27)))
            tag = file.read(tags)
            yield file.read(size), int.from_bytes(head[9:17], "little", signed=True) if head[8] else None, rows, tag


def smaller(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def common_prefix(label: bytes, key: bytes, at: int) -> int:
    """Length of the longest common prefix of label and key[at:], found by halving."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if label[low:mid] == key[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


def normalised(text: str = "text"):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _rows(found: list[tuple[bytes, list]]) -> pa.RecordBatch:
    """(key, terminal) with tags (length, sha) as rows for the owners."""
    tags = [t[2] for _, t in found]
    texts = pa.array([key for key, _ in found], pa.binary()).cast(pa.string())
    columns = [pa.array([x[0] for x in tags], pa.int32()), pa.array([x[1] for x in tags], pa.binary()), texts, *(pa.array([t[i] for _, t in found], pa.int64()) for i in (0, 1))]
    return pa.RecordBatch.from_arrays(columns, names=["length", "sha", "text", "keep_id", "group_size"])


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each distinct text of a batch, and for each text that a batch repeats one row of the task (or, past
    COMBINED bytes, a few)."""
    repeated = Trie(limit=1 << 62)
    for batch in batches:
        trie, texts = Trie(limit=1 << 62), batch.column("text").cast(pa.binary()).to_pylist()
        for i, (text, ident, rows) in enumerate(zip(texts, batch.column("keep_id").to_pylist(), batch.column("group_size").to_pylist(), strict=True)):
            trie.add(text, ident, rows, i)
        found = list(trie.groups())
        again = [x for x in found if x[1] > 1]
        length, sha = batch.column("length"), batch.column("sha")
        for ident, rows, i in again:
            repeated.add(texts[i], ident, rows, (length[i].as_py(), sha[i].as_py()))
        found = [x for x in found if x[1] == 1]
        take = batch.take(pa.array([x[2] for x in found], pa.int64()))
        yield pa.RecordBatch.from_arrays([take.column("length"), take.column("sha"), take.column("text"), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["length", "sha", "text", "keep_id", "group_size"])
        if repeated.bytes > COMBINED:
            yield _rows(list(repeated.entries()))
            repeated = Trie(limit=1 << 62)
    if repeated.terminals:
        yield _rows(list(repeated.entries()))


def _own(limit: int):
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(limit)
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for text, *rest in zip(texts.to_pylist(), batch.column("keep_id").to_pylist(), batch.column("group_size").to_pylist(), batch.column("sha").to_pylist(), strict=True):
                trie.add(text, *rest[:2], rest[2])
        found = [x for x in trie.groups() if x[1] > 1]
        for i in range(0, len(found), 10_000):
            part = found[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([x[2] for x in part], pa.binary()), pa.array([x[0] for x in part], pa.int64()), pa.array([x[1] for x in part], pa.int64())], names=["sha", "keep_id", "group_size"])

    return own


def copy_groups(docs: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """(sha, keep_id, group_size) of each text that two or more rows have."""
    text = docs.select(F.col("doc_id").cast("long").alias("keep_id"), normalised().alias("text"))
    rows = text.select(F.octet_length("text").alias("length"), F.unhex(F.sha2("text", 256)).alias("sha"), "text", "keep_id", F.lit(1).cast("long").alias("group_size"))
    combined = rows.mapInArrow(tidied(_combine), _OWNED)
    owners = combined.repartition(_partitions(docs), "length", F.xxhash64("text"))
    return owners.select("sha", "text", "keep_id", "group_size").mapInArrow(tidied(_own(trie_bytes)), "sha binary, keep_id long, group_size long")


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def exact_duplicates(docs: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. Equal texts form a group after white-space runs became one space; its smallest doc_id
    is keep_id (null ids come last). Of rows that repeat keep_id exactly one is kept. An empty table gives no rows;
    columns other than doc_id and text are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(), 256)).alias("sha"))
    # Rows that repeat an id and its text are numbered before the join: after it they would be dealt by hot texts.
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "sha").orderBy("doc_id")))
    out = rows.join(copy_groups(docs, trie_bytes), "sha", "left")
    alone = F.col("group_size").isNull()
    lead = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (lead & (F.col("nth") == 1))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts, that of the smallest id (null ids last); all columns stay.

    Rows are told apart by id and text: of an id that repeats with other texts, each text has its own verdict.
    """
    key = text_key(normalised())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), F.unhex(F.sha2(normalised(), 256)).alias("sha"))
    verdict = rows.join(copy_groups(docs), "sha", "left")
    stays = F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return without_rows(docs, verdict.select("doc_id", "key", stays.alias("stays")), key)
