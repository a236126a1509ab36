"""SimHash fingerprints and exact Hamming neighbours by vantage-point trees.

The upper levels of one vantage-point tree, fitted on a bounded sample of fingerprints, cut the space into shards. A
fingerprint lives in the shard that the tree routes it to and is a query in every shard whose boundary is within the
radius (triangle bound), so each shard finds its pairs alone and none is lost, whatever the sample was. Inside a shard
the tree goes on down to small leaves. A shard never emits its pairs but a spanning forest of them (or, for pairs that
must be verified, a few leaders a fingerprint), so groups of copies cost rows in proportion to their size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosspanel.llm import words as W
from crosspanel.llm.common import checkpoint
from crosspanel.llm.components import components

#: Fingerprints that the upper tree is fitted on.
SAMPLE = 4096
#: Depth of the upper tree: 2**DEPTH shards, or as many more as leave about SHARD fingerprints at home in each.
DEPTH, SHARD = 6, 1 << 17
#: A leaf is compared whole.
LEAF = 96
#: Pairs compared at once.
CELLS = 1 << 18


def xxh64_fingerprints(column: pa.Array, k: int = 3) -> np.ndarray:
    """Majority bits of the XXH64 (seed 42) of the k-word shingles of each text."""
    out = np.zeros(len(column), dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(column.cast(pa.binary()).to_pylist()):
        word = (text or b"").lower().split()
        if not word:
            continue
        line = b" ".join(word)
        end = np.cumsum(np.fromiter(map(len, word), dtype=np.int64, count=len(word)) + 1)
        if len(word) <= k:
            out[i] = digest(line, 42)
            continue
        starts, ends = [0, *end[:-k].tolist()], (end[k - 1 :] - 1).tolist()
        ones, n = np.zeros(64, dtype=np.int64), len(starts)
        for j in range(0, n, 65_536):
            h = np.array([digest(line[a:b], 42) for a, b in zip(starts[j : j + 65_536], ends[j : j + 65_536], strict=True)], dtype="<u8")
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[i] = np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the 64-bit fingerprint as a signed long. Null or blank text: zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(xxh64_fingerprints(b.column("text"), k).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Router:
    """The upper levels of a vantage-point tree: node i has children 2i+1 (inside) and 2i+2 (outside)."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.point, self.cut = np.zeros(2**depth - 1, dtype=np.uint64), np.full(2**depth - 1, 64, dtype=np.int64)
        todo = [(0, np.unique(sample))]
        while todo:
            node, x = todo.pop()
            if node >= len(self.point) or not len(x):
                continue
            self.point[node] = x[W.mix(x).argmin()]
            d = distance(x, self.point[node]).astype(np.int64)
            self.cut[node] = int(np.median(d))
            todo += [(2 * node + 1, x[d <= self.cut[node]]), (2 * node + 2, x[d > self.cut[node]])]

    def route(self, x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, shard) for each shard that holds points within radius of x; radius 0 gives the home shard."""
        row, node = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
        for _ in range(self.depth):
            d = distance(x[row], self.point[node]).astype(np.int64)
            inside, outside = d <= self.cut[node] + radius, d > self.cut[node] - radius
            row, node = np.concatenate([row[inside], row[outside]]), np.concatenate([2 * node[inside] + 1, 2 * node[outside] + 2])
        return row, node - (2**self.depth - 1)


def leaves(points: np.ndarray, queries: np.ndarray, radius: int, point_group: np.ndarray | None = None, query_group: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Leaves of a vantage-point tree over the points: indices of its points and of the queries that may be within
    radius of one. A leaf of more than LEAF points holds one value only.

    With groups, a subtree whose points and queries are all of one group is passed over.
    """
    todo = [(np.arange(len(points)), np.arange(len(queries)))]
    while todo:
        p, q = todo.pop()
        if not len(p) or not len(q):
            continue
        if point_group is not None and (point_group[p] == point_group[p[0]]).all() and (query_group[q] == point_group[p[0]]).all():
            continue
        if len(p) > LEAF:
            v = points[p[W.mix(points[p]).argmin()]]
            dp, dq = distance(points[p], v).astype(np.int64), distance(queries[q], v).astype(np.int64)
            if dp.max():
                cut = min(int(np.median(dp)), int(dp.max()) - 1)
                inside = dp <= cut
                todo += [(p[inside], q[dq <= cut + radius]), (p[~inside], q[dq > cut - radius])]
                continue
            q = q[dq <= radius]
        yield p, q


def compared(points: np.ndarray, queries: np.ndarray, p: np.ndarray, q: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (point, query) within radius of points p and queries q, at most CELLS compared at once."""
    wide = max(1, CELLS // max(1, min(len(p), LEAF)))
    for i in range(0, len(p), LEAF):
        for j in range(0, len(q), wide):
            a, b = np.nonzero(distance(points[p[i : i + LEAF]][:, None], queries[q[j : j + wide]][None, :]) <= radius)
            if len(a):
                yield p[i + a], q[j + b]


def near(points: np.ndarray, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (point, query) within radius, leaf by leaf."""
    for p, q in leaves(points, queries, radius):
        yield from compared(points, queries, p, q, radius)


class Forest:
    """Union-find over 0..n-1 whose roots are the smallest member."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while True:
            s = self.up[r]
            if (s == r).all():
                return r
            r = s

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root(a), self.root(b)
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.up, np.maximum(x, y), np.minimum(x, y))


def route_to_shards(spark: SparkSession, points: DataFrame, radius: int, depth: int, sample: int = SAMPLE) -> DataFrame:
    """points (node, fp) -> (shard, home, node, fp), a row for the home and for each shard that may hold neighbours."""
    pick = [r[0] for r in points.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()]
    router = Router(np.array(pick, dtype=np.int64).view(np.uint64), depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column("fp")).view(np.uint64)
            home = np.empty(len(x), dtype=np.int64)
            row, shard = router.route(x, 0)
            home[row] = shard
            row, shard = router.route(x, radius)
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(home[row] == shard), b.column("node").take(pa.array(row)), b.column("fp").take(pa.array(row))], names=["shard", "home", "node", "fp"])

    return points.select("node", "fp").mapInArrow(run, "shard int, home boolean, node long, fp long")


def _forest_of_shard(radius: int) -> Callable:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", kind="stable")
        node, x, home = pdf["node"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64), pdf["home"].to_numpy()
        points, forest = np.flatnonzero(home), Forest(len(pdf))
        for p, q in near(x[points], x, radius):
            forest.link(points[p], q)
        root = forest.root(np.arange(len(pdf)))
        tied = root != np.arange(len(pdf))
        return pd.DataFrame({"a": node[root[tied]], "b": node[tied]})

    return run


def hamming_components(fps: DataFrame, radius: int = 2, depth: int = DEPTH) -> DataFrame:
    """(fp, component_id) of each distinct fp of fps (doc_id, fp): the smallest doc_id reachable over links of at most
    radius differing bits."""
    points = checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("node")))
    routed = route_to_shards(fps.sparkSession, points, radius, max(depth, (points.count() // SHARD).bit_length()))
    edges = routed.groupBy("shard").applyInPandas(_forest_of_shard(radius), "a long, b long")
    found = components(edges)
    return points.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))


def simhash_components(docs: DataFrame, k: int = 3, radius: int = 2, depth: int = DEPTH) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hexadecimal digits), component_id.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. A text of fewer than k words is one
    shingle; null and blank texts have fingerprint zero and link like any other. Equal fingerprints are compared once.
    Rows of null id take part with their text: they get the component of their fingerprint. An empty table gives none.
    """
    fps = checkpoint(fingerprints(docs, k))
    found = hamming_components(fps, radius, depth)
    return fps.join(found, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
