"""Near duplicates by SimHash: vantage-point search nominates, exact shingle similarity decides.

Two texts whose five-word shingle sets have a Jaccard similarity of 0.8 differ in about a tenth of the bits of a
fingerprint, more than a vantage-point tree over 64-bit fingerprints can prune at. So each text gets 240 bits (of its
distinct two-word shingles, as the similarity is one of sets), cut into ten words of 24 bits, and each word is searched exactly within radius 2: a pair of
expected distance 20 is missed by all ten words about once in a few thousand pairs. Shards and trees are those of
`simhash`.

Three rounds find the links without listing the pairs of a group. In the first, a shard reports for each text its
smallest and its nearest partner; these pairs are verified on whole texts, and verified links become components. The
second searches the texts that have a partner again, now with a sketch of their five-word shingles, by which a shard
itself rejects pairs clearly below the similarity; of the other pairs between components it reports a spanning forest,
no row a pair. Both texts of such a pair are in one tree, so the third compares the texts of each tree by their whole
sets of shingles, all pairs of different components, and reports a forest of links. Pairs inside a component can change
nothing, so no candidate that matters is left out, and all rounds cost rows in proportion to the texts, also where many
texts are apart and so near to the similarity that no sketch can tell. A tree of more than TREE bytes of sets is
compared block by block, so that no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm import words as W
from crosspanel.llm.common import checkpoint, rows_of, text_key, tidied, without_rows
from crosspanel.llm.components import components
from crosspanel.llm.simhash import LEAF, SAMPLE, Forest, Router, compared, distance, leaves

TABLES, BITS, RADIUS = 10, 24, 2
#: Differing bits of the first 128 beyond which a pair is not looked at: of similar pairs 11 to 19 are expected
#: (standard deviation 4), of unrelated ones 64 (6).
CHECK_BITS = 40
#: Bins of a set sketch (two bits each), and standard deviations below the similarity at which it rejects.
BINS, SURE = 1024, 4.0
#: 2**DEPTH shards for each of the ten words, or as many more as leave about SHARD texts at home in each
#: (SKETCHED where rows carry a set sketch).
DEPTH, SHARD, SKETCHED = 2, 1 << 18, 1 << 16
#: Bytes and rows sketched at once, and pairs of sketches compared at once.
_BYTES, _ROWS, _PAIRS = 1 << 18, 2048, 1 << 14
#: Bytes of sets in a block of a tree, and of small trees that go to one task together.
TREE, TOGETHER = 1 << 24, 1 << 20
#: Hashes looked up at once, and cells of the table that they are looked up in.
_HASHES, _TABLE = 1 << 16, 1 << 24

_LEADERS, _FOREST, _LIKELIEST, _ALL = "leaders", "forest", "likeliest", "all"


def set_sketch(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of its distinct hashes and a sketch of their set: the hashes fall into BINS bins, and of
    each bin the sketch has whether it holds any, and the last bit of the least in it. At most _ROWS rows."""
    n, low = len(at) - 1, np.uint64(14)
    key = np.sort((np.repeat(np.arange(n, dtype=np.uint64), np.diff(at)) << np.uint64(50)) | (hashes >> low))
    key = key[np.diff(key, prepend=~np.uint64(0)) != 0] if len(key) else key
    row = (key >> np.uint64(50)).astype(np.int64)
    place = (key >> np.uint64(50 - BINS.bit_length() + 1)).astype(np.int64)
    least = np.flatnonzero(np.diff(place, prepend=-1))
    bits = np.zeros((2, n * BINS), dtype=np.uint8)
    bits[0, place[least]] = 1
    bits[1, place[least]] = (key[least] & np.uint64(1)).astype(np.uint8)
    packed = np.packbits(bits.reshape(2, n, BINS), axis=2)
    return np.bincount(row, minlength=n), np.concatenate([packed[0], packed[1]], axis=1)


def likeness(sketch: np.ndarray, size: np.ndarray, p: np.ndarray, q: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarity of the pairs p, q by sketches (rows of 64-bit words), and whether it may be `similarity`.

    The bins of the smaller hashes of a pair are a sample of its union; a bin whose two least hashes differ shows
    equal bits half of the time. Both make the estimate vary, by less the smaller the sets.
    """
    half = sketch.shape[1] // 2
    estimate, may = np.zeros(len(p)), np.zeros(len(p), dtype=bool)
    for i in range(0, len(p), _PAIRS):
        a, b = sketch[p[i : i + _PAIRS]], sketch[q[i : i + _PAIRS]]
        shared = a[:, :half] & b[:, :half]
        union = np.bitwise_count(a[:, :half] | b[:, :half]).sum(1, dtype=np.int64)
        both = np.bitwise_count(shared).sum(1, dtype=np.int64)
        same = np.bitwise_count(shared & ~(a[:, half:] ^ b[:, half:])).sum(1, dtype=np.int64)
        m, n = size[p[i : i + _PAIRS]], size[q[i : i + _PAIRS]]
        all_of = np.maximum((m + n) / (1 + similarity), 1)
        sampled = np.maximum(union, 1)
        spread = sampled * similarity * (1 - similarity) * np.maximum(0, 1 - sampled / all_of) + np.maximum(both - similarity * union, 0)
        estimate[i : i + _PAIRS] = (2 * same - both) / sampled
        may[i : i + _PAIRS] = (union == 0) | (estimate[i : i + _PAIRS] >= similarity - (SURE * np.sqrt(spread) + 2) / sampled)
        may[i : i + _PAIRS] &= np.minimum(m, n) + 1 >= similarity * np.maximum(m, n)
    return estimate, may


def sketches(docs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, key, content, check0, check1, size, sketch, w0..w9) of each row: key is a hash of the text, content one
    of its words, check0 and check1 are the first bits, size and sketch belong to its set of k-word shingles."""
    names = ["doc_id", "key", "content", "check0", "check1", "size", "sketch", *[f"w{i}" for i in range(TABLES)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = W.text_bytes(b.column("text"))
            content, bits, size, drawn = [], [], [], []
            for i, j in ((x, min(x + _ROWS, j)) for i, j in W.blocks(at, _BYTES) for x in range(i, j, _ROWS)):
                part, offsets = raw[at[i] : at[j]], at[i : j + 1] - at[i]
                starts, ends, first = W.spans(part, offsets)
                words = W.word_hashes(part, starts, ends)
                place = np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))
                sums = np.concatenate([[np.uint64(0)], np.cumsum(W.mix(words + W.mix(place.astype(np.uint64))), dtype=np.uint64)])
                content.append(sums[first[1:]] - sums[first[:-1]])
                bits.append(W.simhash(*W.distinct(*W.shingle_hashes(words, first, 2)), lanes=4))
                many, drawing = set_sketch(*W.shingle_hashes(words, first, k))
                size.append(many)
                drawn.append(drawing)
            if not content:
                continue
            all_bits = np.concatenate(bits)
            flat = np.unpackbits(all_bits.astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, : TABLES * BITS].reshape(len(all_bits), TABLES, BITS)
            word = flat.astype(np.int64) @ (1 << np.arange(BITS, dtype=np.int64))
            drawing = pa.FixedSizeBinaryArray.from_buffers(pa.binary(BINS // 4), len(all_bits), [None, pa.py_buffer(np.ascontiguousarray(np.concatenate(drawn)))]).cast(pa.binary())
            longs = (np.concatenate(content), *(np.ascontiguousarray(all_bits[:, i]) for i in (0, 1)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), *(pa.array(x.view(np.int64)) for x in longs), pa.array(np.concatenate(size).astype(np.int32)), drawing, *(pa.array(word[:, t].astype(np.int32)) for t in range(TABLES))], names=names)

    kinds = ", ".join([f"{n} long" for n in names[:5]] + ["size int", "sketch binary"] + [f"{n} int" for n in names[7:]])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), kinds)


def _leaders(node: np.ndarray, word: np.ndarray, home: np.ndarray, size: np.ndarray, apart: Callable, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of each text with its smallest and its nearest partner; rows are in order of node.

    Where more than LEAF texts share a word, only the first LEAF are compared with the rest: a text there is also
    paired with itself, which keeps it for the other rounds.
    """
    points = np.flatnonzero(home)
    least, closest = np.full(len(node), len(node), dtype=np.int64), np.full(len(node), np.iinfo(np.int64).max)
    still = np.zeros(len(node), dtype=bool)
    for p, q in leaves(word[points], word, RADIUS):
        if len(p) > LEAF:
            still[q] = True
            p = p[:LEAF]
        for x, y in compared(word[points], word, p, q, RADIUS):
            x, bits = points[x], apart(points[x], y)
            good = (node[x] != node[y]) & (bits <= CHECK_BITS) & (np.minimum(size[x], size[y]) + 1 >= similarity * np.maximum(size[x], size[y]))
            x, y, bits = x[good], y[good], bits[good]
            np.minimum.at(least, y, x)
            np.minimum.at(closest, y, (bits << 40) + x)
    found, still = np.flatnonzero(least < len(node)), np.flatnonzero(still)
    return np.concatenate([least[found], closest[found] & ((1 << 40) - 1), still]), np.concatenate([found, found, still])


def _across(word: np.ndarray, home: np.ndarray, group: np.ndarray, may_link: Callable) -> Iterator:
    """What may_link makes of the pairs of different groups, a leaf at a time; the point comes first."""
    points = np.flatnonzero(home)
    at_home = group[points]
    for p, q in leaves(word[points], word, RADIUS, at_home, group):
        some, back, count = np.unique(at_home[p], return_inverse=True, return_counts=True)
        major, alien = back == count.argmax(), group[q] != some[count.argmax()]
        for pp, qq in ((p[major], q[alien]), (p[~major], q)):
            for x, y in compared(word[points], word, pp, qq, RADIUS):
                x = points[x]
                good = (x < y) & (group[x] != group[y])
                yield may_link(x[good], y[good])


def _best(text: np.ndarray, group: np.ndarray, estimate: np.ndarray, partner: np.ndarray) -> list[np.ndarray]:
    """One row for each text and group, that of the greatest estimate."""
    order = np.lexsort((-estimate, group, text))
    text, group, estimate, partner = (v[order] for v in (text, group, estimate, partner))
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (group[1:] != group[:-1])
    return [v[new] for v in (text, group, estimate, partner)]


def _pairs_of_shard(kind: str, similarity: float) -> Callable:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["node", "home"], ascending=[True, False], kind="stable").reset_index(drop=True)
        node, word, home, size = pdf["node"].to_numpy(), pdf["word"].to_numpy().astype(np.uint64), pdf["home"].to_numpy(), pdf["size"].to_numpy().astype(np.int64)
        checks = [pdf[n].to_numpy().view(np.uint64) for n in ("check0", "check1")]

        def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
            return sum(distance(c[p], c[q]).astype(np.int64) for c in checks)

        if kind == _LEADERS:
            p, q = _leaders(node, word, home, size, apart, similarity)
            a, b = node[p], node[q]
            return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()
        group = pdf["component"].to_numpy()
        sketch = np.frombuffer(b"".join(pdf["sketch"]), dtype=np.uint64).reshape(len(pdf), BINS // 32)

        def may_link(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            near = apart(p, q) <= CHECK_BITS
            p, q = p[near], q[near]
            estimate, may = likeness(sketch, size, p, q, similarity)
            return p[may], q[may], estimate[may]

        if kind == _FOREST:
            forest = Forest(len(pdf))

            def tie(p: np.ndarray, q: np.ndarray) -> None:
                loose = forest.root(p) != forest.root(q)
                forest.link(*may_link(p[loose], q[loose])[:2])

            for _ in _across(word, home, group, tie):
                pass
            root = forest.root(np.arange(len(pdf)))
            tied = np.flatnonzero(root != np.arange(len(pdf)))
            a, b = node[root[tied]], node[tied]
            return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})
        none = np.zeros(0, dtype=np.int64)
        if kind == _ALL:
            found = [(node[p], node[q]) for p, q, _ in _across(word, home, group, may_link)] or [(none, none)]
            return pd.DataFrame({"a": np.concatenate([x for x, _ in found]), "b": np.concatenate([y for _, y in found])})
        best, held = [none, none, np.zeros(0), none], 0
        parts = [best]
        for p, q, estimate in _across(word, home, group, may_link):
            parts.append([np.concatenate([p, q]), np.concatenate([group[q], group[p]]), np.tile(estimate, 2), np.concatenate([q, p])])
            held += len(p)
            if held > 1 << 20:
                parts, held = [_best(*map(np.concatenate, zip(*parts, strict=True)))], 0
        text, other, estimate, partner = _best(*map(np.concatenate, zip(*parts, strict=True)))
        return pd.DataFrame({"text": node[text], "other": other, "estimate": estimate, "partner": node[partner]})

    return run


def candidate_pairs(points: DataFrame, kind: str = _LEADERS, similarity: float = 0.8, depth: int = DEPTH, sample: int = SAMPLE) -> DataFrame:
    """points (node, size, check0, check1, w0..w9) -> distinct pairs (a, b), a <= b, that may be similar.

    leaders: of each text the smallest and the nearest partner; a pair a = b says that a text's partners were not all
    looked at. With columns component and sketch, forest: pairs that tie together the texts of all pairs of different
    components, in each shard fewer than texts. Two more kinds list such pairs, for tables that are small or have no
    large groups; likeliest: for each text and other component the likeliest pair; and all: every one.
    """
    carried = {"check0": "long", "check1": "long", "size": "int"} | ({} if kind == _LEADERS else {"component": "long", "sketch": "binary"})
    depth = max(depth, (points.count() // (SHARD if kind == _LEADERS else SKETCHED)).bit_length())
    pick = np.array([tuple(r) for r in points.select(*[f"w{t}" for t in range(TABLES)]).orderBy(F.xxhash64("node")).limit(sample).collect()], dtype=np.uint64).reshape(-1, TABLES)
    routers = [Router(pick[:, t], depth) for t in range(TABLES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, router in enumerate(routers):
                x = np.asarray(b.column(f"w{t}")).astype(np.uint64)
                home = np.empty(len(x), dtype=np.int64)
                row, shard = router.route(x, 0)
                home[row] = shard
                row, shard = router.route(x, RADIUS)
                yield pa.RecordBatch.from_arrays([pa.array((t * 2**depth + shard).astype(np.int32)), pa.array(home[row] == shard), *(b.column(n).take(pa.array(row)) for n in ("node", f"w{t}", *carried))], names=["shard", "home", "node", "word", *carried])

    routed = points.mapInArrow(tidied(run), "shard int, home boolean, node long, word int, " + ", ".join(f"{n} {t}" for n, t in carried.items()))
    shape = "text long, other long, estimate double, partner long" if kind == _LIKELIEST else "a long, b long"
    found = routed.groupBy("shard").applyInPandas(_pairs_of_shard(kind, similarity), shape)
    if kind == _LIKELIEST:
        best = found.groupBy("text", "other").agg(F.max(F.struct("estimate", "partner"))["partner"].alias("partner"))
        found = best.select(F.least("text", "partner").alias("a"), F.greatest("text", "partner").alias("b"))
    return found.distinct()


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    raw, at = W.text_bytes(column)
    for i, j in W.blocks(at, _BYTES):
        part, offsets = raw[at[i] : at[j]], at[i : j + 1] - at[i]
        starts, ends, first = W.spans(part, offsets)
        h, to = W.shingle_hashes(W.word_hashes(part, starts, ends), first, k)
        for x, y in zip(to[:-1], to[1:], strict=True):
            yield np.unique(h[x:y])


def verified(pairs: DataFrame, texts: DataFrame, k: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets of k-word shingles have that Jaccard similarity or more; texts is (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(_sets(batch.column("text_a"), k), _sets(batch.column("text_b"), k), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return with_b.select("a", "b", "text_a", "text_b").mapInArrow(tidied(run), "a long, b long")


def shared(hashes: np.ndarray, at: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How many hashes each of the sets p (rows) has in common with each of the sets q; set i is hashes[at[i]:at[i + 1]]."""
    out, n = np.zeros((len(p), len(q)), dtype=np.int64), np.diff(at)
    known, place = np.unique(np.concatenate([hashes[at[i] : at[i + 1]] for i in p]), return_inverse=True)
    if not len(known):
        return out
    held = np.zeros((len(known) + 1, len(p)), dtype=np.uint8)
    held[place, np.repeat(np.arange(len(p)), n[p])] = 1
    to = np.concatenate([[0], np.cumsum(n[q])])
    for i, j in W.blocks(to, _HASHES):
        start = to[i:j] - to[i]
        looked = hashes[np.repeat(at[q[i:j]] - start, n[q[i:j]]) + np.arange(to[j] - to[i])]
        spot = np.minimum(np.searchsorted(known, looked), len(known) - 1)
        full = np.flatnonzero(n[q[i:j]])
        if len(full):
            out[:, i + full] = np.add.reduceat(held[np.where(known[spot] == looked, spot, len(known))], start[full], axis=0, dtype=np.int32).T
    return out


def _links_of_trees(similarity: float) -> Callable:
    """Of each tree of a frame the links between components, as a spanning forest of these; with i < j only those
    between texts of block i and of block j."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tree", "component", "node"], kind="stable").reset_index(drop=True)
        names, group = np.unique(pdf["component"].to_numpy(), return_inverse=True)
        part, i, j = pdf["part"].to_numpy(), pdf["i"].iloc[0], pdf["j"].iloc[0]
        hashes, size = np.frombuffer(b"".join(pdf["shingles"]), dtype=np.uint64), pdf["shingles"].str.len().to_numpy() // 8
        at, forest = np.concatenate([[0], np.cumsum(size)]), Forest(len(names))
        for rows in np.split(np.arange(len(pdf)), np.flatnonzero(np.diff(pdf["tree"].to_numpy())) + 1):
            left, right = rows[part[rows] == i], rows[part[rows] == j]
            wide = max(1, min(LEAF, int((_TABLE / max(1, size[rows].max())) ** 0.5)))
            for x in range(0, len(left), wide):
                p, q = left[x : x + wide], right[x + 1 :] if i == j else right
                root, other = forest.root(group[p]), forest.root(group[q])
                q = q[(other != root[0]) | (root != root[0]).any()]
                if len(q):
                    both = shared(hashes, at, p, q)
                    a, b = np.nonzero(both >= similarity * (size[p][:, None] + size[q] - both) - 1e-9)
                    forest.link(group[p[a]], group[q[b]])
        root = forest.root(np.arange(len(names)))
        tied = np.flatnonzero(root != np.arange(len(names)))
        return pd.DataFrame({"a": names[root[tied]], "b": names[tied]})

    return run


def tree_links(members: DataFrame, texts: DataFrame, k: int, similarity: float) -> DataFrame:
    """members (node, component, tree), texts (node, text) -> pairs (a, b) of components that tie together all
    components with similar texts in one tree: all pairs of its texts are compared by their sets of k-word shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shingles = pa.array([x.tobytes() for x in _sets(b.column("text"), k)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("node", "component", "tree")), shingles], names=["node", "component", "tree", "shingles"])

    sets = checkpoint(members.join(texts, "node").select("node", "component", "tree", "text").mapInArrow(tidied(run), "node long, component long, tree long, shingles binary"))
    trees = checkpoint(sets.groupBy("tree").agg(F.sum(F.length("shingles")).alias("bytes")))
    tasks = (trees.agg(F.sum("bytes")).first()[0] or 0) // TOGETHER + 1
    dealt = (
        sets.join(trees.select("tree", (F.floor(F.col("bytes") / TREE) + 1).cast("int").alias("parts")), "tree")
        .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(F.pmod(F.xxhash64("tree"), F.lit(tasks)).alias("task"), F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "tree", "part", "component", "node", "shingles")
    )
    return dealt.groupBy("task", "i", "j").applyInPandas(_links_of_trees(similarity), "a long, b long")


def _row_groups(docs: DataFrame, k: int, similarity: float) -> DataFrame:
    """(doc_id, key, component) of each row of docs; component is a number of no meaning."""
    rows = checkpoint(sketches(docs, k))
    same = ["content", "check0", "check1", "size", *[f"w{t}" for t in range(TABLES)]]
    # Rows of equal words are one point; its number is settled by the checkpoint. One of its rows lends it a text.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key"))
    points = checkpoint(rows.groupBy(*same).agg(first.alias("first"), F.first("sketch").alias("sketch")).withColumn("node", F.monotonically_increasing_id()))
    pairs = checkpoint(candidate_pairs(points, _LEADERS, similarity))

    def ends(of: DataFrame) -> DataFrame:
        return of.select(F.explode(F.array("a", "b")).alias("node")).distinct()

    def grouped(some: DataFrame, links: DataFrame) -> DataFrame:
        return some.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))

    partnered = checkpoint(points.join(ends(pairs), "node", "left_semi"))
    lent = partnered.select("node", F.col("first.doc_id").alias("doc_id"), F.col("first.key").alias("key"))
    texts = checkpoint(rows_of(docs.select("doc_id", "text"), lent).select("node", "text").dropDuplicates(["node"]))
    links = checkpoint(verified(pairs.filter("a < b"), texts, k, similarity))
    named = checkpoint(grouped(partnered, links))
    trees = components(candidate_pairs(named, _FOREST, similarity)).withColumnRenamed("component", "tree")
    members = named.select("node", "component").join(trees, "node")
    found = components(links.unionByName(tree_links(members, texts, k, similarity)))
    numbered = rows.select("doc_id", "key", *same).join(points.select("node", *same), same).select("doc_id", "key", "node")
    return numbered.join(found, "node", "left").select("doc_id", "key", F.coalesce("component", "node").alias("component"))


def near_duplicate_groups(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of each row: the smallest doc_id reachable over verified links.

    Texts of the same words are equal; a text of fewer than k words is one shingle, and null and blank texts have
    none: they are equal to each other only. Rows are told apart by id and text, so those that repeat an id with
    another text are texts of their own. Rows without an id take part; a group of such rows only has no component_id.
    An empty table gives no rows.
    """
    rows = checkpoint(_row_groups(docs, k, similarity))
    least = rows.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "component").select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of near duplicates, that of the smallest id (null ids last, then any text of
    that id); all columns stay. Rows equal in id and text are copies, of which one stays."""
    rows = checkpoint(_row_groups(docs, k, similarity))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    lead = rows.groupBy("component").agg(F.min(order).alias("lead"))
    return without_rows(docs, rows.join(lead, "component").select("doc_id", "key", (order == F.col("lead")).alias("stays")))
