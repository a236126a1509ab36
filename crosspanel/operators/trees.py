"""Gradient boosted histogram trees for squared error: each level of each tree is one aggregation over the rows.

Features become one-byte codes of quantile bins, the last code for missing values. A level of a tree needs, for each of
its nodes, feature and bin, the sums of gradients and the counts: each task makes that small table of its rows and the
tables are added up in a tree of tasks. The driver sees nothing else, whatever the number of rows: nodes x features x
256 pairs of numbers. A split sends missing values to the side that gains more. Monotone features
refuse splits against their sign and pass the middle of the two leaves on as a bound for all leaves below.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CODES = 256
MISSING = CODES - 1
#: Rounds after which rows carry their prediction so far, written with their codes; between, tasks apply the newer trees.
REFRESH = 20
#: Codes (rows x features, a byte each) up to which one task grows all trees.
SMALL = 1 << 22
#: Partitions from which tables are added up in two steps.
MANY = 64


@dataclass(frozen=True)
class Settings:
    rounds: int = 200
    depth: int = 2
    rate: float = 0.05
    rows: float = 0.8
    features: float = 0.8
    l1: float = 1.0
    l2: float = 1.0
    least: float = 5.0
    seed: int = 42


@dataclass
class Tree:
    """Nodes in level order, the children of i at 2i+1 and 2i+2; feature -1 is a leaf. Codes up to cut go left."""

    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, dtype=int), np.zeros(n, dtype=bool), np.zeros(n))

    def leaf(self, codes: np.ndarray) -> np.ndarray:
        """The node in which each row ends."""
        at = np.zeros(len(codes), dtype=np.int64)
        for _ in range(int(np.log2(len(self.feature) + 1)) - 1):
            split = self.feature[at] >= 0
            code = codes[np.arange(len(codes)), np.maximum(self.feature[at], 0)]
            left = np.where(code == MISSING, self.missing_left[at], code <= self.cut[at])
            at = np.where(split, 2 * at + np.where(left, 1, 2), at)
        return at


@dataclass
class Model:
    features: list[str]
    edges: list[np.ndarray]
    start: float
    trees: list[Tree] = field(default_factory=list)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """x (rows by features, NaN for missing) -> codes: the first edge that is not below the value."""
        out = np.full(x.shape, MISSING, dtype=np.uint8)
        for i, edges in enumerate(self.edges):
            known = ~np.isnan(x[:, i])
            out[known, i] = np.searchsorted(edges, x[known, i])
        return out

    def predict(self, codes: np.ndarray) -> np.ndarray:
        return sum((t.value[t.leaf(codes)] for t in self.trees), np.full(len(codes), self.start))

    def table(self, spark: SparkSession) -> DataFrame:
        """(tree, node, feature, threshold, missing_left, value): the fitted trees as rows; feature is null in a leaf."""
        rows = []
        for k, t in enumerate(self.trees):
            for i in range(len(t.feature)):
                reached = i == 0 or t.feature[(i - 1) // 2] >= 0
                if reached and t.feature[i] >= 0:
                    edges = np.append(self.edges[t.feature[i]], np.inf)  # a cut past the last edge parts known from missing values
                    rows.append((k, i, self.features[t.feature[i]], float(edges[min(t.cut[i], len(edges) - 1)]), bool(t.missing_left[i]), None))
                elif reached:
                    rows.append((k, i, None, None, None, float(t.value[i])))
        return spark.createDataFrame(rows, "tree int, node int, feature string, threshold double, missing_left boolean, value double")


def sampled(uid: np.ndarray, seed: int, round_: int, share: float) -> np.ndarray:
    """Whether a row takes part in a round: by a hash of its id, so that it does not matter where the row is."""
    x = uid.view(np.uint64) ^ np.uint64((seed * 1_000_003 + round_ + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) < share * 2**53


def allowed(n: int, settings: Settings, round_: int) -> np.ndarray:
    """The features that a tree may split by."""
    return np.sort(np.random.default_rng([settings.seed, round_]).permutation(n)[: max(1, int(settings.features * n))])


def leaf_weight(g: np.ndarray, h: np.ndarray, s: Settings, low: float = -np.inf, high: float = np.inf) -> np.ndarray:
    return np.clip(-np.sign(g) * np.maximum(np.abs(g) - s.l1, 0.0) / (h + s.l2), low, high)


def loss_saved(g: np.ndarray, h: np.ndarray, w: np.ndarray, s: Settings) -> np.ndarray:
    return -(2 * g * w + (h + s.l2) * w * w + 2 * s.l1 * np.abs(w))


def best_split(table: np.ndarray, use: np.ndarray, monotone: np.ndarray, s: Settings, low: float, high: float) -> tuple[int, int, bool, float, float] | None:
    """table (features, codes, 2) of one node -> feature, cut, missing_left and the weights of both sides, or None."""
    g, h = table[..., 0], table[..., 1]
    total_g, total_h = g[0].sum(), h[0].sum()
    left_g, left_h = np.cumsum(g[:, :MISSING], axis=1)[use], np.cumsum(h[:, :MISSING], axis=1)[use]
    # Missing values on the right, then on the left.
    left_g = np.stack([left_g, left_g + g[use, MISSING, None]], axis=2)
    left_h = np.stack([left_h, left_h + h[use, MISSING, None]], axis=2)
    w_left, w_right = leaf_weight(left_g, left_h, s, low, high), leaf_weight(total_g - left_g, total_h - left_h, s, low, high)
    gain = loss_saved(left_g, left_h, w_left, s) + loss_saved(total_g - left_g, total_h - left_h, w_right, s)
    gain -= loss_saved(total_g, total_h, leaf_weight(total_g, total_h, s, low, high), s)
    fits = (left_h >= s.least) & (total_h - left_h >= s.least) & (monotone[use, None, None] * (w_right - w_left) >= 0)
    gain = np.where(fits, gain, -np.inf)
    # Gains that differ by rounding count as equal: the first feature, cut and side of them.
    best = int(np.argmax(gain >= gain.max() - 1e-9 * max(1.0, abs(gain.max())))) if gain.size else 0
    if not gain.size or gain.flat[best] <= 1e-9:
        return None
    f, cut, side = np.unravel_index(best, gain.shape)
    return int(use[f]), int(cut), bool(side), float(w_left.flat[best]), float(w_right.flat[best])


def bin_edges(frame: DataFrame, features: list[str], *more: Column) -> tuple[list[np.ndarray], list]:
    """Upper edges of the bins of each feature (quantiles, at most 254; the highest bin has no edge), and aggregates in the same pass."""
    steps = [i / (MISSING - 1) for i in range(MISSING)]
    one = frame.agg(*more, *[F.percentile_approx(f, F.lit(steps), 10_000).alias(f"_{i}") for i, f in enumerate(features)]).first()
    return [np.unique(np.array(x if x is not None else [], dtype=float))[:-1] for x in one[len(more) :]], list(one[: len(more)])


def _blocks(rows: DataFrame, model: Model) -> RDD:
    """(codes, y, uid) of a batch of rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.array(b.column("x").to_pylist(), dtype=float).reshape(b.num_rows, -1)
                made = [model.codes(x).tobytes(), np.asarray(b.column("y"), dtype=float).tobytes(), np.asarray(b.column("uid")).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([m], pa.binary()) for m in made], names=["codes", "y", "uid"])

    width = len(model.features)
    made = rows.mapInArrow(run, "codes binary, y binary, uid binary").rdd
    return made.map(lambda r: (np.frombuffer(r.codes, dtype=np.uint8).reshape(-1, width), np.frombuffer(r.y), np.frombuffer(r.uid, dtype=np.int64), None))


def _count(part: Iterable[tuple], model: Model, fresh: int, tree: Tree, level: int, round_: int, s: Settings) -> np.ndarray:
    """(nodes of the level, features, codes, 2): sums of gradients and counts of the sampled rows of some blocks."""
    first, nodes, width = 2**level - 1, 2**level, len(model.features)
    newer = Model(model.features, model.edges, 0.0, model.trees[fresh:])
    out = np.zeros((nodes, width, CODES, 2))
    for codes, y, uid, before in part:
        keep = sampled(uid, s.seed, round_, s.rows)
        codes, at = codes[keep], tree.leaf(codes[keep])
        gradient = (model.start if before is None else before[keep]) + newer.predict(codes) - y[keep]
        inside = at >= first
        cell = (at[inside] - first) * CODES
        for f in range(width):
            where = cell + codes[inside, f]
            out[:, f, :, 0] += np.bincount(where, gradient[inside], nodes * CODES).reshape(nodes, CODES)
            out[:, f, :, 1] += np.bincount(where, minlength=nodes * CODES).reshape(nodes, CODES)
    return out


def _moved(block: tuple, model: Model, fresh: int) -> tuple:
    """The block with the prediction of all trees so far; it had that of the first `fresh`."""
    codes, y, uid, before = block
    newer = Model(model.features, model.edges, 0.0, model.trees[fresh:])
    return codes, y, uid, (model.start if before is None else before) + newer.predict(codes)


class _Here:
    """Blocks in the memory of one task."""

    every = 1

    def __init__(self, part: Iterable[tuple]):
        self.part = list(part)

    def tables(self, *what) -> np.ndarray:
        return _count(self.part, *what)

    def move(self, model: Model, fresh: int) -> None:
        self.part = [_moved(b, model, fresh) for b in self.part]


class _Spread:
    """Blocks in the partitions of an RDD; the tables of its tasks are added up."""

    every = REFRESH

    def __init__(self, blocks: RDD):
        self.blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)

    def tables(self, *what) -> np.ndarray:
        parts = self.blocks.mapPartitions(lambda part: [_count(part, *what)])
        return parts.treeReduce(np.add, 2 if parts.getNumPartitions() > MANY else 1)

    def move(self, model: Model, fresh: int) -> None:
        now = Model(model.features, model.edges, model.start, [*model.trees])
        old, self.blocks = self.blocks, self.blocks.map(lambda b: _moved(b, now, fresh)).persist(StorageLevel.MEMORY_AND_DISK)
        self.blocks.count()
        old.unpersist()


def _grow(model: Model, held: _Here | _Spread, sign: np.ndarray, s: Settings) -> Model:
    fresh = 0
    for round_ in range(s.rounds):
        if round_ - fresh >= held.every:
            held.move(model, fresh)
            fresh = round_
        tree, use, bounds = Tree.empty(s.depth), allowed(len(model.features), s, round_), {0: (-np.inf, np.inf)}
        for level in range(s.depth):
            tables, grown = held.tables(model, fresh, tree, level, round_, s), False
            for i in range(2**level - 1, 2 ** (level + 1) - 1):
                if i not in bounds:
                    continue
                low, high = bounds[i]
                table = tables[i - 2**level + 1]
                if level == 0:
                    tree.value[0] = s.rate * leaf_weight(*table[0].sum(axis=0), s)
                found = best_split(table, use, sign, s, low, high)
                if found is None:
                    continue
                f, cut, side, w_left, w_right = found
                tree.feature[i], tree.cut[i], tree.missing_left[i], grown = f, cut, side, True
                tree.value[2 * i + 1], tree.value[2 * i + 2] = s.rate * w_left, s.rate * w_right
                middle = (w_left + w_right) / 2
                up, down = (low, min(high, middle)), (max(low, middle), high)
                bounds[2 * i + 1], bounds[2 * i + 2] = (up, down) if sign[f] > 0 else (down, up) if sign[f] < 0 else ((low, high),) * 2
            if not grown:
                break
        model.trees.append(tree)
    return model


def fit(frame: DataFrame, features: list[str], target: str, key: str, monotone: dict[str, int] | None = None, settings: Settings | None = None) -> Model:
    """Boosted trees of target by features. Null and NaN features are missing; rows without target take no part.

    key names a row for the sampling by rounds. monotone: 1 or -1 for features by which predictions must not fall or rise.
    Rows of up to SMALL codes are one task's work, which then costs no job a level; the trees are the same.
    A frame without any target gives a model without trees that predicts zero.
    """
    s = settings or Settings()
    clean = [F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")).alias(f) for f in features]
    known = frame.filter(F.col(target).isNotNull()).select(*clean, F.col(target).cast("double").alias("_y"), F.xxhash64(key).alias("_uid"))
    edges, (start, rows) = bin_edges(known, features, F.avg("_y"), F.count("*"))
    model = Model(features, edges, start or 0.0)
    if start is None:
        return model
    sign = np.array([(monotone or {}).get(f, 0) for f in features])
    x = F.array(*[F.coalesce(F.col(f), F.lit(float("nan"))) for f in features])
    blocks = _blocks(known.select(x.alias("x"), F.col("_y").alias("y"), F.col("_uid").alias("uid")), model)
    if rows * len(features) <= SMALL:
        return blocks.coalesce(1).mapPartitions(lambda part: [_grow(model, _Here(part), sign, s)]).first()
    held = _Spread(blocks)
    _grow(model, held, sign, s)
    held.blocks.unpersist()
    return model


def predicted(model: Model) -> Column:
    """The model's prediction for each row, from its columns of features."""
    held = model

    @F.pandas_udf("double")
    def run(x):
        import pandas as pd

        values = np.array(x.tolist(), dtype=float).reshape(len(x), len(held.features))
        return pd.Series(held.predict(held.codes(values)))

    return run(F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in model.features]))
