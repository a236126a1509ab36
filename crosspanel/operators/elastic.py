"""Elastic net by cross-validation, all of it from one aggregation.

The sums of products of features and target, one table for each fold, hold everything: standardising, centring on a training
set, the path of coefficients, and the squared error on the fold that was left out. A training set is the total less
its fold, so 60 settings in five folds cost no further pass over the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crosspanel.operators.scores import linear_score
from crosspanel.operators.surrogate import grams

# The strengths tried, and the shares of the absolute penalty in them.
ALPHAS = np.logspace(-4, 1, 20)
RATIOS = (0.1, 0.5, 0.9)
#: Steps of the descent at most, and the change of a standardised coefficient at which it ends.
STEPS, CLOSE = 100_000, 1e-10


@dataclass
class ElasticNet:
    """A fitted model on raw features: missing values count as medians, features are standardised before their coefficients."""

    features: list[str]
    medians: np.ndarray
    means: np.ndarray
    scales: np.ndarray
    coefficients: np.ndarray
    intercept: float
    alpha: float
    ratio: float
    errors: np.ndarray

    def score(self) -> Column:
        parts = zip(self.features, self.coefficients, self.medians, self.means, self.scales, strict=True)
        return linear_score(float(self.intercept), {f: (float(c), float(m), float(a), float(s)) for f, c, m, a, s in parts})

    def parameters(self, spark: SparkSession) -> DataFrame:
        """(feature, coefficient, median, mean, scale), the intercept's row first."""
        rows = [("intercept", float(self.intercept), 0.0, 0.0, 1.0)]
        rows += [(f, *map(float, x)) for f, *x in zip(self.features, self.coefficients, self.medians, self.means, self.scales, strict=True)]
        return spark.createDataFrame(rows, "feature string, coefficient double, median double, mean double, scale double")

    def path(self, spark: SparkSession) -> DataFrame:
        """(l1_ratio, alpha, error, chosen): mean squared error over the folds of each setting."""
        best = np.unravel_index(np.argmin(self.errors), self.errors.shape)
        rows = [(r, float(a), float(self.errors[i, j]), (i, j) == best) for i, r in enumerate(RATIOS) for j, a in enumerate(ALPHAS)]
        return spark.createDataFrame(rows, "l1_ratio double, alpha double, error double, chosen boolean")


def descend(gram: np.ndarray, product: np.ndarray, alpha: float, ratio: float, start: np.ndarray) -> np.ndarray:
    """Minimises w'Gw/2 - q'w + alpha (ratio |w| + (1 - ratio) w'w / 2) coordinate by coordinate from start."""
    w, shrink, pull = start.copy(), alpha * ratio, alpha * (1 - ratio)
    rest = product - gram @ w
    for _ in range(STEPS):
        moved = 0.0
        for j in range(len(w)):
            if gram[j, j] + pull <= 0:
                continue
            old, free = w[j], rest[j] + gram[j, j] * w[j]
            w[j] = np.sign(free) * max(abs(free) - shrink, 0.0) / (gram[j, j] + pull)
            if w[j] != old:
                rest -= gram[:, j] * (w[j] - old)
                moved = max(moved, abs(w[j] - old))
        if moved <= CLOSE:
            break
    return w


def _centred(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Of products of (1, x, y): covariances of x, those with y, means of x and of y."""
    n, mean = m[0, 0], m[0] / m[0, 0]
    c = m / n - np.outer(mean, mean)
    return c[1:-1, 1:-1], c[1:-1, -1], mean[1:-1], mean[-1]


def fit(frame: DataFrame, features: list[str], target: str, key: str, folds: int = 5) -> ElasticNet:
    """Elastic net of target by features, its setting that of the least mean squared error over folds by a hash of key.

    Missing features count as the median of the rows that have a target, a feature without values as zero. Constant features
    have coefficient zero. Rows without a target take no part; of fewer than two rows the model is their mean.
    """
    known = frame.filter(F.col(target).isNotNull()).select(*[F.col(f).cast("double").alias(f) for f in features], F.col(target).cast("double").alias("y"), F.pmod(F.xxhash64(key), F.lit(folds)).alias("fold"))
    one = known.agg(*[F.percentile(f, F.lit(0.5)).alias(f) for f in features]).first()
    medians = np.array([one[f] if one[f] is not None else 0.0 for f in features])
    x = F.array(F.lit(1.0), *[F.coalesce(F.col(f), F.lit(float(m))) for f, m in zip(features, medians, strict=True)])
    size = len(features) + 1
    at, parts = np.triu_indices(size + 1), []
    for row in grams(known.select("fold", x.alias("x"), "y"), ["fold"], size).orderBy("fold").collect():
        m = np.zeros((size + 1, size + 1))
        m[at] = row["g"]
        parts.append(m + np.triu(m, 1).T)
    errors, none = np.zeros((len(RATIOS), len(ALPHAS))), np.zeros(len(features))
    total = sum(parts, np.zeros((size + 1, size + 1)))
    if total[0, 0] < 2:
        return ElasticNet(features, medians, none, none + 1, none, float(total[0, -1] / max(1.0, total[0, 0])), float(ALPHAS[-1]), RATIOS[0], errors)
    cov, _, means, _ = _centred(total)
    scales = np.sqrt(np.maximum(np.diag(cov), 0.0))
    scales[scales <= 1e-12 * np.maximum(1.0, np.abs(means))] = 1.0
    # (1, x, y) -> (1, (x - mean) / scale, y)
    change = np.eye(size + 1)
    change[0, 1:-1], change[range(1, size), range(1, size)] = -means / scales, 1 / scales
    parts, total = [change.T @ m @ change for m in parts], change.T @ total @ change

    def along(m: np.ndarray, ratio: float):
        gram, product, mean, level = _centred(m)
        w = none
        for j in reversed(range(len(ALPHAS))):
            w = descend(gram, product, ALPHAS[j], ratio, w)
            yield j, w, level - mean @ w

    if len(parts) > 1:
        for out in parts:
            for i, ratio in enumerate(RATIOS):
                for j, w, level in along(total - out, ratio):
                    residual = np.concatenate([[-level], -w, [1.0]])
                    errors[i, j] += residual @ out @ residual / out[0, 0] / len(parts)
    i, j = np.unravel_index(np.argmin(errors), errors.shape)
    w, level = next((w, level) for k, w, level in along(total, RATIOS[i]) if k == j)
    return ElasticNet(features, medians, means, scales, w, float(level), float(ALPHAS[j]), RATIOS[i], errors)
