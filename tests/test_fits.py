"""Boosted trees against plain numpy on raw values, and the elastic net against its conditions and a plain search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from crosspanel.operators import elastic, trees

FEATURES = ["a", "b", "c"]


def data(n=300, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(1)
    x[:, 2] = rng.integers(0, 4, n)
    y = np.where(np.isnan(x[:, 0]), 0, x[:, 0]) - 0.5 * x[:, 1] ** 2 + (x[:, 2] == 2) + rng.normal(size=n) * 0.2
    x[rng.random(n) < 0.15, 0] = np.nan
    y[np.isnan(x[:, 0])] += 1.5  # missing values mean something
    return x, y


def frame(spark, x, y):
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], None if t is None else float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double")


def plain_trees(x, y, uid, s, sign):
    """Splits of raw values by trying every value and both sides for missing ones."""
    pred, out = np.full(len(y), y.mean()), []

    def weight(g, h, low, high):
        return min(max(-np.sign(g) * max(abs(g) - s.l1, 0) / (h + s.l2), low), high)

    def saved(g, h, w):
        return -(2 * g * w + (h + s.l2) * w * w + 2 * s.l1 * abs(w))

    def grow(rows, g, use, depth, low, high):
        total, n = g[rows].sum(), len(rows)
        own = weight(total, n, low, high)
        best = (1e-9, None)
        for f in use if depth < s.depth else []:
            v = x[rows, f]
            for cut in [*np.unique(v[~np.isnan(v)])]:
                for missing_left in (False, True):
                    left = np.where(np.isnan(v), missing_left, v <= cut)
                    a, b = rows[left], rows[~left]
                    if min(len(a), len(b)) < s.least:
                        continue
                    wa, wb = weight(g[a].sum(), len(a), low, high), weight(g[b].sum(), len(b), low, high)
                    if sign[f] * (wb - wa) < 0:
                        continue
                    gain = saved(g[a].sum(), len(a), wa) + saved(g[b].sum(), len(b), wb) - saved(total, n, own)
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, cut, missing_left, a, b, wa, wb))
        if best[1] is None:
            return lambda q: np.full(len(q), s.rate * own)
        f, cut, side, a, b, wa, wb = best[1]
        mid = (wa + wb) / 2
        bounds = {1: ((low, min(high, mid)), (max(low, mid), high)), -1: ((max(low, mid), high), (low, min(high, mid))), 0: ((low, high),) * 2}[sign[f]]
        l, r = grow(a, g, use, depth + 1, *bounds[0]), grow(b, g, use, depth + 1, *bounds[1])  # noqa: E741
        return lambda q: np.where(np.where(np.isnan(q[:, f]), side, q[:, f] <= cut), l(q), r(q))

    for k in range(s.rounds):
        rows = np.flatnonzero(trees.sampled(uid, s.seed, k, s.rows))
        tree = grow(rows, pred - y, trees.allowed(x.shape[1], s, k), 0, -np.inf, np.inf)
        pred = pred + tree(x)
        out.append(tree)
    return pred


@pytest.mark.parametrize(("sign", "small"), [([0, 0, 0], 0), ([1, 0, -1], 0), ([1, 0, -1], 1 << 22)])
def test_trees_are_those_of_a_plain_search(spark, sign, small, monkeypatch):
    """Spread over tasks with a job a level, and in one task."""
    monkeypatch.setattr(trees, "SMALL", small)
    x, y = data()
    df = frame(spark, x, y).repartition(5)
    s = trees.Settings(rounds=25, depth=2, rate=0.2)  # past a refresh
    model = trees.fit(df, FEATURES, "y", "id", dict(zip(FEATURES, sign, strict=True)), s)
    got = df.select("id", F.xxhash64("id").alias("uid"), trees.predicted(model).alias("p")).orderBy("id").toPandas()
    want = plain_trees(x, y, got["uid"].to_numpy(), s, sign)
    assert np.allclose(got["p"], want, atol=1e-9)
    assert model.table(spark).select("tree").distinct().count() == 25


def test_missing_values_follow_the_better_side_and_signs_hold(spark):
    x, y = data(600, 2)
    df = frame(spark, x, y)
    model = trees.fit(df, FEATURES, "y", "id", {"a": 1}, trees.Settings(rounds=60))
    grid = np.linspace(-4, 4, 81)
    for b, c in ((-1.0, 0.0), (0.3, 2.0)):
        line = model.predict(model.codes(np.column_stack([grid, np.full(81, b), np.full(81, c)])))
        assert (np.diff(line) >= -1e-12).all() and line[-1] > line[0]
    gone = model.predict(model.codes(np.array([[np.nan, 0.0, 0.0]])))
    assert gone[0] > model.predict(model.codes(np.array([[0.0, 0.0, 0.0]])))[0] + 0.5


def test_trees_of_odd_frames(spark):
    x, y = data(40)
    df = frame(spark, x, y)
    assert trees.fit(df.limit(0), FEATURES, "y", "id").predict(np.zeros((1, 3), dtype=np.uint8))[0] == 0.0
    none = df.withColumns({"a": F.lit(None).cast("double"), "b": F.lit(float("nan"))})
    model = trees.fit(none, FEATURES, "y", "id", settings=trees.Settings(rounds=3))
    assert all(t.feature[0] in (-1, 2) for t in model.trees)
    assert none.withColumn("y", F.lit(None).cast("double")).select(trees.predicted(model).alias("p")).filter("p is null").count() == 0


def test_elastic_net_meets_its_conditions(spark):
    x, y = data(400, 3)
    df = frame(spark, x, y).repartition(3)
    model = elastic.fit(df, FEATURES, "y", "id")
    filled = np.where(np.isnan(x), np.nanmedian(x, axis=0), x)
    z = (filled - filled.mean(axis=0)) / filled.std(axis=0)
    assert np.allclose(model.means, filled.mean(axis=0)) and np.allclose(model.scales, filled.std(axis=0))
    pull = z.T @ (y - model.intercept - z @ model.coefficients) / len(y) - model.alpha * (1 - model.ratio) * model.coefficients
    on = model.coefficients != 0
    assert np.allclose(pull[on], model.alpha * model.ratio * np.sign(model.coefficients[on]), atol=1e-7)
    assert (np.abs(pull[~on]) <= model.alpha * model.ratio + 1e-9).all()
    got = [r[0] for r in df.orderBy("id").select(model.score()).collect()]
    assert np.allclose(got, model.intercept + z @ model.coefficients)
    # The errors of the folds, from the rows themselves.
    fold = np.array([r[0] for r in df.orderBy("id").select(F.pmod(F.xxhash64("id"), F.lit(5))).collect()])
    for i, j in ((0, 0), (1, 10), (2, 15)):
        error = 0.0
        for k in range(5):
            a, b = z[fold != k], z[fold == k]
            c, t = a - a.mean(axis=0), y[fold != k] - y[fold != k].mean()
            w = elastic.descend(c.T @ c / len(c), c.T @ t / len(c), elastic.ALPHAS[j], elastic.RATIOS[i], np.zeros(3))
            error += ((y[fold == k] - y[fold != k].mean() - (b - a.mean(axis=0)) @ w) ** 2).mean() / 5
        assert np.isclose(model.errors[i, j], error)
    assert model.path(spark).filter("chosen").count() == 1 and model.parameters(spark).count() == 4


def test_elastic_net_of_odd_frames(spark):
    x, y = data(30)
    df = frame(spark, x, y)
    flat = df.withColumns({"a": F.lit(None).cast("double"), "b": F.lit(2.0)})
    model = elastic.fit(flat, FEATURES, "y", "id")
    assert model.coefficients[0] == model.coefficients[1] == 0
    assert elastic.fit(df.limit(0), FEATURES, "y", "id").intercept == 0.0
    assert elastic.fit(df.filter("id = 3"), FEATURES, "y", "id").intercept == pytest.approx(y[3])
