"""Trees grown level by level, node by node against a recursive version in numpy."""

import hashlib

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressionModel

from lumenfit.operators import forest, levelwise
from lumenfit.operators.splits import bootstrap_weights


def draw(*parts):
    digest = hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13]
    return (int(digest, 16) + 0.5) * 2.0**-52


@pytest.fixture(scope="module")
def table(spark):
    """Three informative features, one that is constant, one with two values; ties and a repeated row."""
    r = np.random.default_rng(5)
    x = np.c_[r.random((400, 2)), r.integers(0, 6, 400), np.ones(400), r.integers(0, 2, 400)].astype(float)
    y = np.sin(3 * x[:, 0]) + x[:, 1] * x[:, 4] + 0.1 * x[:, 2] + 0.05 * r.normal(size=400)
    x[7], y[7] = x[3], y[3]
    rows = [(i, Vectors.dense(v), float(t)) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, ["idx", "features", "flux"]).repartition(5).persist(), x, y


def plain(x, y, w, tree, depth, least, cuts=None, heap=1, level=0):
    """``{heap: (feature, threshold, prediction, rows)}``, feature -1 for a leaf."""
    n, s, q = w.sum(), (w * y).sum(), (w * y * y).sum()
    out = {heap: (-1, 0.0, s / n, n)}
    if level == depth or n < 2 * least:
        return out
    best = (0.0, None, None)
    for f in range(x.shape[1]):
        low, high = x[w > 0, f].min(), x[w > 0, f].max()
        for cut in [low + (high - low) * draw(42, tree, heap, f)] if cuts is None else cuts[f]:
            left = x[:, f] <= cut
            nl, sl = w[left].sum(), (w * y)[left].sum()
            if nl < least or n - nl < least or q <= 0:
                continue
            gain = round((sl * sl / nl + (s - sl) ** 2 / (n - nl) - s * s / n) / q, 12)
            if gain > best[0]:
                best = (gain, f, cut)
    _, f, cut = best
    if f is None:
        return out
    out[heap] = (f, cut, s / n, n)
    left = x[:, f] <= cut
    for child, side in ((2 * heap, left), (2 * heap + 1, ~left)):
        out |= plain(x, y, w * side, tree, depth, least, cuts, child, level + 1)
    return out


def same(trees, mean, want, tree):
    own = np.flatnonzero(trees.tree == tree)
    assert {int(h) for h in trees.heap[own]} == set(want)
    for k in own:
        f, cut, p, n = want[int(trees.heap[k])]
        assert (trees.feature[k], trees.stats[k, 0]) == (f, n)
        assert trees.threshold[k] == pytest.approx(cut, abs=1e-12)
        assert mean + trees.stats[k, 1] / trees.stats[k, 0] == pytest.approx(p, abs=1e-9)


@pytest.mark.parametrize("least, small", [(1, False), (4, True)])
def test_drawn_thresholds(table, monkeypatch, least, small):
    df, x, y = table
    if small:  # many slices of a level, many blocks of a batch
        monkeypatch.setattr(levelwise, "SLICE_BYTES", 700)
        monkeypatch.setattr(levelwise, "WALK_CELLS", 64)
    data, d, mean = levelwise.prepared(df, "features", "flux")
    trees = levelwise.grow(data, d, 3, 5, least)
    for t in range(3):
        want = plain(x, y - mean, np.ones(len(y)), t, 5, least)
        same(trees, 0.0, want, t)
    assert max(trees.heap) >= 32
    leaf = np.flatnonzero(trees.feature < 0)[-1]  # a leaf's squares
    at = levelwise.walk(trees.walker(), x, 3)[:, trees.tree[leaf]] == leaf
    assert trees.stats[leaf, 2] == pytest.approx((((y - mean)[at]) ** 2).sum())
    data.unpersist()


def test_bags_and_quantiles(table):
    df, x, y = table
    bags = bootstrap_weights(df, n_trees=4)
    data, d, mean = levelwise.prepared(bags, "features", "flux", "w")
    cuts = levelwise.quantile_cuts(data, d, 15)
    assert np.isinf(cuts[0, 3]).all() and (cuts[0, 4] == 0).sum() == 1
    trees = levelwise.grow(data, d, 4, 4, 2, cuts=cuts)
    w = np.array([r.w for r in bags.orderBy("idx").collect()], dtype=float)
    for t in range(4):
        same(trees, 0.0, plain(x, y - mean, w[:, t], t, 4, 2, cuts[0]), t)
    data.unpersist()


def test_forest_model(spark, table, tmp_path):
    """One native model of many trees: its predictions, importances and its copy in storage."""
    df, x, y = table
    model = forest.ExtraTrees(numTrees=60, maxDepth=7).fit(df)
    assert isinstance(model, RandomForestRegressionModel) and model.getNumTrees == 60
    want = np.zeros(len(y))
    for t in range(60):
        tree = plain(x, y - y.mean(), np.ones(len(y)), t, 7, 1)
        at = np.ones(len(y), int)
        while (inner := np.array([tree[h][0] >= 0 for h in at])).any():
            f, cut = np.array([tree[h][0] for h in at]), np.array([tree[h][1] for h in at])
            at = np.where(inner, 2 * at + (x[np.arange(len(y)), f] > cut), at)
        want += np.array([tree[h][2] for h in at]) / 60
    got = np.array([r.prediction for r in model.transform(df).orderBy("idx").collect()])
    np.testing.assert_allclose(got, want + y.mean(), atol=1e-9)
    shares = model.featureImportances.toArray()
    assert shares.sum() == pytest.approx(1) and shares[3] == 0
    model.write().overwrite().save(str(tmp_path / "m"))
    again = RandomForestRegressionModel.load(str(tmp_path / "m"))
    assert [r.prediction for r in again.transform(df).orderBy("idx").collect()] == pytest.approx(list(got))


def test_partitions_do_not_matter(table):
    df, _, _ = table
    first, second = (forest.ExtraTrees(numTrees=5, maxDepth=6).fit(d) for d in (df, df.coalesce(1)))
    assert first.toDebugString.split("\n")[1:] == second.toDebugString.split("\n")[1:] or np.allclose(
        [r.prediction for r in first.transform(df).orderBy("idx").collect()],
        [r.prediction for r in second.transform(df).orderBy("idx").collect()])


def test_odd_tables(spark):
    """A constant label, a single row, no rows."""
    rows = [(i, Vectors.dense([float(i)]), 2.0) for i in range(9)]
    flat = spark.createDataFrame(rows, ["idx", "features", "flux"])
    assert {r.prediction for r in forest.ExtraTrees(numTrees=2).fit(flat).transform(flat).collect()} == {2.0}
    one = forest.ExtraTrees(numTrees=2).fit(flat.limit(1))
    assert one.totalNumNodes == 2
    with pytest.raises(ValueError, match="no rows"):
        forest.ExtraTrees().fit(flat.limit(0))


def test_too_large_a_model(table, monkeypatch):
    monkeypatch.setattr(levelwise, "MAX_NODES", 20)
    with pytest.raises(ValueError, match="nodes"):
        forest.ExtraTrees(numTrees=8).fit(table[0])


@pytest.mark.parametrize("bags", [True, False])
def test_empty_partitions(spark, bags):
    """A task without rows adds nothing: trees are those of the same rows without empty partitions."""
    rows = spark.createDataFrame([(i, [float(i % 2), float(i)], float(i % 2)) for i in range(40)], "idx bigint, features array<double>, flux double")
    kind = forest.OOBForest(numTrees=3, maxDepth=2) if bags else forest.ExtraTrees(numTrees=3, maxDepth=2)
    x = rows.withColumn("features", array_to_vector("features"))
    holes = x.repartition(8, "flux")
    assert 0 in [len(p) for p in holes.rdd.glom().collect()]
    got, want = (m.transform(x).orderBy("idx").collect() for m in (kind.fit(holes), kind.fit(x.coalesce(1))))
    assert np.allclose([r.prediction for r in got], [r.prediction for r in want], atol=1e-9)


@pytest.mark.parametrize("weights", [None, "w"])
def test_sums_do_not_follow_the_partitions(spark, table, weights):
    """Tasks emit a row for every node and feature: many partitions are read by few tasks, and trees stay the same."""
    df, x, y = table
    rows = bootstrap_weights(df, n_trees=3)
    many, d, mean = levelwise.prepared(rows.repartition(90), "features", "flux", weights)
    few, _, _ = levelwise.prepared(rows.coalesce(1), "features", "flux", weights)
    assert many.rdd.getNumPartitions() <= levelwise.TASKS_PER_CORE * spark.sparkContext.defaultParallelism < 90
    cuts = levelwise.quantile_cuts(few, d, 15) if weights else None
    one, two = (levelwise.grow(data, d, 3, 4, cuts=cuts) for data in (many, few))
    assert (one.feature == two.feature).all() and np.allclose(one.stats, two.stats) and one.feature.max() >= 0
    for data in (many, few):
        data.unpersist()


def test_bags_are_drawn_in_batches(spark, monkeypatch):
    """Counts follow their digests for any key, and no expression of the plan draws them one by one."""
    monkeypatch.setattr("lumenfit.operators.splits.KEYS_AT_ONCE", 7)
    rows = [(str(k) if k is not None else None, k) for k in [*range(40), -3, 1 << 60, None, None]]
    table = spark.createDataFrame(rows, "name string, idx bigint").repartition(6, "idx")
    for trees, key in ((10, "idx"), (3, "name")):
        bags = bootstrap_weights(table, key, trees, 9)
        assert "transform(" not in bags._jdf.queryExecution().executedPlan().toString()
        for name, idx, w in bags.collect():
            want = []
            for t in range(trees):
                text = f"9:{t // 4}" if idx is None else f"9:{idx}:{t // 4}"
                word = int(hashlib.md5(text.encode()).hexdigest()[15 * (t % 4 // 2):][:15], 16)
                u, p, k = ((word >> 30 if t % 2 == 0 else word & (1 << 30) - 1) + 0.5) / (1 << 30), np.exp(-1), 0
                while u >= p:
                    k += 1
                    p += np.exp(-1) / np.prod(np.arange(1.0, k + 1))
                want.append(k)
            assert w == want
    assert bootstrap_weights(table.where("idx > 1e19")).count() == 0
