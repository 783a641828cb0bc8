"""Regressors: invariants, gradients, partition independence, storage round trips."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from lumenfit.functions import kernels
from lumenfit.operators import boost, forest, metrics, neural, search
from lumenfit.operators.ensemble import EnsembleModel, LeafTableModel, predict_as
from lumenfit.operators.linear import PixelLinearModel
from lumenfit.sources import models


@pytest.fixture(scope="module")
def toy(spark):
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    y = 2 * x[:, 0] - x[:, 1] ** 2 + 0.02 * rng.normal(size=600)
    rows = [(i, Vectors.dense(r), float(v), 0.1) for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, ["idx", "features", "flux", "fluxerr"]).repartition(4).persist()
    df.count()
    return df


def r2(model, df):
    return metrics.r2(model.transform(df)).first()["r2"]


def predictions(model, df):
    rows = model.transform(df).select("idx", "prediction").orderBy("idx").collect()
    return np.array([r["prediction"] for r in rows])


def round_trip(model, df, path, spark):
    models.save(model, str(path))
    np.testing.assert_array_equal(predictions(models.load(str(path), spark), df), predictions(model, df))


def test_pixel_model_residuals_are_orthogonal(spark, cal_df, tmp_path):
    from lumenfit.operators.features import pld_normalize

    df = pld_normalize(cal_df)
    model = PixelLinearModel(curvature=True).fit(df)
    res = model.transform(df).withColumn("e", F.col("flux") - F.col("prediction"))
    pdf = res.toPandas()
    t = pdf["bmjd"] - pdf["bmjd"].mean()
    for term in (np.ones(len(pdf)), t, t**2, *[pdf[f"pix{k}"] for k in range(1, 10)]):
        assert abs((pdf["e"] * term).sum()) < 1e-8 * max(1.0, np.abs(term).max()) * len(pdf)
    round_trip(model, df, tmp_path / "pix", spark)


def test_importances_sum_to_one_and_select(spark, toy):
    model = forest.forest(numTrees=5, maxDepth=5).fit(toy)
    imp = forest.importances(model, ["a", "b", "c"], spark)
    assert imp.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)
    ranked = forest.rank_importances(imp).orderBy("rank").collect()
    assert [r["feature"] for r in ranked][:2] == ["a", "b"]


@pytest.mark.parametrize("values,k", [((0.5, 0.25, 0.15, 0.07, 0.03), 4), ((0.3, 0.2, 0.1, 0.1, 0.1), 5)])
def test_select_k(spark, values, k):
    imp = spark.createDataFrame(list(zip("abcde", values)), "feature string, importance double")
    rows = forest.select_k(imp, 0.95).collect()
    assert {r["k"] for r in rows} == {k} and sum(r["selected"] for r in rows) == k


def test_oob_forest(spark, toy, tmp_path):
    model = forest.OOBForest(numTrees=8, maxDepth=6).fit(toy)
    assert 0.7 < model.oob_score_ < r2(model, toy)
    # The same score by hand: each row's mean over the trees whose bag it is not in.
    from lumenfit.operators.splits import bootstrap_weights

    df = bootstrap_weights(toy, n_trees=8, seed=42)
    for t, tree in enumerate(model.members[0].trees):
        df = predict_as(tree, df, f"p{t}")
    pdf = df.orderBy("idx").toPandas()
    w = np.stack(pdf["w"].to_numpy())
    p = pdf[[f"p{t}" for t in range(8)]].to_numpy()
    out = w == 0
    seen = out.any(axis=1)
    oob = (p * out).sum(axis=1)[seen] / out.sum(axis=1)[seen]
    y = pdf["flux"].to_numpy()[seen]
    assert model.oob_score_ == pytest.approx(1 - ((y - oob) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    np.testing.assert_allclose(predictions(model, toy), p.mean(axis=1))
    round_trip(model, toy, tmp_path / "oob", spark)


def test_extra_trees(spark, toy, tmp_path):
    model = forest.ExtraTrees(numTrees=6, maxDepth=6).fit(toy)
    assert r2(model, toy) > 0.85
    round_trip(model, toy, tmp_path / "extra", spark)


def test_adaboost_r2_follows_the_algorithm(spark, toy, tmp_path):
    model = forest.AdaBoostR2(numTrees=5, checkpointInterval=2).fit(toy)
    assert r2(model, toy) > 0.6
    rows = toy.orderBy("idx").collect()
    y, w = np.array([r["flux"] for r in rows]), np.ones(len(rows))
    trees, df, ps = model.trees.trees, toy, []
    for t, tree in enumerate(trees):
        df = predict_as(tree.setLeafCol(""), df, f"p{t}")
    pdf = df.orderBy("idx").toPandas()
    weights = []
    for t in range(len(trees)):
        p = pdf[f"p{t}"].to_numpy()
        ps.append(p)
        e = np.abs(p - y) / np.abs(p - y).max()
        loss = (w * e).sum() / w.sum()
        beta = loss / (1 - loss)
        weights.append(-np.log(beta))
        w = w * beta ** (1 - e)
    np.testing.assert_allclose(model.getOrDefault(model.weights), weights, rtol=1e-6)
    order = np.argsort(np.array(ps), axis=0)
    cum = np.cumsum(np.array(weights)[order], axis=0)
    pick = (cum >= sum(weights) / 2).argmax(axis=0)
    expect = np.take_along_axis(np.array(ps), np.take_along_axis(order, pick[None], 0), 0)[0]
    np.testing.assert_allclose(predictions(model, toy), expect)
    round_trip(model, toy, tmp_path / "ada", spark)


def test_quantile_boosting_covers(spark, toy, tmp_path):
    est = boost.QuantileBoost(alpha=0.9, numTrees=12, stepSize=0.3, subsample=0.8)
    model = est.fit(toy)
    cover = model.transform(toy).agg(F.avg((F.col("flux") <= F.col("prediction")).cast("double"))).first()[0]
    assert 0.85 < cover < 0.97
    more = est.resume(model, toy, 3)
    assert more.trees.getNumTrees == 15 and more.tables()[:12] == model.tables()
    round_trip(more, toy, tmp_path / "quantile", spark)


def test_empty_table_model_predicts_its_base(toy):
    assert set(predictions(LeafTableModel(base=1.5), toy)) == {1.5}


def test_resumed_models(spark, toy, tmp_path):
    est = forest.forest(numTrees=3, maxDepth=4)
    both = forest.resume_forest(est.fit(toy), est, toy, 2)
    assert len(both.members[0].trees) == 5 and r2(both, toy) > 0.7
    first = boost.fit_boosted(toy, rounds=4, stepSize=0.3)
    more = boost.resume_boosted(first, toy, 4, stepSize=0.3)
    assert r2(more, toy) > r2(first, toy)
    assert more.getNumTrees == 8
    round_trip(more, toy, tmp_path / "gbt", spark)


def test_per_draw_average(spark, cal_df):
    from lumenfit.operators.features import resample

    cols = ["xpos", "ypos", "pix5"]
    drawn = resample(cal_df, {"xpos": "xerr"}, n=2)
    model = forest.per_draw(drawn, forest.approach("STD", cols, numTrees=2, maxDepth=3))
    assert isinstance(model, EnsembleModel) and len(model.members) == 2
    out = predict_as(model.members[1], predict_as(model.members[0], model.transform(cal_df), "a"), "b")
    assert out.agg(F.max(F.abs(F.col("prediction") - (F.col("a") + F.col("b")) / 2))).first()[0] < 1e-12


SPECS = [
    {"kind": "nalu", "n_in": 3, "hidden": [4], "loss": "l2"},
    {"kind": "nalu", "n_in": 3, "hidden": [4, 3], "loss": "chisq"},
    *[
        {"kind": "dense", "n_in": 3, "hidden": [4, 3], "activation": act, "dropout": 0.0, "batch_norm": bn,
         "l1": 0.0, "l2": 0.0, "loss": loss}
        for act, bn, loss in (("elu", False, "mse"), ("selu", True, "chisq"), ("tanh", True, "mse"),
                              ("sigmoid", False, "chisq"), ("leaky_relu", False, "mse"), ("relu", False, "l2"))
    ],
]


@pytest.mark.parametrize("spec", SPECS, ids=lambda s: f"{s['kind']}-{s.get('activation', '')}-{s['loss']}")
def test_gradient_matches_differences(spec):
    rng = np.random.default_rng(1)
    x, y, err = rng.normal(size=(8, 3)), rng.normal(size=8), 0.5 + rng.random(8)
    flat = kernels.initial(spec, 3) + 0.3 * rng.normal(size=len(kernels.initial(spec, 3)))
    train = bool(spec.get("batch_norm"))

    def loss(w):
        p, _ = kernels.forward(spec, w, x, train, rng)
        e = p - y
        if spec["loss"] == "chisq":
            return ((e / err) ** 2).sum()
        return 0.5 * (e**2).sum() if spec["loss"] == "l2" else (e**2).mean()

    p, cache = kernels.forward(spec, flat, x, train, rng)
    grad = kernels.backward(spec, flat, cache, kernels.loss_gradient(spec, p, y, err))
    moving = np.concatenate([
        np.full(int(np.prod(s)), n.startswith(("mean", "var"))) for n, s in kernels.shapes(spec)
    ])
    for i in np.flatnonzero(~moving)[::2]:
        step = np.zeros_like(flat)
        step[i] = 1e-6
        num = (loss(flat + step) - loss(flat - step)) / 2e-6
        assert grad[i] == pytest.approx(num, rel=1e-4, abs=1e-6)


def test_penalties_enter_the_gradient():
    spec = {**SPECS[2], "l1": 0.1, "l2": 0.2}
    flat = kernels.initial(spec, 1)
    x = np.random.default_rng(0).normal(size=(5, 3))
    _, cache = kernels.forward(spec, flat, x)
    with_p = kernels.backward(spec, flat, cache, np.zeros(5))
    np.testing.assert_allclose(with_p, neural._penalty(spec, flat))


def test_sync_training_does_not_depend_on_shards(toy):
    runs = []
    for shards in (1, 4, 13):
        est = neural.NALURegressor(epochs=3, lr=0.05, neurons=4, shards=shards, mode="sync")
        runs.append(predictions(est.fit(toy), toy))
    np.testing.assert_allclose(runs[0], runs[1], rtol=1e-9)
    np.testing.assert_allclose(runs[0], runs[2], rtol=1e-9)


@pytest.mark.parametrize("dropout", [0.0, 0.3])
def test_minibatch_training_does_not_depend_on_shards(spark, toy, dropout, monkeypatch):
    from lumenfit.operators.splits import hash_split

    df = hash_split(toy, test_size=0.25)
    runs = []
    monkeypatch.setattr(neural, "ROWS_PER_LANE", 60)  # several lanes of the small table
    for shards in (1, 4, 16):
        est = neural.DenseRegressor(hidden=[6], dropout=dropout, epochs=3, lr=0.02, splitCol="split", shards=shards)
        runs.append([tuple(r) for r in est.fit(df.repartition(shards + 2)).history(spark).orderBy("epoch").collect()])
    for other in runs[1:]:
        np.testing.assert_allclose(np.array(runs[0], float), np.array(other, float), rtol=1e-6)


def test_history_accuracy_is_of_the_training_rows():
    sums = np.zeros((2, len(neural._SUMS)))
    sums[0, [0, 4, 6]], sums[1, [0, 4, 6]] = (10, 4, 1.0), (5, 5, 1.0)
    assert neural._metrics(sums)["accuracy"] == 0.4


def test_forest_does_not_depend_on_partitions(toy):
    from lumenfit.operators import forest

    fits = [forest.forest(numTrees=3, maxDepth=4).fit(toy.repartition(n)).toDebugString.split("\n", 1)[1] for n in (2, 8)]
    assert fits[0] == fits[1]
    bare = toy.select("features", "flux")
    fits = [forest.forest(numTrees=2, maxDepth=3).fit(bare.repartition(n)).toDebugString.split("\n", 1)[1] for n in (3, 5)]
    assert fits[0] == fits[1]


def test_training_is_repeatable_and_learns(spark, toy, tmp_path):
    from lumenfit.operators.splits import hash_split

    df = hash_split(toy, test_size=0.25)
    est = neural.DenseRegressor(
        hidden=[8], activation="tanh", dropout=0.0, epochs=15, lr=0.02, splitCol="split", errCol="fluxerr",
        shards=3, keepBest=True,
    )
    a, b = est.fit(df), est.fit(df.repartition(7))
    np.testing.assert_allclose(predictions(a, df), predictions(b, df), rtol=1e-9)
    h = a.history(spark).orderBy("epoch").collect()
    assert len(h) == 15 and h[-1]["r2_test"] > 0.9 and h[-1]["loss"] < h[0]["loss"]
    best = max(r["r2_test"] for r in h)
    test = metrics.r2(a.transform(df).where("split = 'test'")).first()["r2"]
    assert test == pytest.approx(best, abs=1e-9)
    round_trip(a, df, tmp_path / "net", spark)


def test_regularised_network(toy):
    est = neural.DenseRegressor(
        batchNorm=True, l1=1e-3, l2=1e-4, loss="chisq", errCol="fluxerr", epochs=3, batch=50, dropout=0.5
    )
    model = est.fit(toy)
    moved = model.blocks()
    assert np.isfinite(predictions(model, toy)).all() and not np.allclose(moved["var0"], 1.0)
    with pytest.raises(ValueError):
        neural.DenseRegressor(batchNorm=True, mode="sync", epochs=1).fit(toy)


def test_resumed_network_continues(spark, toy):
    est = neural.NALURegressor(epochs=2, lr=0.02, neurons=4)
    first = est.fit(toy)
    more = est.resume(first, toy)
    before, after = first.history(spark).collect(), more.history(spark).collect()
    assert after[-1]["loss"] < before[-1]["loss"]


def test_random_search(spark, toy):
    space = search.grid(maxDepth=[1, 3], maxIter=[2, 4])
    out = search.random_search(toy, boost.boosted(stepSize=0.5), space, n=3, k=2, seed=1).persist()
    assert out.count() == 6
    assert out.where("train_r2 > 1 or neg_rmse > 0").count() == 0
    best = search.search_summary(out, ["maxDepth", "maxIter"]).first()
    assert best["mean_r2"] == out.groupBy("setting").agg(F.avg("r2").alias("m")).agg(F.max("m")).first()[0]
    assert len(search.grid(**search.BOOST_GRID)) == 13 * 12 * 12


def test_the_frame_of_a_query_is_stored(spark, sf_dir):
    """Fits and scores read the prepared rows; none joins and normalises the tables again."""
    from lumenfit.plans import models as plans

    plan = plans._scaled_frame(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "parquet" not in plan.lower()


@pytest.mark.parametrize("resume", [False, True])
def test_lanes_are_dealt_to_few_tasks(toy, monkeypatch, resume):
    """The tasks of an epoch follow the cores, not the rows; what is learned is that of a task per lane."""
    monkeypatch.setattr(neural, "ROWS_PER_LANE", 4)
    lanes = -(-toy.count() // 4)
    ests = [neural.DenseRegressor(hidden=[3], dropout=0.0, epochs=2, shards=s) for s in (0, lanes)]
    tasks = [e._prepared(toy).rdd.getNumPartitions() for e in ests]
    assert tasks[0] <= max(64, 2 * toy.sparkSession.sparkContext.defaultParallelism) < tasks[1] == lanes
    models = [e.resume(e.fit(toy), toy) if resume else e.fit(toy) for e in ests]
    np.testing.assert_allclose(models[0].flat(), models[1].flat(), rtol=1e-9)


def lane_batch(sizes, width=3):
    """Rows of lanes of the given sizes, as a task of the preparation gets them."""
    import pyarrow as pa

    rng, n = np.random.default_rng(5), sum(sizes)
    x = rng.random((n, width))
    return pa.RecordBatch.from_pydict({
        "lane": np.repeat(np.arange(len(sizes)), sizes), "h": rng.integers(0, 2**60, n), "x": x.tolist(),
        "y": x.sum(axis=1) + 0.1 * rng.random(n), "e": 0.5 + rng.random(n), "t": np.arange(n) % 4 == 3,
    })


@pytest.mark.parametrize("spec", [*SPECS[1:4], {**SPECS[3], "dropout": 0.3}], ids=str)
def test_lanes_step_side_by_side(spec, monkeypatch):
    """A task takes one step for all its lanes, not one after another; each lane learns what it learns alone."""
    sizes, steps = [40, 37, 3, 64, 1], []
    adam = kernels.adam
    monkeypatch.setattr(kernels, "adam", lambda *a: steps.append(1) or adam(*a))
    flat = kernels.initial(spec, 3)
    zero = np.zeros_like(flat)

    def run(batches):
        steps.clear()
        task = neural._epoch_task(spec, flat, zero, zero, 0.5, 0.01, 4, 7, 1, "average", 0.0, True)
        return next(task(neural._pack(batches))).column(1).to_numpy(), len(steps)

    rows = lane_batch(sizes)
    together, n = run([rows])
    longest = max(np.bincount(rows.column("lane").to_numpy()[~rows.column("t").to_numpy(zero_copy_only=False)])) // 4
    assert n <= longest + len(sizes)  # whole steps of the longest lane, and one rest a lane
    alone = sum(run([rows.slice(sum(sizes[:i]), k)])[0] for i, k in enumerate(sizes))
    np.testing.assert_allclose(together, alone, rtol=1e-12)
    in_parts, _ = run([rows.slice(0, 60), rows.slice(60, 0), rows.slice(60)])  # a lane in two Arrow batches
    np.testing.assert_array_equal(together, in_parts)
    monkeypatch.setattr(neural, "STEP_BYTES", 1)
    np.testing.assert_array_equal(together, run([rows])[0])


def test_lanes_are_packed_once_for_many_fits(toy, monkeypatch):
    """Passes read records of many rows; fits from the stored lanes are those from the rows, resumed ones too."""
    monkeypatch.setattr(neural, "ROWS_PER_LANE", 60)
    est = neural.DenseRegressor(hidden=[6], dropout=0.2, epochs=2, lr=0.02)
    whole = neural.DenseRegressor(hidden=[6], dropout=0.2, epochs=4, lr=0.02)
    lanes = est.lanes(toy)
    n, count = lanes.agg(F.sum("n"), F.count("lane")).first()
    assert n == toy.count() and count <= 2 * -(-n // 60)
    from_rows, from_lanes = est.fit(toy), est.fit(lanes)
    np.testing.assert_allclose(from_rows.flat(), from_lanes.flat(), rtol=1e-12)
    np.testing.assert_allclose(est.resume(from_lanes, lanes).flat(), whole.fit(lanes).flat(), rtol=1e-12)
    assert lanes.storageLevel.useMemory  # the caller's table stays stored
    lanes.unpersist()


def test_rows_without_a_split_are_refused():
    batch = lane_batch([4])
    at = batch.schema.get_field_index("t")
    import pyarrow as pa

    with pytest.raises(ValueError, match="split"):
        list(neural._pack([batch.set_column(at, "t", pa.array([True, None, False, True]))]))


def test_labels_that_are_null_stay_out_of_the_mean():
    import pyarrow as pa

    batch = lane_batch([4])
    at = batch.schema.get_field_index("y")
    record = next(neural._pack([batch.set_column(at, "y", pa.array([1.0, None, 2.0, 4.0]))]))
    assert [record.column(c)[0].as_py() for c in ("n", "y_n", "y_sum", "width")] == [4, 3, 7.0, 3]
