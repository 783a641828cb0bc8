"""Registries scored in one pass: against one model at a time, over slices, and at their edges."""

import json

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from lumenfit.functions import kernels
from lumenfit.operators import metrics, neural, runtable, splits
from lumenfit.sources.runs import best_run

DENSE = {"kind": "dense", "n_in": 2, "hidden": [3], "batch_norm": False, "dropout": 0.0, "activation": "relu"}
NALU = {"kind": "nalu", "n_in": 2, "hidden": [2], "batch_norm": False, "dropout": 0.0, "activation": "relu"}


def path(i, share=0.25, seed=3):
    return f"saves_nnl1_nnn2_nc1_bs32_lr0.001_ne{i}_ts{share}_rs{seed}_PP1_PCA0/"


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    data = [(i, Vectors.dense(*v), float(v.sum() + 0.1 * rng.normal()), 0.1 + 0.01 * (i % 3)) for i, v in enumerate(rng.random((500, 2)))]
    return spark.createDataFrame(data, ["idx", "features", "flux", "fluxerr"]).repartition(3).persist()


def network(spec, seed):
    flat = kernels.initial(spec, seed)
    return neural.NetworkModel()._set(specJson=json.dumps(spec), weights=[float(v) for v in flat])


@pytest.fixture(scope="module")
def registry():
    return {path(i, share, seed): network(DENSE if i % 2 else NALU, i)
            for i, (share, seed) in enumerate([(0.25, 3), (0.25, 4), (0.75, 3), (0.1, 9), (0.25, 3)])}


def one_by_one(rows, registry):
    out = {}
    for name, model in registry.items():
        share, seed = float(name.split("_ts")[1].split("_")[0]), int(name.split("_rs")[1].split("_")[0])
        scored = model.transform(splits.hash_split(rows, "idx", share, seed))
        report = metrics.fit_report(scored).first()
        chi = {r["split"]: r["chisq"] for r in metrics.chisq(scored, by="split").collect()}
        out[name] = (report["n_train"], report["n_test"], report["train_r2_pct"], report["test_r2_pct"], chi["train"], chi["test"])
    return out


@pytest.mark.parametrize("slice_bytes", [1, 1 << 20])
def test_equal_to_one_model_at_a_time(spark, rows, registry, tmp_path, monkeypatch, slice_bytes):
    monkeypatch.setattr(runtable, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(runtable, "BLOCK_ROWS", 64)
    runtable.store_runs(runtable.run_rows(spark, registry), str(tmp_path / "r"))
    got = {r["path"]: tuple(r)[1:] for r in runtable.score_runs(rows, spark.read.parquet(str(tmp_path / "r"))).collect()}
    expect = one_by_one(rows, registry)
    assert got.keys() == expect.keys()
    for name in expect:
        assert got[name][:2] == expect[name][:2]
        np.testing.assert_allclose(got[name][2:], expect[name][2:], rtol=1e-9)


def test_best_of_a_registry(spark, rows, registry):
    scores = runtable.score_runs(rows, runtable.run_rows(spark, registry)).persist()
    top = max(scores.collect(), key=lambda r: r["test_r2_pct"])
    assert best_run(scores, "test_r2_pct").first()["best_path"] == top["path"]


def test_rows_with_gaps_draw_splits_but_are_not_scored(spark, rows, registry):
    name = next(iter(registry))
    gaps = rows.withColumn("flux", F.when(F.col("idx") % 5 > 0, F.col("flux"))).withColumn("fluxerr", F.when(F.col("idx") % 7 > 0, F.col("fluxerr")))
    gaps = gaps.withColumn("features", F.when(F.col("idx") % 11 > 0, F.col("features")))
    got = runtable.score_runs(gaps, runtable.run_rows(spark, {name: registry[name]})).first()
    cut = splits.hash_split(rows, "idx", 0.25, 3).where("idx % 5 > 0 and idx % 7 > 0 and idx % 11 > 0")
    assert (got["n_train"], got["n_test"]) == tuple(cut.where(f"split = '{s}'").count() for s in ("train", "test"))


def test_empty_tables_and_paths_without_a_split(spark, rows, registry):
    one = runtable.run_rows(spark, dict(list(registry.items())[:1]))
    assert tuple(runtable.score_runs(rows.limit(0), one).first())[1:] == (0, 0, None, None, 0.0, 0.0)
    assert runtable.score_runs(rows, one.limit(0)).count() == 0
    assert runtable.score_runs(rows, one.union(one)).count() == 2
    with pytest.raises(ValueError, match="no test size"):
        runtable.score_runs(rows, one.withColumn("path", F.lit("saves_nnl1/")))


@pytest.mark.parametrize("listed", [1, 1000])
def test_many_cuts_are_those_of_single_splits(rows, monkeypatch, listed):
    monkeypatch.setattr(splits, "LISTED_AT_MOST", listed)
    plans = [(0.25, 1), (0.5, 1), (0.25, 2), (0.0, 3), (1.0, 3), (0.003, 4), (0.999, 5)]
    held = rows.select("idx", splits.held_out(plans, splits.split_cuts(rows, plans)).alias("h")).collect()
    for i, (share, seed) in enumerate(plans):
        single = splits.hash_split(rows, "idx", share, seed).where("split = 'test'").select("idx").collect()
        assert {r["idx"] for r in held if r["h"][i]} == {r["idx"] for r in single}
