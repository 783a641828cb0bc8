"""Readers, writers, run names, persistence and streaming on files of a known layout."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from lumenfit import schema
from lumenfit.operators import metrics
from lumenfit.operators.features import CalibrationPrep
from lumenfit.operators.linear import PixelLinearModel
from lumenfit.session import ensure_checkpoint_dir
from lumenfit.sources import models, runs, tables
from lumenfit.streaming import scoring

TARGET = [f.name for f in schema.TARGET_SCHEMA.fields]


@pytest.fixture(scope="module")
def files(cal_df, tmp_path_factory):
    folder = tmp_path_factory.mktemp("targets")
    pdf = cal_df.orderBy("idx").toPandas()
    for key, part in (("a1", pdf[:300]), ("b2", pdf[300:700])):
        part[TARGET].to_csv(folder / f"star_{key}.csv", index=False)
    pdf[:5][TARGET].to_csv(folder / "star_NALU_c3.csv", index=False)
    pdf[schema.RAW_COLUMNS].to_csv(folder / "raw.csv", index=False)
    return folder


def test_file_order_over_many_blocks(spark, files, cal_df):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = tables.read_calibration(spark, str(files / "raw.csv"), file_order=True)
        assert df.rdd.getNumPartitions() > 3
        got = df.select("idx", "bmjd").orderBy("idx").toPandas()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got["idx"].tolist() == list(range(cal_df.count()))
    expect = pd.read_csv(files / "raw.csv", float_precision="round_trip")["bmjd"]
    np.testing.assert_array_equal(got["bmjd"].to_numpy(), expect.to_numpy())


def test_targets_skip_excluded_files(spark, files):
    df = tables.read_targets(spark, str(files / "star_*.csv"))
    assert {r["file_key"]: r["count"] for r in df.groupBy("file_key").count().collect()} == {"a1": 300, "b2": 400}


def test_stream_scores_new_files_once(spark, files, cal_df, tmp_path):
    model = Pipeline(stages=[CalibrationPrep(), PixelLinearModel()]).fit(cal_df)
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    pd.read_csv(files / "star_a1.csv", float_precision="round_trip").to_csv(inbox / "star_a1.csv", index=False)

    def run():
        stream = scoring.stream_targets(spark, str(inbox))
        scoring.score_stream(stream, model, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        return spark.read.parquet(str(tmp_path / "out"))

    assert run().count() == 300
    pd.read_csv(files / "star_b2.csv", float_precision="round_trip").to_csv(inbox / "star_b2.csv", index=False)
    out = run()
    assert {r["file_key"]: r["count"] for r in out.groupBy("file_key").count().collect()} == {"a1": 300, "b2": 400}
    batch = model.transform(tables.read_targets(spark, str(files / "star_*.csv")))
    both = [sorted(round(r[0], 12) for r in d.select("prediction").collect()) for d in (out, batch)]
    assert both[0] == both[1]


def test_residual_stream_keeps_one_row_per_file_over_batches_and_restarts(spark, files, cal_df, tmp_path):
    model = Pipeline(stages=[CalibrationPrep(), PixelLinearModel()]).fit(cal_df)
    inbox, out = tmp_path / "inbox", str(tmp_path / "sums")
    inbox.mkdir()
    parts = {k: pd.read_csv(files / f"star_{k}.csv", float_precision="round_trip") for k in ("a1", "b2")}

    def arrive(key, number, rows):
        where = inbox / f"part{number}"
        where.mkdir()
        parts[key].iloc[rows].to_csv(where / f"star_{key}.csv", index=False)

    def run():
        stream = scoring.stream_targets(spark, f"{inbox}/*", max_files=1)
        scoring.residual_stream(stream, model, out, str(tmp_path / "cp")).awaitTermination()
        rows = scoring.read_residuals(spark, out).collect()
        return {r["file_key"]: (r["n"], round(r["r2"], 8), round(r["chisq"], 4)) for r in rows}

    for i in range(3):
        arrive("a1", i, slice(100 * i, 100 * i + 100))
    assert {k: v[0] for k, v in run().items()} == {"a1": 300}
    arrive("b2", 3, slice(0, 150))
    arrive("b2", 4, slice(150, 400))
    got = run()  # a new query on the stored state
    assert run() == got  # nothing new
    assert sorted(p.name for p in (tmp_path / "sums").iterdir()) == ["slot=0", "slot=1"]
    batch = model.transform(tables.read_targets(spark, str(files / "star_*.csv")))
    scores = metrics.r2(batch, by="file_key").join(metrics.chisq(batch, by="file_key"), "file_key").join(
        batch.groupBy("file_key").count(), "file_key").collect()
    assert got == {r["file_key"]: (r["count"], round(r["r2"], 8), round(r["chisq"], 4)) for r in scores}


def test_variants_prune_to_one_partition(spark, cal_df, tmp_path):
    from lumenfit.plans.scaling import variant_vectors

    rows = tables.variant_rows(variant_vectors(cal_df), {v: v for v in tables.VARIANTS})
    tables.write_variants(rows, str(tmp_path / "v"))
    df = tables.load_features(spark, str(tmp_path / "v"), pre_process=True, pca=True)
    assert df.count() == cal_df.count() and "idx" in df.columns and "f15" in df.columns
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(variant" in plan
    span = df.agg(F.min("f3"), F.max("f3")).first()
    assert span[0] == pytest.approx(0.0, abs=1e-12) and span[1] == pytest.approx(1.0)


def test_prediction_names(spark, cal_df, tmp_path):
    assert tables.prediction_path("x/new.csv", "STD") == "x/new_STD_save.txt"
    df = cal_df.withColumn("prediction", F.col("flux"))
    assert tables.prediction_table(df).columns == ["bmjd", "flux", "fluxerr", "RF_Predict"]
    tables.write_predictions(df, str(tmp_path / "p"))
    assert spark.read.option("header", True).csv(str(tmp_path / "p")).count() == df.count()
    assert tables.write_bare_predictions(df, None) is False


def test_save_only_if_absent(spark, cal_df, tmp_path):
    path = str(tmp_path / "once")
    first = PixelLinearModel(slope=False).fit(cal_df)
    assert models.save_if_absent(first, path, spark)
    assert not models.save_if_absent(PixelLinearModel(slope=True).fit(cal_df), path, spark)
    assert models.load(path, spark).getOrDefault("slope") is False


CKPT = ("runs/saves_20240131120000_nnl1_nnn16_nc1_bs32_lr0.001_ne2000_ts0.75_rs42_PP1_PCA0/"
        "model_epoch_FINAL_l1.1785e-05_a0.20335_BatchR2-0.97701_TestR2-0.97597.ckpt")


def test_checkpoint_names(spark):
    paths = [
        CKPT,
        CKPT.replace("epoch_FINAL", "epoch17").replace("TestR2-0.97597", "TestR2--0.5"),
        CKPT.replace("_nnl1", "_WS20240131120000_nnl1").replace("nnn16", "nnn0"),
    ]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, path string")
    rows = runs.parse_checkpoint(runs.parse_run(df)).orderBy("i").collect()
    a, b, c = rows
    assert (a["n_nalu_layers"], a["n_nalu_neurons"], a["n_classes"], a["batch_size"]) == (1, 16, 1, 32)
    assert (a["learning_rate"], a["n_epochs"], a["test_size"], a["random_state"]) == (0.001, 2000, 0.75, 42)
    assert a["pre_process"] is True and a["pca_transform"] is False and a["warm_start"] is None
    assert a["epoch"] is None and a["is_final"]
    assert (a["loss"], a["accuracy"], a["batch_r2"], a["test_r2"]) == (1.1785e-05, 0.20335, 0.97701, 0.97597)
    assert b["epoch"] == 17 and b["test_r2"] == -0.5 and not b["is_final"]
    assert c["warm_start"] == "20240131120000"
    assert [r["n_nalu_neurons"] for r in runs.default_neurons(runs.parse_run(df), 16).orderBy("i").collect()] == [16] * 3
    assert runs.best_run(runs.parse_checkpoint(df)).first()["best_test_r2"] == 0.97597


def test_run_names_round_trip(spark):
    df = spark.createDataFrame(
        [(2, 0, 1, 64, 0.01, 500, 0.25, 7, False, True, "123")],
        "n_nalu_layers int, n_nalu_neurons int, n_classes int, batch_size int, learning_rate double, n_epochs int, "
        "test_size double, random_state int, pre_process boolean, pca_transform boolean, warm_start string",
    )
    path = runs.compose_run(df).first()["path"]
    assert path == "saves_WS123_nnl2_nnn0_nc1_bs64_lr0.01_ne500_ts0.25_rs7_PP0_PCA1/"
    back = runs.parse_run(spark.createDataFrame([(path,)], "path string")).drop("path")
    assert back.select(df.columns).first() == df.first()


def test_checkpoints_go_where_the_session_says(spark):
    assert ensure_checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()


def test_data_stays_on_the_cluster():
    """No local checkpoints, row-at-a-time functions, cross joins or prefix limits in the library."""
    import pathlib

    import lumenfit

    text = "\n".join(p.read_text() for p in pathlib.Path(lumenfit.__file__).parent.rglob("*.py"))
    for word in ("localCheckpoint", "F.udf(", "crossJoin", ".toPandas(", "toLocalIterator", "pickle"):
        assert word not in text, word


def test_target_files_are_few(spark, sf_dir, monkeypatch):
    """Files, each a micro-batch of a stream, follow the rows of a key and not the tasks that write them."""
    from lumenfit.plans import models as plans

    many = plans.cal_targets(spark, sf_dir).repartition(16)
    monkeypatch.setattr(plans, "cal_targets", lambda *_: many)
    back = spark.read.option("header", True).csv(plans._target_files(spark, sf_dir))
    assert back.count() == many.count() and len(back.inputFiles()) == back.select("file_key").distinct().count()
    monkeypatch.setattr(plans, "FILE_ROWS", 50)
    cut = spark.read.option("header", True).csv(plans._target_files(spark, sf_dir))
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, back.collect()))
