"""Feature engineering, resampling and metrics on closed-form cases."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfit import schema
from lumenfit.operators import features as fe
from lumenfit.operators import metrics
from lumenfit.operators.features import CalibrationPrep


def test_roles(cal_df):
    inputs, errors = schema.split_roles(cal_df)
    assert errors == ["fluxerr", "xerr", "yerr"] and "sigma_bg_flux" in inputs
    assert schema.pixel_cols(fe.pixel_errors(cal_df)) == schema.PIXELS
    roles = schema.Roles.of(cal_df)
    assert "flux" not in roles.inputs and roles.pixels == schema.PIXELS


def test_presets_never_hold_the_label(cal_df):
    sizes = {p: len(schema.feature_preset(cal_df, p)) for p in ("features15", "features16", "non_err", *schema.DROP_SETS)}
    assert sizes["features15"] == 15 and sizes["features16"] == 16 and sizes["drop3"] == 21
    for p in sizes:
        assert "flux" not in schema.feature_preset(cal_df, p)
    with pytest.raises(ValueError):
        schema.feature_preset(cal_df, "other")


def test_prep_applies_training_medians_to_new_data(cal_df, tmp_path):
    from pyspark.ml import Pipeline

    from lumenfit.sources import models

    model = Pipeline(stages=[CalibrationPrep()]).fit(cal_df)
    new = cal_df.where("idx % 2 = 0").drop("xycov", "dn_peak", "t_cernox")
    models.save(model, str(tmp_path / "prep"))
    back = models.load(str(tmp_path / "prep"), cal_df.sparkSession)
    m = np.median([r[0] for r in cal_df.select("flux").collect()])
    got = back.transform(new).select("idx", "flux").toPandas().set_index("idx")["flux"]
    raw = new.select("idx", "flux").toPandas().set_index("idx")["flux"]
    np.testing.assert_allclose(got.sort_index(), raw.sort_index() / m, rtol=1e-14)


def test_resample_is_deterministic_and_scaled(spark, cal_df):
    few = cal_df.where("idx < 200")
    a = fe.resample(few, n=2, seed=1).select("idx", "draw", "flux", "pix1").orderBy("idx", "draw").collect()
    b = fe.resample(few.repartition(7), n=2, seed=1).select("idx", "draw", "flux", "pix1").orderBy("idx", "draw")
    assert a == b.collect()
    c = fe.resample(few, n=2, seed=2).select("idx", "draw", "flux", "pix1").orderBy("idx", "draw").collect()
    assert a != c
    z = fe.resample(
        few.withColumns({"f0": F.col("flux"), "p0": F.col("pix1")}), n=40
    ).select(((F.col("flux") - F.col("f0")) / F.col("fluxerr")).alias("zf"),
             ((F.col("pix1") - F.col("p0")) / (F.col("p0") * F.col("fluxerr"))).alias("zp")).toPandas()
    assert np.abs(z.mean()).max() < 0.05 and np.abs(z.std() - 1).max() < 0.05
    assert abs(np.corrcoef(z["zf"], z["zp"])[0, 1]) < 0.05


def test_every_resampled_value_has_its_own_digests(spark):
    """Box-Muller on two draws of 52 bits, one digest each, of (seed, row, draw, column)."""
    rows = spark.createDataFrame([(i, 1.0, 0.5, 2.0, 0.25) for i in range(3)], "idx bigint, flux double, fluxerr double, xpos double, xerr double")

    def drawn(i, k, c):
        u = [(int(hashlib.md5(f"7:{i}:{k}:{c}:{part}".encode()).hexdigest()[:13], 16) + 0.5) * 2.0**-52 for part in ("radius", "angle")]
        return np.sqrt(-2 * np.log(u[0])) * np.cos(2 * np.pi * u[1])

    for r in fe.resample(rows, n=2, seed=7).collect():
        assert r.flux == pytest.approx(1 + 0.5 * drawn(r.idx, r.draw, "flux")) and r.xpos == pytest.approx(2 + 0.25 * drawn(r.idx, r.draw, "xpos"))


def test_sigma_clip_to_convergence(spark):
    x = np.concatenate([np.random.default_rng(0).normal(size=2000), [30.0, 300.0, 3000.0]])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    kept = x
    while True:
        m, s = kept.mean(), kept.std()
        new = kept[np.abs(kept - m) <= 4 * s]
        if len(new) == len(kept):
            break
        kept = new
    assert fe.sigma_clip(df, ["x"]).count() == len(kept)
    assert fe.sigma_clip(df, ["x"], robust=True).agg(F.max("x")).first()[0] < 10


def test_histogram_last_bin_is_closed(spark):
    df = spark.createDataFrame([(float(i),) for i in range(5)], "x double")
    rows = metrics.residual_histogram(df, "x", bins=4).orderBy("bin").collect()
    assert [r["n"] for r in rows] == [1, 1, 1, 2]
    dens = metrics.residual_histogram(df, "x", bins=4, density=True).agg(F.sum("density")).first()[0]
    assert dens == pytest.approx(1.0)
    one = spark.createDataFrame([(3.0,)] * 4, "x double")
    assert metrics.residual_histogram(one, "x", bins=2).agg(F.sum("n")).first()[0] == 4


def test_tolerance_is_relative_to_the_prediction(spark):
    df = spark.createDataFrame([(10.0, 0.0), (0.0, 0.0), (1.0001, 1.0)], "flux double, prediction double")
    got = metrics.tolerance_accuracy(df).first()[0]
    expect = np.isclose([10.0, 0.0, 1.0001], [0.0, 0.0, 1.0], atol=1e-4, rtol=1e-4).mean()
    assert got == pytest.approx(expect)


def test_scores_against_numpy(spark):
    rng = np.random.default_rng(5)
    y, e = rng.normal(size=400), 0.1 + rng.random(400)
    p = y + 0.1 * rng.normal(size=400)
    df = spark.createDataFrame(
        list(zip(y.tolist(), p.tolist(), e.tolist())), "flux double, prediction double, fluxerr double"
    ).repartition(3)
    chi, chi_mean = (((y - p) / e) ** 2).sum(), (((y - y.mean()) / e) ** 2).sum()
    assert metrics.r2(df).first()["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert metrics.rmse(df).first()[0] == pytest.approx(np.sqrt(((y - p) ** 2).mean()))
    assert metrics.chisq(df).first()[0] == pytest.approx(chi)
    assert metrics.rho2(df).first()[0] == pytest.approx(1 - chi / chi_mean)
    assert metrics.reduced_chisq(df).first()[0] == pytest.approx(3 * chi / 400)
    row = metrics.scatter_improvement(df).first()
    assert row["scatter_raw_pct"] == round(100 * np.std(y - np.median(y)), 3)
    assert row["scatter_fit_pct"] == round(100 * np.std(y - p), 3)


def test_sigma_clip_keeps_rows_without_a_value(spark):
    df = spark.range(400).selectExpr(
        "id as idx", "case when id % 10 = 0 then null when id % 10 = 1 then double('NaN') when id = 5 then 1e6 else id % 7 end as x"
    )
    for robust in (False, True):
        kept = {r["idx"] for r in fe.sigma_clip(df, "x", robust=robust).select("idx").collect()}
        assert kept == set(range(400)) - {5}


def test_ramp_over_equal_times(spark):
    """A step of zero gives what SQL's division gives, not an error; one row has no step."""
    rows = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 2.0), (3, 4.0)], "idx bigint, bmjd double")
    got = [r["freq"] for r in fe.freq_ramp(rows).orderBy("idx").collect()]
    assert np.isnan(got[0]) and got[1:] == [np.inf] * 3
    assert [r["freq"] for r in fe.freq_ramp(rows.limit(1)).collect()] == [None]
    steady = [r["freq"] for r in fe.freq_ramp(rows.where("idx <> 2")).orderBy("idx").collect()]
    assert np.allclose(steady, np.linspace(np.pi / 3, 4 * np.pi, 3))
