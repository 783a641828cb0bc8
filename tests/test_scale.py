"""Scalers and decompositions against numpy and by their invariants."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors

from lumenfit.operators import decompose, scale
from lumenfit.sources import models


def vectors(spark, x, parts=3):
    return spark.createDataFrame([(Vectors.dense(r),) for r in x], ["features"]).repartition(parts)


def matrix(df, col):
    return np.array([r[0] for r in df.select(vector_to_array(col)).collect()])


def test_population_deviation_and_constants(spark):
    df = vectors(spark, [[5.0, 1.0], [5.0, 2.0], [5.0, 4.0]])
    std = matrix(scale.PopulationScaler().fit(df).transform(df), "scaled")
    assert np.allclose(std[:, 0], 0) and np.isclose(std[:, 1].max(), (4 - 7 / 3) / 1.247219128924647)
    rng = matrix(scale.RangeScaler().fit(df).transform(df), "scaled")
    assert np.allclose(rng[:, 0], 0) and sorted(rng[:, 1]) == pytest.approx([0, 1 / 3, 1])
    filled = matrix(scale.RangeScaler(constantValue=0.5).fit(df).transform(df), "scaled")
    assert np.allclose(filled[:, 0], 0.5)


def test_inverse(spark):
    x = np.random.default_rng(0).normal(size=(50, 3)) * [1, 10, 100]
    df = vectors(spark, x)
    for est in (scale.PopulationScaler(), scale.RangeScaler()):
        model = est.fit(df)
        back = model.inverse(model.transform(df), "scaled", "back")
        assert np.allclose(matrix(back, "back"), matrix(back, "features"))


def test_pca_is_centred_orthonormal_and_reconstructs(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4)) + 100.0
    df = vectors(spark, x)
    model = decompose.CenteredPCA().fit(df)
    ratio, load = decompose.pca_summary(model)
    out = model.transform(df)
    scores, x = matrix(out, "components"), matrix(out, "features")
    assert np.allclose(load.T @ load, np.eye(4), atol=1e-10)
    assert np.allclose(scores.mean(axis=0), 0, atol=1e-9)
    assert np.allclose(scores @ load.T + x.mean(axis=0), x, atol=1e-8)
    lam = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert np.allclose(ratio, lam / lam.sum())
    assert all(load[np.abs(load[:, i]).argmax(), i] > 0 for i in range(4))
    assert decompose.components_for(model, 0.95) == int(np.searchsorted(np.cumsum(ratio), 0.95) + 1)
    assert set(out.columns) == {"features", "components"}


def test_whitening_of_collinear_columns(spark):
    x = np.random.default_rng(2).normal(size=(200, 2))
    x = np.column_stack([x, x.sum(axis=1)])
    out = decompose.CenteredPCA(whiten=True).fit(vectors(spark, x)).transform(vectors(spark, x))
    assert np.allclose(np.cov(matrix(out, "components").T), np.diag([1, 1, 0]), atol=1e-6)


@pytest.mark.parametrize("parts", [1, 5])
def test_ica_recovers_two_mixed_sources(spark, parts, tmp_path):
    t = np.linspace(0, 40, 2000)
    s = np.column_stack([np.sin(2 * t), (t % 1.7) / 1.7 - 0.5])
    df = vectors(spark, s @ np.array([[1.0, 0.6], [0.4, 1.2]]).T, parts)
    model = decompose.SymmetricICA().fit(df)
    models.save(model, str(tmp_path / "ica"))
    out = models.load(str(tmp_path / "ica"), spark).transform(df)
    got, x = matrix(out, "sources"), matrix(out, "features")
    truth = x @ np.linalg.inv(np.array([[1.0, 0.6], [0.4, 1.2]]).T)
    corr = np.abs(np.corrcoef(got.T, truth.T)[:2, 2:])
    assert np.allclose(np.cov(got.T), np.eye(2), atol=1e-6)
    assert corr.max(axis=1).min() > 0.98 and set(corr.argmax(axis=1)) == {0, 1}


def _excess(y):
    g = np.tanh(y)
    products = g.T @ y / len(y)
    return products, (1 - g * g).mean(axis=0) - np.diag(products)


def test_ica_reaches_a_stationary_rotation_beside_normal_components(spark):
    """Two normal columns leave a free plane, where the plain fixed point does not settle."""
    rng = np.random.default_rng(5)
    s = np.column_stack([rng.laplace(size=3000), rng.random(3000), rng.normal(size=3000), rng.normal(size=3000)])
    df = vectors(spark, s @ rng.normal(size=(4, 4)), 3)
    model = decompose.SymmetricICA(tol=1e-6).fit(df)
    fitted = next(m for m in decompose._stages(model) if isinstance(m, decompose.RotationModel))
    assert fitted.getOrDefault("change") < 1e-6 and fitted.getOrDefault("iterations") < 100
    got = matrix(model.transform(df), "sources")
    products, excess = _excess(got)
    signed = np.sign(excess)[:, None] * products
    assert np.abs(signed - signed.T).max() / 2 < 1e-5
    # a further step of the fixed point leaves such a rotation where it is
    new = products - np.diag(products.diagonal() + excess)
    u, _, v = np.linalg.svd(new)
    assert np.allclose(np.abs(u @ v), np.eye(4), atol=1e-3)


def test_ica_stops_at_its_limit(spark):
    df = vectors(spark, np.random.default_rng(6).normal(size=(300, 3)) ** 3, 2)
    fitted = decompose._stages(decompose.SymmetricICA(maxIter=2, tol=0.0).fit(df))
    assert next(m for m in fitted if isinstance(m, decompose.RotationModel)).getOrDefault("iterations") == 2


def test_rotation_is_the_exponential():
    a = np.random.default_rng(7).normal(size=(4, 4))
    a = a - a.T
    series, term = np.eye(4), np.eye(4)
    for i in range(1, 60):
        term = term @ a / i
        series = series + term
    assert np.allclose(decompose._rotation(a), series)
    assert np.allclose(series @ series.T, np.eye(4))


def test_linear_map_inline_and_looped(spark, monkeypatch):
    m = np.random.default_rng(3).normal(size=(3, 4))
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "a array<double>")
    from pyspark.sql import functions as F

    for limit in (0, 600):
        monkeypatch.setattr(decompose, "INLINE_TERMS", limit)
        assert np.allclose(df.select(decompose.linear_map(F.col("a"), m)).first()[0], m @ [1, 2, 3, 4])


def test_pipeline_flags(spark, cal_df):
    cols = ["xpos", "ypos", "pix1", "pix5"]
    for flags in ((True, True, False, True), (False, False, False, False), (True, False, True, False)):
        model = decompose.build_pipeline(cols, *flags).fit(cal_df)
        out = model.transform(cal_df)
        assert set(out.columns) == {*cal_df.columns, "features"}
        assert len(matrix(out.limit(1), "features")[0]) == 4
    assert decompose.pipeline_header(True, True, False, True) == "STD_SS_PCA_MM"


def test_moments(spark):
    x = np.random.default_rng(4).normal(size=(100, 3)) * [1, 5, 0]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double").repartition(3)
    n, mean, cov = scale.moments(df, ["a", "b", "c"])
    assert n == 100 and np.allclose(mean, x.mean(axis=0)) and np.allclose(cov, np.cov(x.T))


def test_scale_by_group_handles_constants(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 7.0)], "g string, v double")
    got = sorted((r["g"], r["v"]) for r in scale.scale_by_group(df, ["v"], "g").collect())
    assert got == [("a", 0.0), ("a", 1.0), ("b", 0.0)]


def test_assembled_columns_keep_order(spark):
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(
        spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    )
    assert matrix(df, "features").tolist() == [[1.0, 2.0]]


def test_covariance_with_nulls_agrees_with_sql(spark):
    from pyspark.sql import functions as F

    from lumenfit.operators.decompose import covariance

    df = spark.range(200).selectExpr(
        "if(id % 7 = 0, null, cast(id as double)) as a", "if(id % 5 = 0, null, id * 3.5e0 + id % 3) as b", "cast(null as double) as c"
    )
    got = {(r["a"], r["b"]): r["cov"] for r in covariance(df, ["a", "b", "c"]).collect()}
    want = df.agg(F.var_samp("a"), F.covar_samp("a", "b"), F.var_samp("b")).first()
    assert [got["a", "a"], got["a", "b"], got["b", "b"]] == pytest.approx(list(want), rel=1e-12)
    assert all(np.isnan(v) for k, v in got.items() if "c" in k)
    assert all(np.isnan(r["cov"]) for r in covariance(df.limit(0), ["a", "b"]).collect())
