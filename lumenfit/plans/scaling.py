"""Catalogue: scalers and decompositions (D-S1 .. D-S8, D-P1 .. D-P3, D-I1, D-C1)."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lumenfit.operators import decompose, scale, splits
from lumenfit.operators.features import unpack_features
from lumenfit.plans.cal import FEATURES, cal
from lumenfit.plans.registry import on_cal, query, rnd, rounded, sql_rnd, sql_rounded
from lumenfit.session import scratch_path
from lumenfit.sources import tables


def assembled(df, cols=FEATURES, output="features"):
    return VectorAssembler(inputCols=cols, outputCol=output).transform(df)


_STATS = "st as (select " + ", ".join(
    f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}, min({c}) as a_{c}, max({c}) as b_{c}"
    for c in [*FEATURES, "flux"]) + " from cal)"
_STD = {c: f"({c}-m_{c})/s_{c}" for c in FEATURES}
_MINMAX = {c: f"({c}-a_{c})/(b_{c}-a_{c})" for c in FEATURES}


@query("std_scale", on_cal(f"select idx, {sql_rounded(_STD)} from cal, st", _STATS))
def std_scale(spark, sf):
    df = assembled(cal(spark, sf))
    out = scale.PopulationScaler().fit(df).transform(df)
    return rounded(unpack_features(out, FEATURES, "scaled", ("idx",)), FEATURES)


@query("minmax_scale", on_cal(f"select idx, {sql_rounded(_MINMAX)} from cal, st", _STATS))
def minmax_scale(spark, sf):
    df = assembled(cal(spark, sf))
    out = scale.RangeScaler().fit(df).transform(df)
    return rounded(unpack_features(out, FEATURES, "scaled", ("idx",)), FEATURES)


@query("scale_constant", on_cal("select idx, 0e0 as c_std, 0e0 as c_minmax from cal"))
def scale_constant(spark, sf):
    """A constant column becomes zero under both scalers."""
    df = assembled(cal(spark, sf).withColumn("c", F.lit(0.1)), ["c", "flux"])
    df = scale.PopulationScaler(outputCol="s").fit(df).transform(df)
    df = scale.RangeScaler(outputCol="r").fit(df).transform(df)
    return df.select(
        "idx", rnd(vector_to_array("s")[0]).alias("c_std"), rnd(vector_to_array("r")[0]).alias("c_minmax")
    )


@query("label_scale", on_cal("select idx, " + sql_rounded({
    "standard": "(flux-m_flux)/s_flux", "minmax": "(flux-a_flux)/(b_flux-a_flux)", "restored": "flux",
}) + " from cal, st", _STATS))
def label_scale(spark, sf):
    df = cal(spark, sf)
    standard = scale.LabelScaler(outputCol="standard").fit(df)
    minmax = scale.LabelScaler(outputCol="minmax", kind="minmax").fit(df)
    out = minmax.transform(standard.transform(df))
    out = out.withColumn("restored", standard.inverse(F.col("standard")))
    return rounded(out, ["standard", "minmax", "restored"])


_SPLIT = ("sp as (select *, case when r <= ceil(2e-1*n) then 'val' when r <= ceil(2e-1*n) + "
          "ceil(5e-1*(n-ceil(2e-1*n))) then 'test' else 'train' end as split from (select *, row_number() over "
          "(order by md5(idx || ':42')) as r, count(*) over () as n from cal))")
_GROUPED = ["flux", "xpos", "ypos", "pix5"]


@query("minmax_by_split", on_cal(
    "select idx, split, " + sql_rounded({
        c: f"({c} - min({c}) over (partition by split)) / (max({c}) over (partition by split) - "
           f"min({c}) over (partition by split))" for c in _GROUPED}) + " from sp", _SPLIT))
def minmax_by_split(spark, sf):
    df = splits.hash_split3(cal(spark, sf), fracs={"val": 0.2, "test": 0.4, "train": 0.4})
    return rounded(scale.scale_by_group(df, _GROUPED, "split"), _GROUPED, keep=("idx", "split"))


@query("scale_fit_on_train", on_cal(
    f"select idx, split, {sql_rounded({c: f'({c}-m_{c})/s_{c}' for c in _GROUPED[1:]})} from sp, tr", _SPLIT,
    "tr as (select " + ", ".join(f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}" for c in _GROUPED[1:])
    + " from sp where split = 'train')"))
def scale_fit_on_train(spark, sf):
    """Statistics from the training rows, applied to every row."""
    df = splits.hash_split3(cal(spark, sf), fracs={"val": 0.2, "test": 0.4, "train": 0.4})
    df = assembled(df, _GROUPED[1:])
    out = scale.PopulationScaler().fit(df.where("split = 'train'")).transform(df)
    return rounded(unpack_features(out, _GROUPED[1:], "scaled", ("idx", "split")), _GROUPED[1:],
                   keep=("idx", "split"))


_ROWS = "select unnest(range({})) as i"


@query("full_pipeline", f"select i, 0e0 as lowest, 1e0 as highest from ({_ROWS.format(len(FEATURES))})")
def full_pipeline(spark, sf):
    """Standard scaling, PCA and min-max chained: every component spans [0, 1]."""
    df = cal(spark, sf)
    model = decompose.build_pipeline(FEATURES, True, True, False, True, whiten=False).fit(df)
    long = model.transform(df).select(F.posexplode(vector_to_array("features")).alias("i", "x"))
    return long.groupBy(F.col("i").cast("bigint").alias("i")).agg(
        rnd(F.min("x")).alias("lowest"), rnd(F.max("x")).alias("highest")
    )


def variant_vectors(df):
    """The raw, scaled and decomposed feature vectors of one table, from one fitted chain each."""
    df = assembled(df, output="raw")
    for stage in (
        scale.PopulationScaler(inputCol="raw", outputCol="standard"),
        decompose.CenteredPCA(inputCol="standard", outputCol="pca_of_standard"),
        scale.RangeScaler(inputCol="raw", outputCol="minmax"),
        scale.RangeScaler(inputCol="pca_of_standard", outputCol="minmax_of_pca"),
    ):
        df = stage.fit(df).transform(df)
    return df.withColumn("full_pipe", F.col("minmax_of_pca"))


_F16 = {f"f{i}": _MINMAX[c] for i, c in enumerate(FEATURES)}


@query("features_variant_load", on_cal(f"select idx, {sql_rounded(_F16)} from cal, st", _STATS))
def features_variant_load(spark, sf):
    """All six variants stored partitioned by variant, one read back."""
    path = scratch_path(spark, "variants")
    rows = tables.variant_rows(variant_vectors(cal(spark, sf)), {v: v for v in tables.VARIANTS})
    tables.write_variants(rows, path)
    return rounded(tables.load_features(spark, path, pre_process=True, pca=False), list(_F16))


@query("variant_sizes", on_cal(
    "select variant, count(*) as n from cal, (select unnest(['" + "','".join(tables.VARIANTS)
    + "']) as variant) group by variant"))
def variant_sizes(spark, sf):
    rows = tables.variant_rows(variant_vectors(cal(spark, sf)), {v: v for v in tables.VARIANTS})
    return rows.groupBy("variant").agg(F.count(F.lit(1)).alias("n"))


_PAIRS = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i:]]


@query("covariance", on_cal(
    "select a, b, " + sql_rnd("cov", 7) + " as cov from (" + " union all ".join(
        f"select '{a}' as a, '{b}' as b, covar_samp({a}, {b}) as cov from cal" for a, b in _PAIRS) + ")"))
def covariance(spark, sf):
    out = decompose.covariance(cal(spark, sf), FEATURES)
    return out.select("a", "b", rnd("cov", 7).alias("cov"))


_LINEITEM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("covariance_lineitem", "select a, b, " + sql_rnd("cov", 3) + " as cov from (" + " union all ".join(
    f"select '{a}' as a, '{b}' as b, covar_samp({a}, {b}) as cov from lineitem"
    for i, a in enumerate(_LINEITEM) for b in _LINEITEM[i:]) + ")")
def covariance_lineitem(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet").select(*[F.col(c).cast("double") for c in _LINEITEM])
    return decompose.covariance(df, _LINEITEM).select("a", "b", rnd("cov", 3).alias("cov"))


_TRACE = [
    _STATS,
    "z as (select " + ", ".join(f"{e} as {c}" for c, e in _STD.items()) + " from cal, st)",
    "c1 as (" + " union all ".join(
        f"select '{a}' as a, '{b}' as b, covar_samp({a}, {b}) as v from z" for a in FEATURES for b in FEATURES) + ")",
]


@query("pca_variance", on_cal(
    "select " + sql_rounded({
        "power1": "(select sum(v) from c1 where a = b)",
        "power2": "(select sum(v*v) from c1)",
        "power3": "(select sum(p.v*q.v*r.v) from c1 p join c1 q on p.b = q.a join c1 r on q.b = r.a and r.b = p.a)",
    }, 4), *_TRACE))
def pca_variance(spark, sf):
    """Sums of powers of the eigenvalues, which equal traces of powers of the covariance matrix."""
    df = cal(spark, sf)
    df = scale.PopulationScaler().fit(assembled(df)).transform(assembled(df))
    pca = decompose.CenteredPCA(inputCol="scaled").fit(df)
    scored = pca.transform(df).select(vector_to_array("components").alias("x"))
    lam = scored.agg(*[F.var_samp(F.col("x")[i]) for i in range(len(FEATURES))]).first()
    powers = [[float(sum(v**k for v in lam)) for k in (1, 2, 3)]]
    out = spark.createDataFrame(powers, "power1 double, power2 double, power3 double")
    return rounded(out, out.columns, 4, keep=())


@query("pca_components")
def pca_components(spark, sf):
    """Loadings, explained variance and the smallest number of components for 95 %."""
    df = cal(spark, sf)
    df = scale.PopulationScaler().fit(assembled(df)).transform(assembled(df))
    pca = decompose.CenteredPCA(inputCol="scaled").fit(df)
    ratio, loadings = decompose.pca_summary(pca)
    k = decompose.components_for(pca, 0.95)
    rows = [
        (i, FEATURES[j], float(loadings[j, i]), float(ratio[i]), k)
        for i in range(len(ratio)) for j in range(len(FEATURES))
    ]
    return spark.createDataFrame(
        rows, "component int, feature string, loading double, explained double, k95 int"
    )


@query("pca_k95", on_cal(
    "select case when share >= 95e-2 then 1 else 2 end as k95, " + sql_rounded({"explained": "share"}) + ", n from "
    "(select (1e0 + abs(corr(flux, 3e0*flux + 5e-3*xpos))) / 2e0 as share, count(*) as n from cal)"))
def pca_k95(spark, sf):
    """Components for 95 % of two standardised columns, whose shares their correlation gives."""
    df = cal(spark, sf).selectExpr("idx", "flux", "3e0*flux + 5e-3*xpos as other")
    packed = VectorAssembler(inputCols=["flux", "other"], outputCol="features").transform(df)
    scaled = scale.PopulationScaler().fit(packed).transform(packed)
    pca = decompose.CenteredPCA(inputCol="scaled").fit(scaled)
    out = df.agg(
        F.lit(decompose.components_for(pca, 0.95)).alias("k95"), F.lit(float(decompose.pca_summary(pca)[0][0])).alias("explained"),
        F.count(F.lit(1)).alias("n"),
    )
    return rounded(out, ["explained"], keep=("k95", "n"))


_IDENTITY = "select i, j, case when i = j then 1e0 else 0e0 end as cov from " \
            "(select unnest(range({0})) as i), (select unnest(range({0})) as j)"


def _cov_of(df, vector: str, d: int):
    cols = [f"x{i:03d}" for i in range(d)]
    wide = unpack_features(df, cols, vector)
    half = decompose.covariance(wide, cols).select(
        F.substring("a", 2, 3).cast("bigint").alias("i"), F.substring("b", 2, 3).cast("bigint").alias("j"), "cov"
    )
    both = half.union(half.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "cov"))
    return both.select("i", "j", rnd("cov", 5).alias("cov"))


@query("pca_whiten", _IDENTITY.format(len(FEATURES)))
def pca_whiten(spark, sf):
    """Whitened components have the identity as covariance."""
    df = assembled(cal(spark, sf))
    df = scale.PopulationScaler().fit(df).transform(df)
    out = decompose.CenteredPCA(inputCol="scaled", whiten=True).fit(df).transform(df)
    return _cov_of(out, "components", len(FEATURES))


@query("pca_embeddings", "with e as (select vec_id, unnest(embedding)::double as v, "
       "generate_subscripts(embedding, 1) as k from embeddings) "
       "select " + sql_rnd("sum(s)", 5) + " as total_variance from (select var_samp(v) as s from e group by k)")
def pca_embeddings(spark, sf):
    """Wide vectors: the component variances add up to the total variance."""
    from pyspark.ml.functions import array_to_vector

    df = spark.read.parquet(f"{sf}/embeddings.parquet").select(
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
    )
    out = decompose.CenteredPCA().fit(df).transform(df)
    x = out.select(F.posexplode(vector_to_array("components")).alias("k", "v"))
    return x.groupBy("k").agg(F.var_samp("v").alias("s")).agg(rnd(F.sum("s"), 5).alias("total_variance"))


@query("ica", _IDENTITY.format(len(FEATURES)))
def ica(spark, sf):
    """Independent components have unit variance and no correlation."""
    df = assembled(cal(spark, sf))
    df = scale.PopulationScaler().fit(df).transform(df)
    model = decompose.SymmetricICA(inputCol="scaled").fit(df)
    return _cov_of(model.transform(df), "sources", len(FEATURES))


_SOURCES = {"even": "((idx * 7919) % 1009) / 1009e0", "squared": "pow((idx % 97) / 97e0, 2)", "two": "(idx div 3) % 2 * 1e0"}


@query("ica_known_mix", "select unnest(['even', 'squared', 'two']) as source, 1e0 as recovered, count(*) as n from events")
def ica_known_mix(spark, sf):
    """Three known sources, mixed: the correlation of each with the component that recovers it."""
    df = cal(spark, sf).selectExpr("idx", *[f"{e} as {c}" for c, e in _SOURCES.items()])
    mixed = df.selectExpr("*", "2*even + squared - two as m1", "even - 3*squared + two as m2", "even + squared + 2*two as m3")
    packed = VectorAssembler(inputCols=["m1", "m2", "m3"], outputCol="features").transform(mixed)
    out = decompose.SymmetricICA().fit(packed).transform(packed).withColumn("s", vector_to_array("sources"))
    pairs = [F.abs(F.corr(c, F.col("s")[k])) for c in _SOURCES for k in range(3)]
    cells = F.array(*[F.struct(F.lit(c).alias("source"), F.round(F.greatest(*pairs[3 * i: 3 * i + 3]), 1).alias("recovered"))
                      for i, c in enumerate(_SOURCES)])
    return out.agg(cells.alias("c"), F.count(F.lit(1)).alias("n")).select(F.explode("c").alias("c"), "n").select("c.*", "n")


@query("ica_kurtosis")
def ica_kurtosis(spark, sf):
    """How far from normal each recovered component is."""
    df = assembled(cal(spark, sf))
    df = scale.PopulationScaler().fit(df).transform(df)
    model = decompose.SymmetricICA(inputCol="scaled").fit(df)
    x = model.transform(df).select(F.posexplode(vector_to_array("sources")).alias("component", "v"))
    return x.groupBy("component").agg(
        F.round(F.kurtosis("v"), 4).alias("kurtosis"), F.round(F.skewness("v"), 4).alias("skewness")
    )


@query("pipeline_header", on_cal(
    f"select header, {len(FEATURES)} as width, n from (select unnest(['STD_SS', 'STD_SS_PCA', 'STD_SS_PCA_MM', 'STD_MM']) "
    "as header), (select count(*) as n from cal)"))
def pipeline_header(spark, sf):
    """Flag combinations with the header each records and the output width it produces on the table."""
    df = cal(spark, sf)
    rows = []
    for flags in ((True, False, False, False), (True, True, False, False), (True, True, False, True),
                  (False, False, False, True)):
        model = decompose.build_pipeline(FEATURES, *flags).fit(df)
        top = model.transform(df).agg(F.max(F.size(vector_to_array("features"))), F.count(F.lit(1))).first()
        rows.append((decompose.pipeline_header(*flags), int(top[0]), int(top[1])))
    return spark.createDataFrame(rows, "header string, width int, n bigint")
