"""Catalogue: regressors, search, persistence and streaming (R-1 .. R-23, H-1 .. H-4, S-10 .. S-14, ST-1, ST-2).

Whole tree and network fits have no SQL counterpart; their queries report scores over whole splits, and small fits that SQL
can follow stand beside them. Sizes (trees, rounds, epochs) are kept small where each is a Spark job; trees grown level by
level have the library's own sizes.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfit import schema
from lumenfit.functions import kernels
from lumenfit.functions.hashing import draw_sql, poisson1_sql, uniform_sql
from lumenfit.operators import boost, features as fe, forest, median, metrics, neural, runtable, scale, search, splits
from lumenfit.operators.common import spread
from lumenfit.operators.ensemble import predict_as
from lumenfit.operators.linear import PixelLinearModel
from lumenfit.plans.cal import FEATURES, FILE_KEY, cal, cal_targets
from lumenfit.plans.features import MED, PIX_SUM
from lumenfit.plans.registry import on_cal, query, rnd, rounded, sql_rnd, sql_rounded
from lumenfit.schema import FLUX_SCALED, PIXELS
from lumenfit.session import materialise, scratch_path
from lumenfit.sources import models, runs, tables
from lumenfit.streaming import scoring

# --- pixel linear model, checked against least squares by successive orthogonalisation in SQL --------------


def _least_squares(terms: dict[str, str], y: str, source: str, keep: str = "") -> list[str]:
    """CTEs ending in ``fit(idx, y, prediction)``: project the terms out of the label one after another."""
    names = list(terms)
    ctes = [
        f"g0 as (select idx, {keep} y as y0, y - avg(y) over () as y, "
        + ", ".join(f"{n} - avg({n}) over () as {n}" for n in names)
        + f" from (select idx, {keep} {y} as y, " + ", ".join(f"{e} as {n}" for n, e in terms.items())
        + f" from {source}))"
    ]
    for i, n in enumerate(names):
        rest = names[i + 1:] + ["y"]
        ctes.append(
            f"d{i} as (select " + ", ".join(f"sum({n}*{r})/sum({n}*{n}) as k_{r}" for r in rest) + f" from g{i})"
        )
        ctes.append(
            f"g{i + 1} as (select idx, {keep} y0, " + ", ".join(f"g.{r} - k_{r}*g.{n} as {r}" for r in rest)
            + f" from g{i} g, d{i})"
        )
    ctes.append(f"fit as (select idx, {keep} y0 as y, y0 - y as prediction from g{len(names)})")
    return ctes


_NORM = ("nrm as (select * replace (" + ", ".join(f"{c}/m as {c}" for c in FLUX_SCALED) + ", "
         + ", ".join(f"{p}/{PIX_SUM} as {p}" for p in PIXELS) + ") from cal, med)")
_TIME = {"t": "bmjd - (select avg(bmjd) from cal)"}
# The ninth normalised pixel is one minus the others, so it adds nothing to the fit.
_PIX = {p: p for p in PIXELS[:-1]}


def _normalised(df):
    return fe.pld_normalize(fe.median_normalize(df))


@query("pixel_model_scatter", on_cal(
    "select count(*) as n, " + sql_rounded({
        "r2": "1e0 - sum((y-prediction)*(y-prediction))/(var_pop(y)*count(*))",
        "red_chisq": "sum((y-prediction)*(y-prediction)/(fluxerr*fluxerr/3e0))/count(*)",
    }) + ", " + sql_rounded({
        "scatter_raw_pct": "100e0*stddev_pop(y)", "scatter_fit_pct": "100e0*stddev_pop(y-prediction)",
    }, 3) + " from fit", MED, _NORM, *_least_squares({**_TIME, **_PIX}, "flux", "nrm", "fluxerr,")))
def pixel_model_scatter(spark, sf):
    """How much scatter the pixel model removes."""
    df = _normalised(cal(spark, sf))
    scored = PixelLinearModel().fit(df).transform(df)
    return scored.agg(
        F.count(F.lit(1)).alias("n"),
        rnd(metrics.r2_expr("flux", "prediction")).alias("r2"),
        rnd(F.avg(3.0 * metrics.chi_expr("flux", "prediction", "fluxerr"))).alias("red_chisq"),
        rnd(100.0 * F.stddev_pop("flux"), 3).alias("scatter_raw_pct"),
        rnd(100.0 * F.stddev_pop(F.col("flux") - F.col("prediction")), 3).alias("scatter_fit_pct"),
    )


@query("pixel_linear_fit", on_cal(
    f"select idx, {sql_rounded(['prediction'])} from fit", MED, _NORM,
    *_least_squares({**_TIME, **_PIX}, "flux", "nrm")))
def pixel_linear_fit(spark, sf):
    df = _normalised(cal(spark, sf))
    return rounded(PixelLinearModel().fit(df).transform(df), ["prediction"])


@query("pixel_linear_curvature", on_cal(
    f"select idx, {sql_rounded(['prediction'])} from fit", MED, _NORM,
    *_least_squares({**_TIME, "t2": "(bmjd - (select avg(bmjd) from cal))*(bmjd - (select avg(bmjd) from cal))",
                     **_PIX}, "flux", "nrm")))
def pixel_linear_curvature(spark, sf):
    df = _normalised(cal(spark, sf))
    return rounded(PixelLinearModel(curvature=True).fit(df).transform(df), ["prediction"])


@query("single_regressor_fit", on_cal(
    "select idx, " + sql_rnd("k.a + k.b*xpos") + " as prediction from cal, "
    "(select regr_slope(flux, xpos) as b, regr_intercept(flux, xpos) as a from cal) k"))
def single_regressor_fit(spark, sf):
    df = cal(spark, sf)
    model = PixelLinearModel(pixCols=["xpos"], slope=False).fit(df)
    return rounded(model.transform(df), ["prediction"])


_TARGET_FIT = [*_least_squares({**_TIME, **_PIX}, "flux", "nrm", "file_key, fluxerr,")]
_BY_FILE = ("select file_key, count(*) as n, " + sql_rounded({
    "r2": "1e0 - sum((y-prediction)*(y-prediction))/(var_pop(y)*count(*))",
    "chisq": "sum((y-prediction)*(y-prediction)/(fluxerr*fluxerr))",
}, 4) + " from fit group by file_key")


def _pixel_pipeline(spark, sf):
    """Preparation and pixel model fitted on the calibration table, as one pipeline."""
    return Pipeline(stages=[fe.CalibrationPrep(), PixelLinearModel()]).fit(cal(spark, sf))


@query("score_targets", on_cal(_BY_FILE, MED, _NORM, *_TARGET_FIT, extra=FILE_KEY))
def score_targets(spark, sf):
    """One fitted pipeline over the union of all target files, scored per file."""
    scored = search.score(_pixel_pipeline(spark, sf), cal_targets(spark, sf))
    out = scored.groupBy("file_key").agg(
        F.count(F.lit(1)).alias("n"), metrics.r2_expr("flux", "prediction").alias("r2"),
        F.sum(metrics.chi_expr("flux", "prediction", "fluxerr")).alias("chisq"),
    )
    return rounded(out, ["r2", "chisq"], 4, keep=("file_key", "n"))


def _named_targets(spark, sf, root: str) -> list[str]:
    """One CSV file per file key, named after it, and one that a glob of targets must skip; the keys come back."""
    rows = cal_targets(spark, sf).select(*[f.name for f in schema.TARGET_SCHEMA], "file_key")
    rows.repartition("file_key").write.partitionBy("file_key").option("header", True).csv(f"{root}/parts")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(f"{root}/parts")
    fs, keys = at.getFileSystem(conf), []
    for folder in (f.getPath() for f in fs.listStatus(at) if f.isDirectory()):
        key = folder.getName().split("=")[1]
        part = next(f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-"))
        fs.rename(part, jvm.org.apache.hadoop.fs.Path(f"{root}/target_{'NALU_' if key == 't7' else ''}{key}.csv"))
        keys.append(key)
    return sorted(keys)


@query("targets_named_files", on_cal(
    f"select * from ({_BY_FILE}) where file_key <> 't7'", MED, _NORM, *_TARGET_FIT, extra=FILE_KEY))
def targets_named_files(spark, sf):
    """Targets read from a glob, scored, and each file's predictions written under its own name and read back."""
    root, pipeline = scratch_path(spark, "named"), _pixel_pipeline(spark, sf)
    keys = _named_targets(spark, sf, root)
    scored = pipeline.transform(tables.read_targets(spark, f"{root}/target_*.csv"))
    for key in keys:
        source = f"{root}/target_{key}.csv"
        tables.write_predictions(scored.where(F.col("file_key") == key), tables.prediction_path(source, "std"))
    stored = spark.read.option("header", True).schema("bmjd double, flux double, fluxerr double, RF_Predict double")
    back = stored.csv(f"{root}/target_*_std_save.txt").withColumn(
        "file_key", F.regexp_extract(F.col("_metadata.file_path"), "target_([^_/]+)_std_save", 1))
    out = back.groupBy("file_key").agg(
        F.count(F.lit(1)).alias("n"), metrics.r2_expr("flux", "RF_Predict").alias("r2"),
        F.sum(metrics.chi_expr("flux", "RF_Predict", "fluxerr")).alias("chisq"),
    )
    return rounded(out, ["r2", "chisq"], 4, keep=("file_key", "n"))


@query("save_load_pipeline", on_cal(
    f"select idx, {sql_rounded(['prediction'])} from fit", MED, _NORM,
    *_least_squares({**_TIME, **_PIX}, "flux", "nrm")))
def save_load_pipeline(spark, sf):
    """A saved pipeline read back holds the medians and coefficients it was fitted with."""
    path = scratch_path(spark, "pipeline")
    models.save(_pixel_pipeline(spark, sf), path)
    return rounded(models.load(path, spark).transform(cal(spark, sf)), ["prediction"])


@query("save_if_absent", on_cal("select count(*) as n, true as first_written, false as second_written from cal"))
def save_if_absent(spark, sf):
    path = scratch_path(spark, "once")
    model = _pixel_pipeline(spark, sf)
    first = models.save_if_absent(model, path, spark)
    second = models.save_if_absent(model, path, spark)
    scored = models.load(path, spark).transform(cal(spark, sf))
    return scored.agg(
        F.count("prediction").alias("n"), F.lit(first).alias("first_written"), F.lit(second).alias("second_written")
    )


_RUNS = {"saves_nnl1_nnn0_nc1_bs32_lr0.001_ne1_ts0.75_rs42_PP1_PCA0/": ("75e-2", "42"),
         "saves_nnl1_nnn0_nc1_bs32_lr0.001_ne1_ts0.25_rs7_PP1_PCA0/": ("25e-2", "7")}


def _rescored_sql(runs: list[str]) -> str:
    ctes, rows = [], []
    for i, run in enumerate(runs):
        share, seed = _RUNS[run]
        ctes.append(
            f"s{i} as (select y, prediction, fluxerr, row_number() over (order by md5(idx || ':{seed}')) "
            f"<= ceil({share} * count(*) over ()) as test from fit)")
        scores = {}
        for part, on in (("train", "not test"), ("test", "test")):
            scores[f"{part}_r2_pct"] = (f"1e2 * (1e0 - sum((y-prediction)*(y-prediction)) filter ({on}) / "
                                        f"(var_pop(y) filter ({on}) * count(*) filter ({on})))")
            scores[f"chisq_{part}"] = f"sum((y-prediction)*(y-prediction)/(fluxerr*fluxerr)) filter ({on})"
        rows.append(f"select '{run}' as path, count(*) filter (not test) as n_train, count(*) filter (test) as n_test, "
                    f"{sql_rounded(scores, 4)} from s{i}")
    return on_cal(" union all ".join(rows), MED, _NORM, *_least_squares({**_TIME, **_PIX}, "flux", "nrm", "fluxerr,"), *ctes)


def _stored_runs(spark, sf, names) -> str:
    root, model = scratch_path(spark, "runs"), _pixel_pipeline(spark, sf)
    for name in names:
        models.save(model, f"{root}/{name.strip('/')}")
    return root


def _rescored(df):
    return rounded(df, ["train_r2_pct", "test_r2_pct", "chisq_train", "chisq_test"], 4, keep=("path", "n_train", "n_test"))


@query("run_rescore", _rescored_sql([*_RUNS][:1]))
def run_rescore(spark, sf):
    """A stored run scored again from its path: the split is drawn anew from the share and seed in the name."""
    run = [*_RUNS][0]
    df = cal(spark, sf)
    return _rescored(search.rescore(spark, _stored_runs(spark, sf, [run]), run, df))


@query("runs_chisq", _rescored_sql([*_RUNS]))
def runs_chisq(spark, sf):
    """Scores of every run of a registry."""
    return _rescored(search.rescore_all(spark, _stored_runs(spark, sf, _RUNS), [*_RUNS], cal(spark, sf)))


# A thousand small networks whose weights follow from the run's number, on three features.
_NET = ["xpos - 145e-1", "ypos - 145e-1", "pix5"]
_SPEC = '{"kind": "dense", "n_in": 3, "hidden": [2], "batch_norm": false, "dropout": 0.0, "activation": "relu"}'
_WEIGHT = "((run*{0} + {1}) % 23 - 11) / 100e0"  # of the hidden layer
_SHARES = {"test_size": "(case when run % 2 = 0 then 25e-2 else 75e-2 end)", "random_state": "run % 4"}
_HIDDEN = [[_WEIGHT.format(7 + i, 3 * j) for j in range(2)] for i in range(3)]
_OUT = ["5e-1", "-25e-2", "4e-1 + run/1e5"]


def _units(x: list[str]) -> list[str]:
    return [f"greatest(0e0, {' + '.join(f'({e})*({_HIDDEN[i][j]})' for i, e in enumerate(x))} + 1e-2)" for j in range(2)]


@query("registry_scores", on_cal(
    "select path, count(*) filter (not test) as n_train, count(*) filter (test) as n_test, " + sql_rounded({
        **{f"{part}_r2_pct": f"1e2*(1e0 - sum((flux-p)*(flux-p)) filter ({on}) / (var_pop(flux) filter ({on}) * count(*) filter ({on})))"
           for part, on in (("train", "not test"), ("test", "test"))},
        **{f"red_chisq_{part}": f"3e0*sum((flux-p)*(flux-p)/(fluxerr*fluxerr)) filter ({on}) / count(*) filter ({on})"
           for part, on in (("train", "not test"), ("test", "test"))},
    }, 4) + " from scored group by path",
    "runs as (select *, concat('saves_nnl1_nnn2_nc1_bs32_lr0.001_ne', run, '_ts', case when run % 2 = 0 then '0.25' else '0.75' end, "
    "'_rs', run % 4, '_PP1_PCA0/') as path from (select unnest(range(1, 1001)) as run))",
    "drawn as (select *, row_number() over (partition by seed order by md5(idx || ':' || seed)) as place, "
    "count(*) over (partition by seed) as n from cal, (select unnest(range(4)) as seed))",
    f"scored as (select path, flux, fluxerr, place <= ceil({_SHARES['test_size']} * n) as test, "
    f"{' + '.join(f'({o})*{u}' for o, u in zip(_OUT, _units(_NET)))} + {_OUT[2]} as p from drawn join runs on seed = run % 4)"))
def registry_scores(spark, sf):
    """Every one of a thousand stored networks scored on its own split, in one pass over the table."""
    settings = {"n_nalu_layers": "1", "n_nalu_neurons": "2", "n_classes": "1", "batch_size": "32", "learning_rate": "1e-3",
                "n_epochs": "run", **_SHARES, "pre_process": "true", "pca_transform": "false"}
    stored = runs.compose_run(spark.range(1, 1001).selectExpr("id as run").selectExpr("run", *[f"{e} as {c}" for c, e in settings.items()]))
    flat = [w for row in _HIDDEN for w in row] + ["1e-2", "1e-2"] + _OUT
    table = scratch_path(spark, "registry")
    runtable.store_runs(stored.withColumns({"spec": F.lit(_SPEC), "weights": F.expr(f"array({', '.join(flat)})")}), table)
    df = cal(spark, sf).selectExpr("idx", "flux", "fluxerr", f"array({', '.join(_NET)}) as features")
    out = runtable.score_runs(df, spark.read.parquet(table))
    out = out.withColumns({f"red_chisq_{p}": 3.0 * F.col(f"chisq_{p}") / F.col(f"n_{p}") for p in ("train", "test")})
    return rounded(out, ["train_r2_pct", "test_r2_pct", "red_chisq_train", "red_chisq_test"], 4, keep=("path", "n_train", "n_test"))


@query("split_saved", on_cal(
    "select split, count(*) as n from (select case when r <= ceil(25e-2*n) then 'test' else 'train' end as split "
    "from (select row_number() over (order by md5(idx || ':42')) as r, count(*) over () as n from cal)) "
    "group by split"))
def split_saved(spark, sf):
    path = scratch_path(spark, "split")
    tables.write_split(splits.hash_split(cal(spark, sf)), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


# --- streaming ---------------------------------------------------------------------------------------------

_STREAM_SCHEMA = T.StructType(
    [T.StructField("idx", T.LongType()), *schema.TARGET_SCHEMA.fields, T.StructField("file_key", T.StringType())]
)


FILE_ROWS = 2_000_000


def _target_files(spark, sf) -> str:
    """The target table as CSV files, one folder per file key, of about :data:`FILE_ROWS` rows or fewer.

    Every file is a micro-batch, whose cost on the driver is the same however many rows it has, so the number of files must not
    follow that of the tasks that write.
    """
    path = scratch_path(spark, "targets")
    rows = cal_targets(spark, sf).select(*[f.name for f in _STREAM_SCHEMA.fields])
    most = rows.groupBy("file_key").count().agg(F.max("count")).first()[0] or 0
    part = F.pmod(F.xxhash64("idx"), F.lit(max(1, -(-most // FILE_ROWS))))
    rows.repartition("file_key", part).write.partitionBy("file_key").option("header", True).csv(path)
    return path


@query("stream_score", on_cal(
    f"select idx, file_key, {sql_rounded(['prediction'])} from fit", MED, _NORM, *_TARGET_FIT, extra=FILE_KEY))
def stream_score(spark, sf):
    """Arriving target files scored by a frozen pipeline and appended to a table."""
    stream = scoring.stream_targets(spark, _target_files(spark, sf), schema=_STREAM_SCHEMA, max_files=4)
    out = scratch_path(spark, "scored")
    scoring.score_stream(stream, _pixel_pipeline(spark, sf), out, scratch_path(spark, "cp")).awaitTermination()
    return rounded(spark.read.parquet(out), ["prediction"], keep=("idx", "file_key"))


@query("stream_residuals", on_cal(_BY_FILE, MED, _NORM, *_TARGET_FIT, extra=FILE_KEY))
def stream_residuals(spark, sf):
    """Residual scores per file, added up over micro-batches of one file each."""
    stream = scoring.stream_targets(spark, _target_files(spark, sf), schema=_STREAM_SCHEMA, max_files=1)
    out = scratch_path(spark, "residuals")
    scoring.residual_stream(stream, _pixel_pipeline(spark, sf), out, scratch_path(spark, "cp")).awaitTermination()
    return rounded(scoring.read_residuals(spark, out), ["r2", "chisq"], 4, keep=("file_key", "n"))


# --- trees -------------------------------------------------------------------------------------------------

TREES, DEPTH = 10, 8


def model_frame(spark, sf):
    """Prepared rows with a feature vector and a fixed 75 / 25 split, stored once for all fits and scores that read them."""
    df = _normalised(cal(spark, sf))
    packed = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df)
    return materialise(spread(splits.hash_split(packed.select("idx", "flux", "fluxerr", "features"), test_size=0.25)))


def named_frame(spark, sf):
    return spread(splits.hash_split(_normalised(cal(spark, sf)).select("idx", "flux", *FEATURES), test_size=0.25))


def _report(spark, model, df, **more):
    out = metrics.fit_report(model.transform(df))
    out = rounded(out, ["train_r2_pct", "test_r2_pct"], 4, keep=("n_train", "n_test"))
    return out.withColumns({k: F.lit(v) for k, v in more.items()})


def _train(df):
    return df.where("split = 'train'")


def _approach_query(name: str):
    def run(spark, sf):
        est = forest.approach(
            name, FEATURES, numTrees=TREES, maxDepth=DEPTH, ranking_trees=TREES, ranking_depth=DEPTH
        )
        _, report = search.holdout(named_frame(spark, sf), est)
        return rounded(
            report.withColumn("approach", F.lit(name)), ["train_r2_pct", "test_r2_pct"], 4,
            keep=("approach", "n_train", "n_test"),
        )

    return run


for _name in forest.APPROACHES:
    query(f"rf_{_name.lower()}")(_approach_query(_name))


def _subset_query(subset: str):
    def run(spark, sf):
        df = model_frame(spark, sf)
        model = forest.forest(numTrees=TREES, maxDepth=DEPTH, subset=subset).fit(_train(df))
        return _report(spark, model, df, subset=subset)

    return run


for _subset in ("sqrt", "log2", "all"):
    query(f"rf_subset_{_subset}")(_subset_query(_subset))


@query("rf_bagged_half")
def rf_bagged_half(spark, sf):
    """Half of the rows and half of the features per tree, five rows per leaf."""
    df = model_frame(spark, sf)
    est = forest.forest(numTrees=TREES, maxDepth=DEPTH, subset="0.5", subsample=0.5, minInstances=5)
    return _report(spark, est.fit(_train(df)), df)


@query("rf_importances")
def rf_importances(spark, sf):
    """Importance and its spread over trees, with the features that make up 95 %."""
    df = model_frame(spark, sf)
    model = forest.forest(numTrees=TREES, maxDepth=DEPTH).fit(_train(df))
    imp = forest.importances(model, FEATURES, spark)
    path = scratch_path(spark, "importances")
    tables.write_importances(imp, path)
    return forest.select_k(tables.read_importances(spark, path))


@query("importance_ranks", on_cal(
    f"select {len(FEATURES)}::bigint as n, 1e0 as total, {sum(range(1, len(FEATURES) + 1))}::bigint as ranks, true as falling, "
    "true as smallest_k, count(*) as n_rows from cal"))
def importance_ranks(spark, sf):
    """What must hold of any importances: they add up to one, ranks are complete and fall, and k is the smallest that reaches 95 %."""
    df = model_frame(spark, sf)
    model = forest.forest(numTrees=TREES, maxDepth=DEPTH).fit(_train(df))
    top = forest.select_k(forest.importances(model, FEATURES, spark))
    steps = top.withColumn("before", F.col("cumulative") - F.col("importance"))
    out = steps.agg(
        F.count(F.lit(1)).alias("n"), rnd(F.sum("importance")).alias("total"), F.sum("rank").cast("bigint").alias("ranks"),
        (F.max_by("importance", "rank") == F.min("importance")).alias("falling"),
        F.bool_and(F.col("selected") == (F.col("before") < 0.95)).alias("smallest_k"),
    )
    return out.withColumn("n_rows", F.lit(df.count()))


@query("importances_file", on_cal(
    "select feature, case when feature = 'above' then 1e0 else 0e0 end as importance, 0e0 as std, count(*) as n_rows "
    "from cal, (select unnest(['above', 'nothing']) as feature) group by feature"))
def importances_file(spark, sf):
    """Importances written and read back: a forest on one telling and one constant feature."""
    df = cal(spark, sf).selectExpr("idx", "flux", "cast(pix5 > pix1 as double) as above", "1e0 as nothing")
    packed = VectorAssembler(inputCols=["above", "nothing"], outputCol="features").transform(df)
    model, path = forest.forest(numTrees=5, maxDepth=1).fit(packed), scratch_path(spark, "importances")
    tables.write_importances(forest.importances(model, ["above", "nothing"], spark), path)
    out = rounded(tables.read_importances(spark, path), ["importance", "std"], keep=("feature",))
    return out.withColumn("n_rows", F.lit(df.count()))


def _two_leaves(spark, sf):
    df = cal(spark, sf).selectExpr("idx", "flux", "cast(pix5 > pix1 as double) as x")
    return VectorAssembler(inputCols=["x"], outputCol="features").transform(df)


_LEAF_MEANS = on_cal(
    "select idx, " + sql_rnd("avg(flux) over (partition by pix5 > pix1)", 9) + " as prediction from cal")


_BAGS = [
    "trees as (select unnest(range(5)) as tree)",
    f"draws as (select idx, tree, flux, pix5 > pix1 as x, {draw_sql('tree', '42', 'idx')} as u from cal, trees)",
    f"bags as (select idx, tree, flux, x, {poisson1_sql('u')} as w from draws)",
    "leaves as (select idx, flux, w, sum(w * flux) over (partition by tree, x) / sum(w) over (partition by tree, x) as p from bags)",
    "forest as (select idx, any_value(flux) as flux, avg(p) as prediction, avg(p) filter (w = 0) as oob from leaves group by idx)",
]


@query("bagged_two_leaves", on_cal(
    "select idx, " + sql_rnd("prediction", 9) + " as prediction, r2 as oob_r2 from forest, (select "
    + sql_rnd("1e0 - sum((flux-oob)*(flux-oob))/(var_pop(flux)*count(*))", 7) + " as r2 from forest where oob is not null)",
    *_BAGS))
def bagged_two_leaves(spark, sf):
    """Bagged trees on a yes-or-no feature: weighted leaf means, and R2 over the trees that did not see a row."""
    df = _two_leaves(spark, sf)
    model = forest.OOBForest(numTrees=5, maxDepth=1).fit(df)
    out = rounded(model.transform(df), ["prediction"], 9)
    return out.withColumn("oob_r2", rnd(F.lit(model.oob_score_), 7))


@query("boosting_one_round", _LEAF_MEANS)
def boosting_one_round(spark, sf):
    """The first round of squared-loss boosting does the same."""
    df = _two_leaves(spark, sf)
    model = boost.fit_boosted(df, rounds=1, maxDepth=1)
    return rounded(predict_as(model, df, "prediction"), ["prediction"], 9)


@query("oob_score")
def oob_score(spark, sf):
    df = model_frame(spark, sf)
    model = forest.OOBForest().fit(_train(df))
    return _report(spark, model, df, oob_r2_pct=round(100.0 * model.oob_score_, 4))


@query("extra_trees")
def extra_trees(spark, sf):
    df = model_frame(spark, sf)
    return _report(spark, forest.ExtraTrees().fit(_train(df)), df)


_DRAWN = ["xpos", "ypos", "pix5", "bg_flux"]


def _drawn_level(k: int) -> list[str]:
    """CTEs of one level: a threshold for every node and feature, the best split of each node, and where rows go."""
    return [
        f"cut{k} as (select tree, heap, feature, min(x) + (max(x) - min(x)) * {uniform_sql('42', 'tree', 'heap', 'feature')} as cut, "
        f"count(*) as n, sum(y) as s, sum(y*y) as q from at{k} join vals using (idx) group by tree, heap, feature)",
        f"gain{k} as (select tree, heap, feature, cut, any_value(n) as n, any_value(s) as s, any_value(q) as q, "
        f"count(*) filter (x <= cut) as nl, sum(y) filter (x <= cut) as sl "
        f"from at{k} join vals using (idx) join cut{k} using (tree, heap, feature) group by tree, heap, feature, cut)",
        f"share{k} as (select tree, heap, feature, cut, round((sl*sl/nl + (s-sl)*(s-sl)/(n-nl) - s*s/n)/q, 12) as gain "
        f"from gain{k} where nl >= 1 and n - nl >= 1)",
        f"best{k} as (select * from share{k} where gain > 0 "
        "qualify row_number() over (partition by tree, heap order by gain desc, feature) = 1)",
        f"at{k + 1} as (select idx, tree, case when b.feature is null then heap when x <= cut then 2*heap else 2*heap + 1 end as heap, y "
        f"from at{k} left join best{k} b using (tree, heap) left join vals using (idx, feature))",
    ]


@query("extra_trees_two_levels", on_cal(
    f"select idx, {sql_rnd('avg(p) + any_value(mean)', 9)} as prediction from leaves, (select avg(flux) as mean from cal) group by idx",
    "vals as (" + " union all ".join(f"select idx, {i} as feature, {c} as x from cal" for i, c in enumerate(_DRAWN)) + ")",
    "at0 as (select idx, tree, 1 as heap, flux - (select avg(flux) from cal) as y from cal, (select unnest(range(3)) as tree))",
    *_drawn_level(0), *_drawn_level(1),
    "leaves as (select idx, avg(y) over (partition by tree, heap) as p from at2)"))
def extra_trees_two_levels(spark, sf):
    """Extremely randomised trees of two levels: thresholds from digests, best splits and leaf means."""
    df = VectorAssembler(inputCols=_DRAWN, outputCol="features").transform(cal(spark, sf))
    model = forest.ExtraTrees(numTrees=3, maxDepth=2).fit(df)
    return rounded(model.transform(df), ["prediction"], 9)


@query("adaboost_r2")
def adaboost_r2(spark, sf):
    df = model_frame(spark, sf)
    model = forest.AdaBoostR2(numTrees=TREES).fit(_train(df))
    return _report(spark, model, df, rounds=model.trees.getNumTrees)


@query("gbt_squared")
def gbt_squared(spark, sf):
    df = model_frame(spark, sf)
    return _report(spark, boost.fit_boosted(_train(df), rounds=TREES, stepSize=0.3), df)


@query("gbt_validation")
def gbt_validation(spark, sf):
    """Boosting that stops when the validation rows no longer improve."""
    df = model_frame(spark, sf).withColumn("is_val", F.expr("split = 'test'"))
    model = boost.fit_boosted(df, rounds=TREES, stepSize=0.3, validationCol="is_val")
    return _report(spark, model, df, trees=model.getNumTrees)


@query("gbt_quantile")
def gbt_quantile(spark, sf):
    """The share of labels under the fitted 0.9 quantile."""
    df = model_frame(spark, sf)
    model = boost.QuantileBoost(numTrees=TREES, stepSize=0.3).fit(_train(df))
    scored = model.transform(df)
    return scored.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg((F.col("flux") <= F.col("prediction")).cast("double")), 4).alias("coverage"),
    )


@query("quantile_one_round", on_cal(
    "select idx, " + sql_rnd("start + 3e-1 * quantile_cont(flux - start, 9e-1) over (partition by pix5 > pix1)", 9)
    + " as prediction from cal, (select quantile_cont(flux, 9e-1) as start from cal)"))
def quantile_one_round(spark, sf):
    """One round of quantile boosting: every leaf moves towards the exact quantile of its residuals."""
    df = _two_leaves(spark, sf)
    model = boost.QuantileBoost(numTrees=1, stepSize=0.3, maxDepth=1).fit(df)
    return rounded(model.transform(df), ["prediction"], 9)


@query("quantiles_by_file", on_cal(
    "select file_key, " + ", ".join(f"{sql_rnd(f'quantile_cont(flux, {p!r}e0)', 9)} as q{i}" for i, p in enumerate((0.05, 0.25, 0.9)))
    + " from cal group by file_key", extra=FILE_KEY))
def quantiles_by_file(spark, sf):
    """Exact quantiles of every file at once, on the path of tables too large for one buffer."""
    df, out = cal_targets(spark, sf).select("file_key", "flux"), None
    for i, p in enumerate((0.05, 0.25, 0.9)):
        found = median.exact_quantile(df, "flux", p, "file_key", f"q{i}", small=1_000)
        out = found if out is None else out.join(found, "file_key")
    return rounded(out, ["q0", "q1", "q2"], 9, keep=("file_key",))


@query("resume_forest")
def resume_forest(spark, sf):
    df = model_frame(spark, sf)
    est = forest.forest(numTrees=TREES // 2, maxDepth=DEPTH)
    model = forest.resume_forest(est.fit(_train(df)), est, _train(df), TREES // 2)
    return _report(spark, model, df)


@query("resume_boosting")
def resume_boosting(spark, sf):
    """Five rounds, then five more: the training error may not rise."""
    df = model_frame(spark, sf)
    first = boost.fit_boosted(_train(df), rounds=TREES // 2, stepSize=0.3)
    more = boost.resume_boosted(first, _train(df), TREES // 2, stepSize=0.3)
    both = predict_as(more, predict_as(first, df, "p_first"), "p_more")
    return both.groupBy("split").agg(
        F.round(100.0 * metrics.r2_expr("flux", "p_first"), 4).alias("r2_first_pct"),
        F.round(100.0 * metrics.r2_expr("flux", "p_more"), 4).alias("r2_more_pct"),
    )


@query("per_draw_ensemble")
def per_draw_ensemble(spark, sf):
    """One forest per Monte-Carlo draw, predictions averaged."""
    df = named_frame(spark, sf)
    errors = cal(spark, sf).select("idx", "xerr", "yerr")
    drawn = fe.resample(
        _train(df).join(errors, "idx"), {"xpos": "xerr", "ypos": "yerr"}, n=2
    )
    model = forest.per_draw(drawn, forest.approach("STD", FEATURES, numTrees=TREES // 2, maxDepth=DEPTH))
    return _report(spark, model, df, draws=len(model.members))


@query("save_load_ensemble", on_cal("select count(*) as n, 0e0 as max_change from cal"))
def save_load_ensemble(spark, sf):
    """A custom ensemble predicts the same after a round trip through storage."""
    df = model_frame(spark, sf)
    model = forest.AdaBoostR2(numTrees=3).fit(_train(df))
    path = scratch_path(spark, "ensemble")
    models.save(model, path)
    both = predict_as(models.load(path, spark), predict_as(model, df, "before"), "after")
    return both.agg(
        F.count("after").alias("n"), F.max(F.abs(F.col("before") - F.col("after"))).alias("max_change")
    )


# --- networks ----------------------------------------------------------------------------------------------


def _scaled_frame(spark, sf):
    df = model_frame(spark, sf)
    fitted = scale.RangeScaler(inputCol="features", outputCol="x").fit(_train(df))
    return fitted.transform(df)


def _net_report(spark, model, df):
    path = scratch_path(spark, "history")
    tables.write_history(model.history(spark), path)
    return tables.read_history(spark, path)


_STEP = {"kind": "dense", "n_in": 1, "hidden": [1], "activation": "tanh", "dropout": 0.0, "batch_norm": False, "l1": 0.0,
         "l2": 0.0, "loss": "mse"}


def _one_step_sql(lr: float, select: str | None = None) -> str:
    """A one-unit network after one full-gradient Adam step, whose first move is ``lr * g / (|g| + eps)``, as SQL."""
    start = {k: float(b.ravel()[0]) for k, b in kernels.unpack(_STEP, kernels.initial(_STEP, 42)).items()}
    w0, b0, w1, b1 = (f"({start[k]!r}e0)" for k in ("w0", "b0", "w1", "b1"))
    moved = {
        k: f"({v} - {lr!r}e0 * {g} / (abs({g}) + 1e-8))" for k, v, g in
        (("w0", w0, "gw0"), ("b0", b0, "gb0"), ("w1", w1, "gw1"), ("b1", b1, "gb1"))
    }
    after = f"{moved['w1']} * tanh({moved['w0']} * x + {moved['b0']}) + {moved['b1']}"
    return on_cal(
        select.format(after=after) if select else "select idx, " + sql_rnd(f"{moved['w1']} * tanh({moved['w0']} * x + {moved['b0']}) + {moved['b1']}", 6)
        + " as prediction from rows1, g",
        "rows1 as (select idx, xpos - 145e-1 as x, flux as y from cal)",
        f"f as (select x, tanh({w0} * x + {b0}) as a, {w1} * tanh({w0} * x + {b0}) + {b1} - y as d from rows1)",
        f"g as (select avg(d * {w1} * (1e0 - a * a) * x) as gw0, avg(d * {w1} * (1e0 - a * a)) as gb0, avg(d * a) as gw1, "
        "avg(d) as gb1 from f)",
    )


@query("network_sync_step", _one_step_sql(0.05))
def network_sync_step(spark, sf):
    """One full-gradient step of a small network from fixed weights."""
    df = cal(spark, sf).selectExpr("idx", "flux", "array(xpos - 145e-1) as features")
    est = neural.DenseRegressor(hidden=[1], activation="tanh", dropout=0.0, epochs=1, lr=0.05, mode="sync", seed=42)
    return rounded(est.fit(df).transform(df), ["prediction"], 6)


@query("history_file", _one_step_sql(
    0.05, "select 0 as epoch, n as n_rows, " + sql_rounded({
        "loss": "5e-1 * sse", "r2_train": "1e0 - sse / (v * n)", "chisq_train": "sse",
    }, 4) + " from (select count(*) as n, sum((y - ({after})) * (y - ({after}))) as sse, var_pop(y) as v from rows1, g)"))
def history_file(spark, sf):
    """The epoch history of one full-gradient step, written as CSV and read back."""
    df = cal(spark, sf).selectExpr("idx", "flux", "array(xpos - 145e-1) as features")
    est = neural.DenseRegressor(hidden=[1], activation="tanh", dropout=0.0, epochs=1, lr=0.05, mode="sync", seed=42)
    out = rounded(_net_report(spark, est.fit(df), df), ["loss", "r2_train", "chisq_train"], 4, keep=("epoch",))
    return out.withColumn("n_rows", F.lit(df.count()))


@query("nalu_fit")
def nalu_fit(spark, sf):
    """Epoch history of a one-layer arithmetic network."""
    df = _scaled_frame(spark, sf)
    est = neural.NALURegressor(
        featuresCol="x", errCol="fluxerr", splitCol="split", epochs=10, lr=0.01, neurons=16, keepBest=True
    )
    return _net_report(spark, est.fit(df), df)


@query("dense_fit")
def dense_fit(spark, sf):
    """Epoch history of a three-layer network on standardised labels."""
    df = _scaled_frame(spark, sf)
    labels = scale.LabelScaler(outputCol="label").fit(_train(df))
    est = neural.DenseRegressor(
        hidden=[10, 5, 10], activation="tanh", dropout=0.0, featuresCol="x", labelCol="label", splitCol="split",
        epochs=6, lr=0.01,
    )
    return _net_report(spark, est.fit(labels.transform(df)), df)


@query("dense_chisq_fit")
def dense_chisq_fit(spark, sf):
    """Batch normalisation, dropout, L1 and L2 penalties, chi-square loss."""
    df = _scaled_frame(spark, sf)
    est = neural.DenseRegressor(
        activation="elu", dropout=0.5, batchNorm=True, l1=1e-3, l2=1e-4, loss="chisq", errCol="fluxerr",
        featuresCol="x", splitCol="split", epochs=4, batch=50,
    )
    return _net_report(spark, est.fit(df), df)


@query("network_resume")
def network_resume(spark, sf):
    """Three epochs, then three more from the trained weights."""
    df = _scaled_frame(spark, sf)
    est = neural.NALURegressor(featuresCol="x", splitCol="split", epochs=3, lr=0.01, neurons=16)
    lanes = est.lanes(df)
    first = est.fit(lanes)
    more = est.resume(first, lanes)
    lanes.unpersist()
    both = first.history(spark).withColumn("run", F.lit("first")).union(
        more.history(spark).withColumn("run", F.lit("resumed"))
    )
    return both


@query("network_resume_exact", on_cal("select count(*) as n, 4 as epochs, 0e0 as max_change from cal"))
def network_resume_exact(spark, sf):
    """Two epochs, stored, loaded and resumed for two more: the same network as after four."""
    df = _scaled_frame(spark, sf)
    args = dict(featuresCol="x", splitCol="split", lr=0.01, hidden=[8], dropout=0.2)
    path = scratch_path(spark, "network")
    lanes = neural.DenseRegressor(**args).lanes(df)
    models.save(neural.DenseRegressor(epochs=2, **args).fit(lanes), path)
    resumed = neural.DenseRegressor(epochs=2, **args).resume(models.load(path, spark), lanes)
    whole = neural.DenseRegressor(epochs=4, **args).fit(lanes)
    lanes.unpersist()
    both = predict_as(resumed, predict_as(whole, df, "a"), "b")
    out = both.agg(F.count("b").alias("n"), rnd(F.max(F.abs(F.col("a") - F.col("b")))).alias("max_change"))
    return out.withColumn("epochs", F.lit(resumed.state()[0]))


@query("network_approaches")
def network_approaches(spark, sf):
    """Every activation on the same split, one report row each."""
    df = _scaled_frame(spark, sf)
    labels = scale.LabelScaler(outputCol="label").fit(_train(df))
    data = labels.transform(df)
    out = lanes = None
    for act in ("elu", "leaky_relu", "selu", "relu", "sigmoid", "tanh"):
        est = neural.DenseRegressor(
            hidden=[10, 5, 10], activation=act, dropout=0.0, featuresCol="x", labelCol="label", epochs=2, lr=0.01
        )
        lanes = lanes or est.lanes(_train(data))
        row = metrics.fit_report(est.fit(lanes).transform(data), "label").select(F.lit(act).alias("activation"), "*")
        out = row if out is None else out.union(row)
    lanes.unpersist()
    return out


# --- search ------------------------------------------------------------------------------------------------


@query("random_search")
def random_search(spark, sf):
    """Random settings from a small boosting grid on three folds."""
    df = model_frame(spark, sf)
    space = search.grid(maxDepth=[2, 3], maxIter=[3, 5], stepSize=[0.1, 0.5])
    results = search.random_search(df, boost.boosted(), space, n=2, k=3)
    return results.drop("seconds")


_FOLDS = 3


@query("search_space", on_cal(
    "select s.depth as maxDepth, o.held as fold, " + sql_rounded({
        "r2": "1e0 - sum((flux-p)*(flux-p)) / (var_pop(flux)*count(*))", "neg_rmse": "-sqrt(avg((flux-p)*(flux-p)))",
    }) + " from outs o join settings s on s.depth = o.depth where fold = held group by all",
    "settings as (select unnest([1, 2]) as depth)",
    "held as (select unnest(range(3)) as held)",
    f"parts as (select flux, pix5 > pix1 as x, cast('0x' || substr(md5(idx || ':42'), 1, 15) as bigint) % {_FOLDS} as fold from cal)",
    "outs as (select depth, held, fold, flux, avg(flux) filter (fold <> held) over (partition by depth, held, x) as p "
    "from parts, held, settings)"))
def search_space(spark, sf):
    """Every setting of a grid, scored on every fold: on one yes-or-no feature more depth changes nothing."""
    df = _two_leaves(spark, sf)
    space = search.grid(maxDepth=[1, 2], maxIter=[1])
    found = search.random_search(df, boost.boosted(), space, n=len(space), k=_FOLDS)
    kept = found.select(F.col("maxDepth").cast("int").alias("maxDepth"), F.col("fold").cast("bigint").alias("fold"), "r2", "neg_rmse")
    return rounded(kept, ["r2", "neg_rmse"], keep=("maxDepth", "fold"))


@query("compare_approaches")
def compare_approaches(spark, sf):
    df = _normalised(cal(spark, sf)).select("idx", "flux", *FEATURES)
    gbr = forest.approach("STD", FEATURES, boost.boosted(rounds=5, stepSize=0.3))
    return search.compare_approaches(
        df, FEATURES, ("STD", "PCA", "RFI"), extra={"GBR": gbr}, numTrees=5, maxDepth=6, ranking_trees=5,
        ranking_depth=6,
    )
