"""Catalogue: sources, projections, filters and column engineering (S-1 .. S-9, F-1 .. F-21)."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from lumenfit import schema
from lumenfit.functions.hashing import normal_sql
from lumenfit.operators import features as fe
from lumenfit.plans.cal import FEATURES, FILE_KEY, PRED, cal, cal_pred, cal_targets

from lumenfit.plans.registry import on_cal, query, rnd, rounded, sql_rnd, sql_rounded
from lumenfit.schema import FLUX_SCALED, PIXELS
from lumenfit.session import scratch_path
from lumenfit.sources import tables

PIX_SUM = "(" + "+".join(PIXELS) + ")"
MED = "med as (select median(flux) as m from cal)"


@query("raw_profile", on_cal(
    "select count(*) as n, " + sql_rounded({
        "mean_flux": "avg(flux)", "median_flux": "median(flux)", "std_flux": "stddev_pop(flux)",
        "mean_bmjd": "avg(bmjd)", "min_np": "min(np)", "max_np": "max(np)", "mean_pix5": "avg(pix5)",
    }) + " from cal"))
def raw_profile(spark, sf):
    return cal(spark, sf).agg(
        F.count(F.lit(1)).alias("n"),
        rnd(F.avg("flux")).alias("mean_flux"),
        rnd(F.percentile("flux", F.lit(0.5))).alias("median_flux"),
        rnd(F.stddev_pop("flux")).alias("std_flux"),
        rnd(F.avg("bmjd")).alias("mean_bmjd"),
        rnd(F.min("np")).alias("min_np"),
        rnd(F.max("np")).alias("max_np"),
        rnd(F.avg("pix5")).alias("mean_pix5"),
    )


@query("csv_roundtrip", on_cal(
    "select count(*) as n, " + sql_rounded({"sum_flux": "sum(flux)", "sum_pix9": "sum(pix9)"}, 4)
    + ", cast(sum(idx) as bigint) as sum_position from cal"))
def csv_roundtrip(spark, sf):
    path = scratch_path(spark, "csv")
    cal(spark, sf).select(*schema.RAW_COLUMNS).write.option("header", True).csv(path)
    back = tables.read_calibration(spark, path, "csv", file_order=True)
    return back.agg(
        F.count(F.lit(1)).alias("n"),
        rnd(F.sum("flux"), 4).alias("sum_flux"),
        rnd(F.sum("pix9"), 4).alias("sum_pix9"),
        F.sum("idx").alias("sum_position"),
    )


@query("labels_load", on_cal(
    f"select idx, {sql_rounded({'Flux': 'flux/m', 'Flux_err': 'fluxerr/m'}, 9)} from cal, med", MED))
def labels_load(spark, sf):
    path = scratch_path(spark, "labels")
    tables.write_labels(fe.median_normalize(cal(spark, sf)), path)
    return rounded(tables.load_labels(spark, path), ["Flux", "Flux_err"], 9)


@query("predictions_select", on_cal(
    f"select {sql_rounded({'bmjd': 'bmjd', 'flux': 'flux', 'fluxerr': 'fluxerr', 'RF_Predict': PRED})}"
    " from cal"))
def predictions_select(spark, sf):
    out = tables.prediction_table(cal_pred(spark, sf))
    return rounded(out, out.columns, keep=())


@query("predictions_write", on_cal(
    f"select idx, {sql_rounded({'prediction': PRED}, 9)} from cal"))
def predictions_write(spark, sf):
    path = scratch_path(spark, "bare")
    tables.write_bare_predictions(cal_pred(spark, sf), path)
    back = spark.read.option("header", True).schema("idx bigint, prediction double").csv(path)
    return rounded(back, ["prediction"], 9)


@query("pixel_columns", on_cal(
    "select idx, " + sql_rounded({"pixel_sum": PIX_SUM}, 9) + f", {len(PIXELS)} as n_pixels from cal"))
def pixel_columns(spark, sf):
    df = fe.pixel_errors(cal(spark, sf))
    cols = schema.pixel_cols(df)
    total = rnd(sum((F.col(c) for c in cols[1:]), F.col(cols[0])), 9)
    return df.select("idx", total.alias("pixel_sum"), F.lit(len(cols)).alias("n_pixels"))


@query("role_split", on_cal(
    "select idx, " + sql_rounded({
        "input_sum": "+".join(c for c in schema.RAW_COLUMNS if "err" not in c),
        "error_sum": "+".join(c for c in schema.RAW_COLUMNS if "err" in c),
    }) + " from cal"))
def role_split(spark, sf):
    df = cal(spark, sf)
    inputs, errors = schema.split_roles(df.drop("idx"))
    return df.select(
        "idx",
        rnd(sum((F.col(c) for c in inputs[1:]), F.col(inputs[0]))).alias("input_sum"),
        rnd(sum((F.col(c) for c in errors[1:]), F.col(errors[0]))).alias("error_sum"),
    )


@query("pld_normalize", on_cal(
    f"select idx, {sql_rounded({p: f'{p}/{PIX_SUM}' for p in PIXELS}, 9)} from cal"))
def pld_normalize(spark, sf):
    return rounded(fe.pld_normalize(cal(spark, sf)), PIXELS, 9)


@query("pld_check", on_cal(
    "select " + sql_rnd("max(abs(s - 1e0))", 9) + " as max_deviation, max(abs(s - 1e0)) <= 1e-9 as normalised "
    "from n", f"n as (select {'+'.join(f'{p}/{PIX_SUM}' for p in PIXELS)} as s from cal)"))
def pld_check(spark, sf):
    out = fe.check_pld(fe.pld_normalize(cal(spark, sf)))
    return out.select(rnd("max_deviation", 9).alias("max_deviation"), "normalised")


@query("flux_median_norm", on_cal(
    f"select idx, {sql_rounded({c: f'{c}/m' for c in FLUX_SCALED}, 9)} from cal, med", MED))
def flux_median_norm(spark, sf):
    return rounded(fe.median_normalize(cal(spark, sf)), FLUX_SCALED, 9)


@query("flux_median_norm_by_group", on_cal(
    f"select idx, cal.file_key, {sql_rounded({c: f'{c}/m' for c in FLUX_SCALED}, 9)} "
    "from cal join g on cal.file_key = g.file_key",
    "g as (select file_key, median(flux) as m from cal group by file_key)", extra=FILE_KEY))
def flux_median_norm_by_group(spark, sf):
    out = fe.median_normalize(cal_targets(spark, sf), partition_by="file_key")
    return rounded(out, FLUX_SCALED, 9, keep=("idx", "file_key"))


@query("time_step_error", on_cal(
    "select " + sql_rnd("median(5e-1*d)", 9) + " as bmjd_err, count(*) + 1 as n from d where d is not null",
    "d as (select bmjd - lag(bmjd) over (order by idx) as d from cal)"))
def time_step_error(spark, sf):
    out = fe.half_cadence(cal(spark, sf))
    return out.groupBy(rnd("bmjd_err", 9).alias("bmjd_err")).agg(F.count(F.lit(1)).alias("n"))


@query("np_error", on_cal(f"select idx, {sql_rounded({'np_err': 'sqrt(yerr)'}, 9)} from cal"))
def np_error(spark, sf):
    return rounded(fe.noise_pixel_error(cal(spark, sf)), ["np_err"], 9)


@query("pixel_errors", on_cal(
    f"select idx, {sql_rounded({f'{p}_err': f'{p}*fluxerr' for p in PIXELS}, 9)} from cal"))
def pixel_errors(spark, sf):
    return rounded(fe.pixel_errors(cal(spark, sf)), [f"{p}_err" for p in PIXELS], 9)


@query("freq_ramp", on_cal(
    "select idx, " + sql_rnd(
        "lo + (row_number() over (order by idx) - 1) * ((hi - lo) / (n - 1))", 3) + " as freq from cal, e",
    "d as (select bmjd, bmjd - lag(bmjd) over (order by idx) as d from cal)",
    "e as (select pi()/(max(bmjd)-min(bmjd)) as lo, 4*pi()/min(d) as hi, count(*) as n from d)"))
def freq_ramp(spark, sf):
    return rounded(fe.freq_ramp(cal(spark, sf)), ["freq"], 3)


@query("feature_preset_15", on_cal(
    f"select idx, {sql_rounded([c for c in FEATURES if c != 'bmjd'], 9)} from cal"))
def feature_preset_15(spark, sf):
    out = fe.select_features(cal(spark, sf), "features15")
    return rounded(out, out.columns[1:], 9)


@query("feature_preset_16", on_cal(f"select idx, {sql_rounded(FEATURES)} from cal"))
def feature_preset_16(spark, sf):
    out = fe.select_features(cal(spark, sf), "features16")
    return rounded(out, out.columns[1:])


_DROP5 = sorted(set(schema.RAW_COLUMNS) - set(schema.DROP_SETS["drop5"]))


@query("feature_preset_drop5", on_cal(f"select idx, {sql_rounded(_DROP5)} from cal"))
def feature_preset_drop5(spark, sf):
    out = fe.select_features(cal(spark, sf), "drop5")
    return rounded(out, out.columns[1:])


_KEPT = [c for c in schema.RAW_COLUMNS if c not in schema.DROP_SETS["drop9"]]


@query("drop_features", on_cal(f"select idx, {sql_rounded(_KEPT, 9)} from cal"))
def drop_features(spark, sf):
    out = fe.drop_features(cal(spark, sf), [*schema.DROP_SETS["drop9"], "absent"])
    return rounded(out, [c for c in out.columns if c != "idx"], 9)


@query("stride_sample", on_cal(
    f"select idx, {sql_rounded(['flux'], 9)} from cal where idx % 20 = 0"))
def stride_sample(spark, sf):
    return rounded(fe.stride(cal(spark, sf), 20), ["flux"], 9)


DIRTY = {"flux": "case when idx % 997 = 0 then flux + 1e0 else flux end"}
_DIRTY = f"dirty as (select * replace ({DIRTY['flux']} as flux) from cal)"


def _clip_round(source: str, number: int) -> list[str]:
    """One clipping round as CTEs; bounds come from the rows kept so far."""
    return [
        f"s{number} as (select avg(flux) as fm, stddev_pop(flux) as fs, avg(xpos) as xm, "
        f"stddev_pop(xpos) as xs from {source})",
        f"k{number} as (select k.* from {source} k, s{number} where flux between fm-4*fs and fm+4*fs "
        "and xpos between xm-4*xs and xm+4*xs)",
    ]


@query("sigma_clip_4", on_cal(
    f"select idx, {sql_rounded(['flux'], 9)} from k1", _DIRTY, *_clip_round("dirty", 1)))
def sigma_clip_4(spark, sf):
    dirty = cal(spark, sf).withColumn("flux", F.expr(DIRTY["flux"]))
    return rounded(fe.sigma_clip(dirty, ["flux", "xpos"], 4.0, iters=1), ["flux"], 9)


@query("sigma_clip_rounds", on_cal(
    f"select idx, {sql_rounded(['flux'], 9)} from k8", _DIRTY,
    *_clip_round("dirty", 1), *[c for i in range(2, 9) for c in _clip_round(f"k{i - 1}", i)]))
def sigma_clip_rounds(spark, sf):
    dirty = cal(spark, sf).withColumn("flux", F.expr(DIRTY["flux"]))
    return rounded(fe.sigma_clip(dirty, ["flux", "xpos"], 4.0), ["flux"], 9)


@query("sigma_clip_robust", on_cal(
    f"select idx, {sql_rounded(['flux'], 9)} from dirty, mid, off where flux between fm - 4e0*14826e-4*fw and fm + 4e0*14826e-4*fw "
    "and xpos between xm - 4e0*14826e-4*xw and xm + 4e0*14826e-4*xw",
    _DIRTY, "mid as (select median(flux) as fm, median(xpos) as xm from dirty)",
    "off as (select median(abs(flux - fm)) as fw, median(abs(xpos - xm)) as xw from dirty, mid)"))
def sigma_clip_robust(spark, sf):
    """One round about the median, in median absolute deviations."""
    dirty = cal(spark, sf).withColumn("flux", F.expr(DIRTY["flux"]))
    return rounded(fe.sigma_clip(dirty, ["flux", "xpos"], 4.0, iters=1, robust=True), ["flux"], 9)


def _preset_sql(name: str) -> str:
    """How many rows and features a preset has, and what they add up to: all raw columns less those that are dropped."""
    gone = schema.DROP_SETS[name]
    total = "+".join(c for c in schema.RAW_COLUMNS if c not in gone) + (" + freq" if name.endswith("freq") else "")
    width = len(schema.RAW_COLUMNS) - len(gone) + name.endswith("freq")
    return f"select '{name}' as preset, {width} as width, count(*) as n, {sql_rnd(f'avg({total})', 4)} as mean from ramp"


@query("feature_presets", on_cal(
    " union all ".join([_preset_sql(name) for name in schema.DROP_SETS] + [
        f"select 'non_err' as preset, {sum('err' not in c for c in schema.RAW_COLUMNS)} as width, count(*) as n, "
        + sql_rnd("avg(" + "+".join(c for c in schema.RAW_COLUMNS if "err" not in c and c != "flux") + " + freq)", 4) + " as mean from ramp"]),
    "ramp as (select *, 2e0*idx as freq from cal)"))
def feature_presets(spark, sf):
    """The features of every preset that drops columns, from a table that has a ramp beside the raw ones."""
    df, out = cal(spark, sf).withColumn("freq", F.expr("2e0*idx")), None
    for name in [*schema.DROP_SETS, "non_err"]:
        names = schema.feature_preset(df, name)
        row = df.agg(
            F.lit(name).alias("preset"), F.lit(len(names)).alias("width"), F.count(F.lit(1)).alias("n"),
            rnd(F.avg(sum(F.col(c) for c in names)), 4).alias("mean"),
        )
        out = row if out is None else out.unionByName(row)
    return out


@query("label_or_ones", on_cal(
    f"select idx, {sql_rounded({'label': 'flux'}, 9)}, 1e0 as missing from cal"))
def label_or_ones(spark, sf):
    df = fe.label_or_ones(cal(spark, sf))
    df = fe.label_or_ones(df.drop("flux"), "flux", "missing")
    return df.select("idx", rnd("label", 9).alias("label"), "missing")


@query("nudge_integers", on_cal(
    f"select idx, {sql_rnd('case when floor(x) = x then x + 1e-6 else x end', 9)} as label from "
    "(select idx, idx % 5 + 5e-1*(idx % 2) as x from cal)"))
def nudge_integers(spark, sf):
    df = cal(spark, sf).withColumn("label", F.expr("idx % 5 + 5e-1*(idx % 2)"))
    return rounded(fe.nudge_integers(df, "label"), ["label"], 9)


NAN_PRED = "case when idx % 101 = 0 then cast('NaN' as double) else flux end"


@query("nan_median_fill", on_cal(
    "select idx, " + sql_rnd("case when isnan(p) then m else p end", 9) + " as prediction from q, "
    "(select median(p) as m from q where not isnan(p))", f"q as (select idx, {NAN_PRED} as p from cal)"))
def nan_median_fill(spark, sf):
    df = cal(spark, sf).withColumn("prediction", F.expr(NAN_PRED))
    return rounded(fe.fill_nan_median(df), ["prediction"], 9)


@query("matrix_roundtrip", on_cal(f"select idx, {sql_rounded([*FEATURES, 'flux'])} from cal"))
def matrix_roundtrip(spark, sf):
    packed = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(cal(spark, sf))
    out = fe.unpack_features(packed.select("idx", "features", "flux"), FEATURES, extra=("idx", "flux"))
    return rounded(out, [*FEATURES, "flux"])


_DRAWN = {"flux": "fluxerr", "xpos": "xerr", "bg_flux": "sigma_bg_flux", "pix5": "pix5*fluxerr", "np": "sqrt(yerr)"}


@query("resample", on_cal(
    "select idx, draw, " + sql_rounded({
        c: f"{c} + {s} * {normal_sql('42', 'idx', 'draw', repr(c))}" for c, s in _DRAWN.items()
    }) + " from cal, (select unnest(range(3)) as draw)"))
def resample(spark, sf):
    """Three draws of each row within its errors; every draw is a digest that SQL repeats."""
    drawn = fe.resample(fe.noise_pixel_error(cal(spark, sf)), n=3, pixels=PIXELS)
    return rounded(drawn.withColumn("draw", F.col("draw").cast("bigint")), list(_DRAWN), keep=("idx", "draw"))


@query("float32_cast", on_cal(
    "select idx, cast(cast(flux as float) as double) as flux, cast(cast(xpos as float) as double) as xpos "
    "from cal"))
def float32_cast(spark, sf):
    out = fe.to_float32(cal(spark, sf), ["flux", "xpos"])
    return out.select("idx", F.col("flux").cast("double"), F.col("xpos").cast("double"))


@query("prep_pipeline", on_cal(
    "select idx, " + sql_rounded({
        "flux": "flux/m", "fluxerr": "fluxerr/m", "bmjd_err": "h", "np_err": "sqrt(yerr)",
        "pix1": f"pix1/{PIX_SUM}", "pix9_err": "pix9*(fluxerr/m)",
    }, 9) + " from cal, med, step", MED,
    "d as (select bmjd - lag(bmjd) over (order by idx) as d from cal)",
    "step as (select median(5e-1*d) as h from d where d is not null)"))
def prep_pipeline(spark, sf):
    df = cal(spark, sf)
    out = fe.CalibrationPrep().fit(df).transform(df)
    return rounded(out, ["flux", "fluxerr", "bmjd_err", "np_err", "pix1", "pix9_err"], 9)
