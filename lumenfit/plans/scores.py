"""Catalogue: scores, residual analysis, scalar functions (E-1 .. E-21, R-20)."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lumenfit.functions import networks
from lumenfit.functions.activations import ACTIVATIONS, LEAKY_SLOPE, SELU_ALPHA, SELU_SCALE
from lumenfit.operators import median, metrics, neural, splits
from lumenfit.plans.cal import FILE_KEY, PRED, cal, cal_pred
from lumenfit.plans.registry import on_cal, query, rnd, rounded, sql_rnd, sql_rounded

P = f"p as (select *, {PRED} as prediction from cal)"
SSE, SST = "sum((flux-prediction)*(flux-prediction))", "(var_pop(flux)*count(*))"
R2 = f"1e0 - {SSE}/{SST}"
SPLIT = ("sp as (select *, case when r <= ceil(6e-1*n) then 'train' when r <= ceil(6e-1*n) + "
         "ceil(5e-1*(n-ceil(6e-1*n))) then 'test' else 'val' end as split from (select *, row_number() over "
         "(order by md5(idx || ':42')) as r, count(*) over () as n from p))")


def _one(sql_cols: dict[str, str], digits: int = 6) -> str:
    return on_cal(f"select {sql_rounded(sql_cols, digits)} from p", P)


def _grouped(sql_cols: dict[str, str], digits: int = 6) -> str:
    return on_cal(f"select file_key, {sql_rounded(sql_cols, digits)} from p group by file_key", P, extra=FILE_KEY)


def _tidy(df, digits=6, keep=()):
    return rounded(df, [c for c in df.columns if c not in keep], digits, keep)


@query("r2", _one({"r2": R2, "r2_pct": f"100e0*({R2})"}))
def r2(spark, sf):
    return _tidy(metrics.r2(cal_pred(spark, sf)))


@query("rmse", _one({"rmse": "sqrt(avg((flux-prediction)*(flux-prediction)))"}, 9))
def rmse(spark, sf):
    return _tidy(metrics.rmse(cal_pred(spark, sf)), 9)


@query("mse", _one({"mse": "avg((flux-prediction)*(flux-prediction))"}, 12))
def mse(spark, sf):
    return _tidy(metrics.mse(cal_pred(spark, sf)), 12)


@query("l2_loss", _one({"l2_loss": f"5e-1*{SSE}"}, 8))
def l2_loss(spark, sf):
    return _tidy(metrics.l2_loss(cal_pred(spark, sf)), 8)


@query("abs_loss", _one({"abs_loss": "sum(abs(flux-prediction))"}))
def abs_loss(spark, sf):
    return _tidy(metrics.abs_loss(cal_pred(spark, sf)))


CHI = "((flux-prediction)/fluxerr)*((flux-prediction)/fluxerr)"


@query("chisq", _one({"chisq": f"sum({CHI})"}, 5))
def chisq(spark, sf):
    return _tidy(metrics.chisq(cal_pred(spark, sf)), 5)


@query("reduced_chisq", _one({"reduced_chisq": f"sum(3e0*{CHI})/count(*)"}))
def reduced_chisq(spark, sf):
    return _tidy(metrics.reduced_chisq(cal_pred(spark, sf)))


@query("reduced_chisq_median", on_cal(
    "select " + sql_rnd("sum((flux-prediction)*(flux-prediction)/((m/5e0)*(m/5e0)))/count(*)")
    + " as reduced_chisq from p, (select median(fluxerr) as m from p)", P))
def reduced_chisq_median(spark, sf):
    return _tidy(metrics.reduced_chisq(cal_pred(spark, sf), err_scale="median25"))


@query("rho2", on_cal(
    "select " + sql_rnd(f"1e0 - sum({CHI})/sum(((flux-m)/fluxerr)*((flux-m)/fluxerr))")
    + " as rho2 from p, (select avg(flux) as m from p)", P))
def rho2(spark, sf):
    return _tidy(metrics.rho2(cal_pred(spark, sf)))


@query("rho2_by_group", on_cal(
    "select p.file_key, " + sql_rnd(f"1e0 - sum({CHI})/sum(((flux-m)/fluxerr)*((flux-m)/fluxerr))")
    + " as rho2 from p join (select file_key, avg(flux) as m from p group by file_key) g "
    "on p.file_key = g.file_key group by p.file_key", P, extra=FILE_KEY))
def rho2_by_group(spark, sf):
    return _tidy(metrics.rho2(cal_pred(spark, sf, FILE_KEY), by="file_key"), keep=("file_key",))


@query("tolerance_accuracy", _one({
    "tolerance_accuracy": "avg(case when abs(flux-prediction) <= 1e-4 + 1e-4*abs(prediction) then 1e0 else 0e0 end)"}))
def tolerance_accuracy(spark, sf):
    return _tidy(metrics.tolerance_accuracy(cal_pred(spark, sf)))


@query("val_accuracy", _one({"val_accuracy": "100e0*(1e0 - avg((flux-prediction)*(flux-prediction)))"}))
def val_accuracy(spark, sf):
    return _tidy(metrics.val_accuracy(cal_pred(spark, sf)))


def _pred_split(spark, sf):
    return splits.hash_split3(cal_pred(spark, sf))


@query("loss_ratio", on_cal(
    "select " + sql_rounded({"val_loss": "v", "train_loss": "t", "loss_ratio": "v/t"}, 10) + " from ("
    "select avg(case when split='val' then (flux-prediction)*(flux-prediction) end) as v, "
    "avg(case when split='train' then (flux-prediction)*(flux-prediction) end) as t from sp)", P, SPLIT))
def loss_ratio(spark, sf):
    return _tidy(metrics.loss_ratio(_pred_split(spark, sf)), 10)


@query("fit_report", on_cal(
    "select t.n as n_train, s.n as n_test, " + sql_rounded(
        {"train_r2_pct": "100e0*t.r", "test_r2_pct": "100e0*s.r"})
    + f" from (select count(*) as n, {R2} as r from sp where split='train') t, "
    f"(select count(*) as n, {R2} as r from sp where split='test') s", P, SPLIT))
def fit_report(spark, sf):
    return _tidy(metrics.fit_report(_pred_split(spark, sf)), keep=("n_train", "n_test"))


@query("demedian", on_cal(
    "select idx, " + sql_rnd("flux - m", 9) + " as flux_demedian from cal, (select median(flux) as m from cal)"))
def demedian(spark, sf):
    return rounded(metrics.demedian(cal(spark, sf)), ["flux_demedian"], 9)


@query("robust_z", on_cal(
    "select idx, " + sql_rounded({"flux_z": "(flux-m)/s", "prediction_z": "(prediction-pm)/ps"}) + " from p, "
    "(select median(flux) as m, stddev_pop(flux) as s, median(prediction) as pm, stddev_pop(prediction) as ps "
    "from p)", P))
def robust_z(spark, sf):
    out = metrics.robust_z(metrics.robust_z(cal_pred(spark, sf)), "prediction")
    return rounded(out, ["flux_z", "prediction_z"])


@query("robust_z_by_group", on_cal(
    "select idx, " + sql_rnd("(flux-m)/s") + " as flux_z from cal join (select file_key, median(flux) as m, "
    "stddev_pop(flux) as s from cal group by file_key) g on cal.file_key = g.file_key", extra=FILE_KEY))
def robust_z_by_group(spark, sf):
    return rounded(metrics.robust_z(cal(spark, sf, FILE_KEY), by="file_key"), ["flux_z"])


@query("relative_residual", on_cal(
    "select idx, " + sql_rnd("(prediction-flux-m)/prediction", 9) + " as rel_residual from p, "
    "(select median(prediction-flux) as m from p)", P))
def relative_residual(spark, sf):
    return rounded(metrics.relative_residual(cal_pred(spark, sf)), ["rel_residual"], 9)


@query("scatter_improvement", _one({
    "scatter_raw_pct": "100e0*stddev_pop(flux)", "scatter_fit_pct": "100e0*stddev_pop(flux-prediction)"}, 3))
def scatter_improvement(spark, sf):
    return _tidy(metrics.scatter_improvement(cal_pred(spark, sf)), 3)


_W = "(15e-3/40e0)"


@query("residual_histogram", on_cal(
    f"select bin, count(*) as n, {sql_rounded({'bin_lo': f'-75e-4 + bin*{_W}', 'bin_hi': f'-75e-4 + (bin+1)*{_W}'})}"
    f" from (select cast(least(floor((x + 75e-4)/{_W}), 39) as bigint) as bin from (select v - m as x from "
    "(select flux + 1e-9 as v from cal), (select median(flux) as m from cal)) where x between -75e-4 and 75e-4) "
    "group by bin"))
def residual_histogram(spark, sf):
    """De-medianed flux in the published range; the shift keeps values off the bin edges."""
    df = metrics.demedian(cal(spark, sf))
    out = metrics.residual_histogram(df, F.expr("flux_demedian + 1e-9"), 40, -0.0075, 0.0075)
    return rounded(out, ["bin_lo", "bin_hi"], keep=("bin", "n"))


@query("error_histogram", on_cal(
    "select bin, count(*) as n, " + sql_rnd("count(*) / (w * t)", 3) + " as density from (select cast(least(floor("
    "(idx - lo) / w), b - 1) as bigint) as bin, w, t from cal, (select min(idx) as lo, max(idx) as hi, "
    "greatest(1, count(*) // 1000) as b, (max(idx) - min(idx)) / greatest(1, count(*) // 1000) as w, count(*) as t "
    "from cal)) group by bin, w, t"))
def error_histogram(spark, sf):
    """One bin per thousand rows over the whole range, as a density."""
    out = metrics.residual_histogram(cal(spark, sf), F.col("idx"), density=True)
    return out.select("bin", "n", rnd("density", 3).alias("density"))


@query("flux_summary", on_cal(
    "select " + sql_rounded({"median_flux": "median(flux)", "median_fluxerr": "median(fluxerr)"}, 9) + " from cal"))
def flux_summary(spark, sf):
    return _tidy(metrics.summary(cal(spark, sf)), 9)


@query("flux_summary_by_group", on_cal(
    "select file_key, " + sql_rounded({"median_flux": "median(flux)", "median_fluxerr": "median(fluxerr)"}, 9)
    + " from cal group by file_key", extra=FILE_KEY))
def flux_summary_by_group(spark, sf):
    return _tidy(metrics.summary(cal(spark, sf, FILE_KEY), by="file_key"), 9, keep=("file_key",))


@query("split_sizes", on_cal(
    "select split, count(*) as n, " + sql_rnd("count(*) / (select count(*) from sp)") + " as share from sp "
    "group by split", P, SPLIT))
def split_sizes(spark, sf):
    return rounded(metrics.split_sizes(_pred_split(spark, sf)), ["share"], keep=("split", "n"))


@query("position_grid", on_cal(
    "select gx, gy, count(*) as n, " + sql_rnd("avg(flux)", 9) + " as mean_flux from (select flux, "
    "cast(least(floor((xpos-x0)/((x1-x0)/20)), 19) as bigint) as gx, "
    "cast(least(floor((ypos-y0)/((y1-y0)/20)), 19) as bigint) as gy from cal, (select min(xpos) as x0, "
    "max(xpos) as x1, min(ypos) as y0, max(ypos) as y1 from cal)) group by gx, gy"))
def position_grid(spark, sf):
    out = metrics.position_grid(cal(spark, sf), 20, 20)
    return rounded(out, ["mean_flux"], 9, keep=("gx", "gy", "n"))


@query("position_scatter", on_cal(f"select idx, {sql_rounded(['xpos', 'ypos', 'flux'], 9)} from cal"))
def position_scatter(spark, sf):
    return rounded(metrics.position_scatter(cal(spark, sf)), ["xpos", "ypos", "flux"], 9)


@query("exact_median", on_cal("select " + sql_rnd("median(flux)", 9) + " as median from cal"))
def exact_median(spark, sf):
    """The bracketing method, forced by a small direct-sort limit."""
    return _tidy(median.exact_median(cal(spark, sf), "flux", small=2000), 9)


@query("exact_median_by_group", on_cal(
    "select file_key, " + sql_rnd("median(flux)", 9) + " as median from cal group by file_key", extra=FILE_KEY))
def exact_median_by_group(spark, sf):
    out = median.exact_median(cal(spark, sf, FILE_KEY), "flux", "file_key", small=500)
    return _tidy(out, 9, keep=("file_key",))


@query("exact_median_events", "select event_type, median(value) as median from events group by event_type")
def exact_median_events(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    return median.exact_median(events, "value", "event_type", small=500)


@query("median_lineitem", "select l_returnflag, median(l_extendedprice) as median from lineitem "
       "group by l_returnflag")
def median_lineitem(spark, sf):
    """A third of all rows or more share one of three keys."""
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    return median.exact_median(df, "l_extendedprice", "l_returnflag", small=5000)


@query("metrics_by_group", _grouped({
    "r2": R2, "rmse": "sqrt(avg((flux-prediction)*(flux-prediction)))", "chisq": f"sum({CHI})"}))
def metrics_by_group(spark, sf):
    from lumenfit.operators.common import join_on

    df = cal_pred(spark, sf, FILE_KEY)
    out = metrics.r2(df, by="file_key").drop("r2_pct")
    out = join_on(out, metrics.rmse(df, by="file_key"), ["file_key"])
    return _tidy(join_on(out, metrics.chisq(df, by="file_key"), ["file_key"]), keep=("file_key",))


# --- activations and fixed-weight networks -----------------------------------------------------------------

_ACT_SQL = {
    "relu": "greatest(x, 0e0)",
    "leaky_relu": f"case when x >= 0 then x else {LEAKY_SLOPE!r}::double * x end",
    "elu": "case when x >= 0 then x else exp(x) - 1 end",
    "selu": f"{SELU_SCALE!r}::double * case when x >= 0 then x else {SELU_ALPHA!r}::double * (exp(x) - 1) end",
    "sigmoid": "1e0 / (1e0 + exp(-x))",
    "tanh": "tanh(x)",
    "identity": "x",
}
_X = "x as (select idx, (xpos - 145e-1) * 4e0 as x from cal)"


@query("activations", on_cal(f"select idx, {sql_rounded(_ACT_SQL)} from x", _X))
def activations(spark, sf):
    x = cal(spark, sf).selectExpr("idx", "(xpos - 145e-1) * 4e0 as x")
    return x.select("idx", *[rnd(fn(F.col("x"))).alias(n) for n, fn in ACTIVATIONS.items()])


@query("activations_sql", on_cal(
    f"select idx, {sql_rounded({k: v for k, v in _ACT_SQL.items() if k not in ('tanh', 'identity')})} from x", _X))
def activations_sql(spark, sf):
    """The same functions called from SQL text."""
    neural.register_sql(spark)
    x = cal(spark, sf).selectExpr("idx", "(xpos - 145e-1) * 4e0 as x")
    names = [n for n in _ACT_SQL if n not in ("tanh", "identity")]
    return x.selectExpr("idx", *[f"round({n}(x), 6) + 0e0 as {n}" for n in names])


NALU_LAYERS = [
    (((1.0, 0.4), (-1.0, 0.7)), ((2.0, 1.0), (2.0, -1.0)), ((0.5, -0.3), (0.5, 0.2))),
    (((0.8,), (0.3,)), ((1.5,), (0.5,)), ((0.4,), (-0.6,))),
]
DENSE_LAYERS = [
    (((0.5, -0.25, 0.1), (0.3, 0.8, -0.6)), (0.1, -0.2, 0.05), "elu"),
    (((0.7,), (-0.4,), (0.9,)), (0.25,), "identity"),
]
_IN = ["flux", "pix5"]


def _sigmoid_sql(x: str) -> str:
    return f"(1e0/(1e0+exp(-({x}))))"


def _nalu_ctes() -> list[str]:
    names, source, ctes = _IN, "cal", []
    for d, (w_hat, m_hat, gate) in enumerate(NALU_LAYERS):
        cols = []
        for j in range(len(w_hat[0])):
            w = [f"(tanh({r[j]!r}::double)*{_sigmoid_sql(f'{m[j]!r}::double')})" for r, m in zip(w_hat, m_hat)]
            add = "+".join(f"{n}*{k}" for n, k in zip(names, w))
            mul = "exp(" + "+".join(f"ln(abs({n})+1e-7)*{k}" for n, k in zip(names, w)) + ")"
            g = _sigmoid_sql("+".join(f"{n}*{r[j]!r}::double" for n, r in zip(names, gate)))
            cols.append(f"{g}*({add}) + (1e0-{g})*{mul} as h{d}_{j}")
        ctes.append(f"n{d} as (select idx, {', '.join(cols)} from {source})")
        names, source = [f"h{d}_{j}" for j in range(len(w_hat[0]))], f"n{d}"
    return ctes


def _dense_ctes() -> list[str]:
    names, source, ctes = _IN, "cal", []
    for d, (w, b, act) in enumerate(DENSE_LAYERS):
        cols = []
        for j in range(len(b)):
            z = "+".join(f"{n}*({r[j]!r}::double)" for n, r in zip(names, w)) + f"+({b[j]!r}::double)"
            cols.append(f"({z}) as z{j}")
        inner = f"(select idx, {', '.join(cols)} from {source})"
        acts = [_ACT_SQL[act].replace("exp", "EXP").replace("x", f"z{j}").replace("EXP", "exp") + f" as d{d}_{j}"
                for j in range(len(b))]
        ctes.append(f"l{d} as (select idx, {', '.join(acts)} from {inner})")
        names, source = [f"d{d}_{j}" for j in range(len(b))], f"l{d}"
    return ctes


@query("nalu_forward", on_cal(
    "select idx, " + sql_rnd("h1_0") + " as prediction from n1", *_nalu_ctes()))
def nalu_forward(spark, sf):
    out = networks.nalu_forward(cal(spark, sf).select("idx", *_IN), _IN, NALU_LAYERS)
    return rounded(out, ["prediction"])


@query("dense_forward", on_cal(
    "select idx, " + sql_rnd("d1_0") + " as prediction from l1", *_dense_ctes()))
def dense_forward(spark, sf):
    out = networks.dense_forward(cal(spark, sf).select("idx", *_IN), _IN, DENSE_LAYERS)
    return rounded(out, ["prediction"])


def fixed_nalu():
    """The fixed arithmetic network as a model, as if loaded from disk."""
    flat = [v for layer in NALU_LAYERS for block in layer for row in block for v in row]
    spec = {"kind": "nalu", "n_in": 2, "hidden": [2], "loss": "l2"}
    return neural.NetworkModel()._set(specJson=json.dumps(spec), weights=flat)


@query("network_score", on_cal(
    "select idx, " + sql_rnd("h1_0") + " as prediction from n1", *_nalu_ctes()))
def network_score(spark, sf):
    """Arrow-batched scoring with stored weights."""
    df = cal(spark, sf).select("idx", F.array(*_IN).alias("features"))
    return rounded(fixed_nalu().transform(df), ["prediction"])


@query("network_score_sql", on_cal(
    "select idx, " + sql_rnd("h1_0") + " as prediction from n1", *_nalu_ctes()))
def network_score_sql(spark, sf):
    neural.register_sql(spark, fixed_nalu(), "nalu_score")
    out = cal(spark, sf).selectExpr("idx", f"nalu_score(array({', '.join(_IN)})) as prediction")
    return rounded(out, ["prediction"])
