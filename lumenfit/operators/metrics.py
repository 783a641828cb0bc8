"""Scores and residual analysis (E-1 .. E-20), each a map-side-combined aggregation.

Every metric returns one row, or one row per group of ``by``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfit.operators.common import as_list, join_on, join_stats
from lumenfit.operators.median import SMALL, exact_median, median_value


def _agg(df: DataFrame, by, **exprs: Column) -> DataFrame:
    return df.groupBy(*as_list(by)).agg(*[e.alias(n) for n, e in exprs.items()])


def r2_expr(y: str, pred: str) -> Column:
    """1 - SSE / SST; the total sum of squares comes from the merged variance, which is stable."""
    return 1.0 - F.sum(_sq_error(y, pred)) / (F.var_pop(y) * F.count(F.col(y)))


def _sq_error(y: str, pred: str) -> Column:
    e = F.col(y) - F.col(pred)
    return e * e


def r2(df, y="flux", pred="prediction", err="fluxerr", by=None) -> DataFrame:
    """E-1 (not the squared correlation), also as a percentage."""
    return _agg(df, by, r2=r2_expr(y, pred), r2_pct=100.0 * r2_expr(y, pred))


def rmse(df, y="flux", pred="prediction", err="fluxerr", by=None) -> DataFrame:
    """E-2."""
    return _agg(df, by, rmse=F.sqrt(F.avg(_sq_error(y, pred))))


def mse(df, y="flux", pred="prediction", err="fluxerr", by=None) -> DataFrame:
    """E-3."""
    return _agg(df, by, mse=F.avg(_sq_error(y, pred)))


def l2_loss(df, y="flux", pred="prediction", err="fluxerr", by=None) -> DataFrame:
    """E-4: half the sum of squared errors."""
    return _agg(df, by, l2_loss=0.5 * F.sum(_sq_error(y, pred)))


def abs_loss(df, y="flux", pred="prediction", err="fluxerr", by=None) -> DataFrame:
    """E-4: the sum of absolute errors."""
    return _agg(df, by, abs_loss=F.sum(F.abs(F.col(y) - F.col(pred))))


def chi_expr(y: str, pred: str, err: str) -> Column:
    return F.pow((F.col(y) - F.col(pred)) / F.col(err), 2)


def chisq(df, y="flux", pred="prediction", err="fluxerr", by=None) -> DataFrame:
    """E-5."""
    return _agg(df, by, chisq=F.sum(chi_expr(y, pred, err)))


def reduced_chisq(
    df, y="flux", pred="prediction", err="fluxerr", by=None, err_scale: str = "sqrt3",
    small: int = SMALL,
) -> DataFrame:
    """E-6: chi-square per row with the error divided by sqrt(3), or with the median error over 5.

    ``err_scale`` is ``sqrt3`` or ``median25``; the median is over all rows, also with ``by``.
    """
    if err_scale == "sqrt3":
        sigma = F.col(err) / F.lit(math.sqrt(3.0))
    elif err_scale == "median25":
        sigma = F.lit(median_value(df, err, small) / 5.0)
    else:
        raise ValueError(f"unknown err_scale {err_scale!r}")
    chi = F.pow((F.col(y) - F.col(pred)) / sigma, 2)
    return _agg(df, by, reduced_chisq=F.sum(chi) / F.count(F.lit(1)))


def _with_mean(df: DataFrame, col: str, by: list[str], name: str) -> DataFrame:
    """The mean next to each row: a literal without groups, else a join on them."""
    if not by:
        return df.withColumn(name, F.lit(df.agg(F.avg(col)).first()[0]))
    return join_stats(df, df.groupBy(*by).agg(F.avg(col).alias(name)), by)


def rho2(df, y="flux", pred="prediction", err="fluxerr", by=None) -> DataFrame:
    """E-7: 1 - chi-square of the model over chi-square of the mean."""
    with_mean = _with_mean(df, y, as_list(by), "_mean")
    return _agg(
        with_mean, by,
        rho2=1.0 - F.sum(chi_expr(y, pred, err)) / F.sum(chi_expr(y, "_mean", err)),
    )


def close_expr(y: str, pred: str, atol: float = 1e-4, rtol: float = 1e-4) -> Column:
    """True where ``|y - pred| <= atol + rtol * |pred|``; the prediction is the reference value."""
    return F.abs(F.col(y) - F.col(pred)) <= F.lit(atol) + F.lit(rtol) * F.abs(F.col(pred))


def tolerance_accuracy(
    df, y="flux", pred="prediction", err="fluxerr", by=None, atol: float = 1e-4, rtol: float = 1e-4
) -> DataFrame:
    """E-8: the share of rows within tolerance."""
    hit = close_expr(y, pred, atol, rtol).cast("double")
    return _agg(df, by, tolerance_accuracy=F.avg(hit))


def val_accuracy(df, y="flux", pred="prediction", err="fluxerr", by=None) -> DataFrame:
    """E-9: 100 * (1 - mean squared error)."""
    return _agg(df, by, val_accuracy=100.0 * (1.0 - F.avg(_sq_error(y, pred))))


def loss_ratio(
    df, y="flux", pred="prediction", err="fluxerr", by=None, split: str = "split"
) -> DataFrame:
    """E-10: mean squared error on ``val`` rows over that on ``train`` rows."""
    e = _sq_error(y, pred)
    val, train = F.avg(F.when(F.col(split) == "val", e)), F.avg(F.when(F.col(split) == "train", e))
    return _agg(df, by, val_loss=val, train_loss=train, loss_ratio=val / train)


def fit_report(
    df, y="flux", pred="prediction", err="fluxerr", by=None, split: str = "split"
) -> DataFrame:
    """E-11: train R2 next to test R2, in percent, with row counts."""

    def part(name: str) -> tuple[Column, Column]:
        on = F.col(split) == name
        n = F.count_if(on)
        sse = F.sum(F.when(on, _sq_error(y, pred)))
        return n, 100.0 * (1.0 - sse / (F.var_pop(F.when(on, F.col(y))) * n))

    (n_train, train), (n_test, test) = part("train"), part("test")
    return _agg(
        df, by, n_train=n_train, n_test=n_test, train_r2_pct=train, test_r2_pct=test
    )


def _with_median(df: DataFrame, col: str, by: list[str], name: str, small: int) -> DataFrame:
    if not by:
        return df.withColumn(name, F.lit(median_value(df, col, small)))
    return join_stats(df, exact_median(df, col, by, name, small), by)


def demedian(df, col="flux", by=None, name: str | None = None, small: int = SMALL) -> DataFrame:
    """E-12: the column minus its median."""
    out = _with_median(df, col, as_list(by), "_med", small)
    return out.withColumn(name or f"{col}_demedian", F.col(col) - F.col("_med")).drop("_med")


def robust_z(df, col="flux", by=None, name: str | None = None, small: int = SMALL) -> DataFrame:
    """E-13: (x - median) / population standard deviation."""
    keys = as_list(by)
    out = _with_median(df, col, keys, "_med", small)
    if keys:
        out = join_stats(out, df.groupBy(*keys).agg(F.stddev_pop(col).alias("_std")), keys)
    else:
        out = out.withColumn("_std", F.lit(df.agg(F.stddev_pop(col)).first()[0]))
    z = (F.col(col) - F.col("_med")) / F.col("_std")
    return out.withColumn(name or f"{col}_z", z).drop("_med", "_std")


def relative_residual(
    df, y="flux", pred="prediction", by=None, name: str = "rel_residual", small: int = SMALL
) -> DataFrame:
    """E-14: (e - median e) / prediction with e = prediction - y."""
    out = df.withColumn("_e", F.col(pred) - F.col(y))
    out = _with_median(out, "_e", as_list(by), "_med", small)
    return out.withColumn(name, (F.col("_e") - F.col("_med")) / F.col(pred)).drop("_e", "_med")


def scatter_improvement(df, y="flux", pred="prediction", err="fluxerr", by=None) -> DataFrame:
    """E-15: scatter in percent before and after the model (the median shift leaves a deviation as is)."""
    return _agg(
        df, by,
        scatter_raw_pct=F.round(100.0 * F.stddev_pop(y), 3),
        scatter_fit_pct=F.round(100.0 * F.stddev_pop(F.col(y) - F.col(pred)), 3),
    )


def residual_histogram(
    df: DataFrame, expr: Column | str, bins: int | None = None, lo: float | None = None,
    hi: float | None = None, density: bool = False, rows_per_bin: int = 1000,
) -> DataFrame:
    """E-16: equal-width histogram with a closed last bin; values outside ``[lo, hi]`` are cut.

    Without ``bins`` there is one per ``rows_per_bin`` rows. Empty bins are not listed.
    """
    x = F.expr(expr) if isinstance(expr, str) else expr
    vals = df.select(x.cast("double").alias("_x")).select(F.when(~F.isnan("_x"), F.col("_x")).alias("_x"))
    if bins is None or lo is None or hi is None:
        row = vals.agg(F.count("_x"), F.min("_x"), F.max("_x")).first()
        bins = bins or max(1, row[0] // rows_per_bin)
        lo = row[1] if lo is None else lo
        hi = row[2] if hi is None else hi
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    # Values outside fall into a bin on either side and are dropped after counting, not filtered before: the value
    # may be a long derived expression, and a filter on it is costly to plan.
    raw = F.floor((F.col("_x") - F.lit(lo)) / F.lit(width))
    raw = F.least(F.greatest(raw, F.lit(-1)), F.lit(bins)).cast("bigint")
    sizes = vals.groupBy(raw.alias("_raw")).agg(
        F.count("_x").alias("_n"), F.count_if(F.col("_x") <= hi).alias("_top")
    )
    inside = F.when(F.col("_raw").between(0, bins - 1), F.col("_n")).when(F.col("_raw") == bins, F.col("_top"))
    counts = (
        sizes.groupBy(F.least(F.greatest("_raw", F.lit(0)), F.lit(bins - 1)).cast("bigint").alias("bin"))
        .agg(F.sum(inside).alias("n"))
        .where("n > 0")
        .withColumns({
            "bin_lo": F.lit(lo) + F.col("bin") * F.lit(width),
            "bin_hi": F.lit(lo) + (F.col("bin") + 1) * F.lit(width),
        })
    )
    if not density:
        return counts
    # One row per bin, so one window over all of them is small.
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("density", F.col("n") / (F.lit(width) * total))


def summary(df, y="flux", pred="prediction", err="fluxerr", by=None, small: int = SMALL) -> DataFrame:
    """E-17: median flux and median error."""
    flux = exact_median(df, y, by, f"median_{y}", small)
    error = exact_median(df, err, by, f"median_{err}", small)
    keys = as_list(by)
    if keys:
        return join_on(flux, error, keys)
    value = error.first()[0]
    return flux.withColumn(f"median_{err}", F.lit(value))


def split_sizes(df, split: str = "split") -> DataFrame:
    """E-18: rows per split and their share of all rows."""
    counts = df.groupBy(split).agg(F.count(F.lit(1)).alias("n"))
    # One row per split name: a handful, whatever the table's size.
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("share", F.col("n") / total)


def position_grid(
    df, nx: int = 50, ny: int = 50, x: str = "xpos", y: str = "ypos", value: str = "flux"
) -> DataFrame:
    """E-20: mean of a value on an ``nx`` by ``ny`` grid over the centroid positions."""
    ext = df.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()

    def cell(col: str, lo: float, hi: float, n: int) -> Column:
        width = (hi - lo) / n or 1.0
        return F.least(F.floor((F.col(col) - F.lit(lo)) / F.lit(width)), F.lit(n - 1)).cast("bigint")

    return df.groupBy(
        cell(x, ext[0], ext[1], nx).alias("gx"), cell(y, ext[2], ext[3], ny).alias("gy")
    ).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias(f"mean_{value}"))


def position_scatter(df, x="xpos", y="ypos", value="flux", every: int = 1) -> DataFrame:
    """E-20: positions with a value, as a table to plot."""
    from lumenfit.operators.features import stride

    return (stride(df, every) if every > 1 else df).select("idx", x, y, value)
