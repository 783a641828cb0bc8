"""Column engineering on calibration tables (F-2 .. F-21)."""

from __future__ import annotations

import math

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfit import schema
from lumenfit.functions.hashing import normal
from lumenfit.operators.common import all_of, as_list, join_stats, sum_of
from lumenfit.operators.index import lag_diff, time_span, with_dense_index
from lumenfit.operators.median import SMALL, exact_median, median_value


def pld_normalize(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """F-2: divide each pixel column by the row's pixel sum."""
    cols = cols or schema.pixel_cols(df)
    total = sum_of(cols)
    return df.withColumns({c: F.col(c) / total for c in cols})


def check_pld(df: DataFrame, cols: list[str] | None = None, tol: float = 1e-9) -> DataFrame:
    """F-3: one row saying how far any row's pixel sum is from one, and whether all are within ``tol``."""
    off = F.abs(sum_of(cols or schema.pixel_cols(df)) - 1.0)
    return df.agg(
        F.max(off).alias("max_deviation"),
        F.coalesce(F.max(off) <= tol, F.lit(True)).alias("normalised"),
    )


def median_normalize(
    df: DataFrame, cols=None, by: str = "flux", partition_by=None, small: int = SMALL
) -> DataFrame:
    """F-4 / F-5: divide columns by the raw median of ``by``, over all rows or per group."""
    cols = [c for c in (cols or schema.FLUX_SCALED) if c in df.columns]
    groups = as_list(partition_by)
    if not groups:
        m = F.lit(median_value(df, by, small))
        return df.withColumns({c: F.col(c) / m for c in cols})
    medians = exact_median(df, by, groups, "_median", small)
    joined = join_stats(df, medians, groups)
    return joined.withColumns({c: F.col(c) / F.col("_median") for c in cols}).drop("_median")


def half_cadence(
    df: DataFrame, col: str = "bmjd", order="idx", name: str = "bmjd_err", **sizes
) -> DataFrame:
    """F-6: add the median half step of the time column as a constant error column."""
    return df.withColumn(name, F.lit(half_step(df, col, order, **sizes)))


def half_step(df: DataFrame, col: str = "bmjd", order="idx", **sizes) -> float:
    """The median of half the first differences of a column in the given order."""
    steps = lag_diff(df.select(col, *[c for c in as_list(order) if c != col]), col, order, "_s", **sizes)
    return median_value(steps.select((F.lit(0.5) * F.col("_s")).alias("_h")), "_h")


def noise_pixel_error(df: DataFrame) -> DataFrame:
    """F-7: ``np_err = sqrt(yerr)``."""
    return df.withColumn("np_err", F.sqrt("yerr"))


def pixel_errors(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """F-8: ``<pix>_err = pix * fluxerr`` for every pixel column."""
    cols = cols or schema.pixel_cols(df)
    return df.withColumns({f"{c}_err": F.col(c) * F.col("fluxerr") for c in cols})


def freq_ramp(df: DataFrame, col: str = "bmjd", order="idx", name: str = "freq") -> DataFrame:
    """F-9: an even ramp from ``pi / (t_max - t_min)`` to ``4 pi / min step`` along the row order.

    Equal times on consecutive rows make the smallest step zero: the ramp then has no finite end, its first row is NaN and the
    others are infinite, as in SQL. Without any step (fewer than two times) it is null.
    """
    span = time_span(df.select(col, *[c for c in as_list(order) if c != col]), col, order).first()
    start, stop = _over(math.pi, span["t_range"]), _over(4 * math.pi, span["min_step"])
    step = None if start is None or stop is None else (stop - start) / max(1, span["n"] - 1)
    indexed = with_dense_index(df, order, "_rn")
    return indexed.withColumn(name, F.lit(start).cast("double") + F.col("_rn") * F.lit(step).cast("double")).drop("_rn")


def _over(a: float, b: float | None) -> float | None:
    """A positive number over another as SQL divides doubles: infinite over zero, null over null."""
    if b is None:
        return None
    return a / b if b else math.copysign(math.inf, b)


def drop_features(df: DataFrame, names) -> DataFrame:
    """F-10: drop the named columns that exist."""
    return df.drop(*names)


def label_or_ones(df: DataFrame, label: str = "flux", name: str = "label") -> DataFrame:
    """F-12: the label column, or ones where the frame has none (new data)."""
    return df.withColumn(name, F.col(label) if label in df.columns else F.lit(1.0))


def select_features(df: DataFrame, preset: str, extra=("idx",)) -> DataFrame:
    """F-13: project onto the sorted features of a preset plus identity columns."""
    keep = [c for c in extra if c in df.columns]
    return df.select(*keep, *schema.feature_preset(df, preset))


def stride(df: DataFrame, n: int, index: str = "idx") -> DataFrame:
    """F-14: every n-th row by dense index."""
    return df.where(F.col(index) % n == 0)


def sigma_clip(
    df: DataFrame, cols, k: float = 4.0, iters: int | None = None, robust: bool = False
) -> DataFrame:
    """F-15: drop rows further than ``k`` sigma from the centre in any column.

    Repeats until no row is dropped, or ``iters`` times. Centre and width are mean and population standard
    deviation, or median and 1.4826 times the median absolute deviation. Nulls and NaN are left out of the statistics
    and never drop a row. Each round adds literal bounds to
    one filter over the source, so the plan does not grow with the rounds.
    """
    cols = as_list(cols)
    bounds: dict[str, list[float]] = {c: [-math.inf, math.inf] for c in cols}

    def keep() -> Column:
        return all_of([
            F.coalesce(F.isnan(F.col(c).cast("double")) | F.col(c).between(*b), F.lit(True)) for c, b in bounds.items()
        ])

    done, last = 0, None
    while iters is None or done < iters:
        # Rows outside the bounds count as nulls instead of being filtered, which keeps planning cheap.
        inside = {c: F.when(keep() & ~F.isnan(F.col(c).cast("double")), F.col(c)) for c in cols}
        row = df.agg(
            F.count_if(keep()).alias("n"),
            *[F.avg(x).alias(f"m_{c}") for c, x in inside.items()],
            *[F.stddev_pop(x).alias(f"s_{c}") for c, x in inside.items()],
        ).first()
        if row["n"] == last or row["n"] == 0:
            break
        last, done = row["n"], done + 1
        for c in cols:
            centre, width = row[f"m_{c}"], row[f"s_{c}"]
            if centre is None:  # no value in the column
                continue
            if robust:
                kept = df.select(inside[c].alias(c))
                centre = median_value(kept, c)
                away = kept.select(F.abs(F.col(c) - F.lit(centre)).alias("_d"))
                width = 1.4826 * median_value(away, "_d")
            lo, hi = bounds[c]
            bounds[c] = [max(lo, centre - k * width), min(hi, centre + k * width)]
    return df.where(keep())


def nudge_integers(df: DataFrame, col: str = "flux", by: float = 1e-6) -> DataFrame:
    """F-16: add a small amount to labels that are whole numbers."""
    c = F.col(col)
    return df.withColumn(col, F.when(F.floor(c) == c, c + F.lit(by)).otherwise(c))


def fill_nan_median(df: DataFrame, col: str = "prediction", small: int = SMALL) -> DataFrame:
    """F-17: replace NaN by the median of the other values."""
    m = F.lit(median_value(df, col, small))
    return df.withColumn(col, F.when(F.isnan(col), m).otherwise(F.col(col)))


def unpack_features(df: DataFrame, names: list[str], vector: str = "features", extra=()) -> DataFrame:
    """F-18: a vector column back into named scalar columns next to ``extra`` (label, keys)."""
    from pyspark.ml.functions import vector_to_array

    arr = df.withColumn("_a", vector_to_array(F.col(vector)))
    return arr.select(*extra, *[F.col("_a")[i].alias(c) for i, c in enumerate(names)])


def resample(
    df: DataFrame, pairs: dict[str, str] | None = None, n: int = 1, seed: int = 42,
    key: str = "idx", pixels: list[str] | None = None,
) -> DataFrame:
    """F-19 / F-20: ``n`` Monte-Carlo draws per row, stacked, with the draw number in ``draw``.

    Each input is drawn from a normal around its value; ``pairs`` names the error column per input, and a
    pixel's error is ``pix * fluxerr``. Draws are digests of (seed, row, draw, column).
    """
    pairs = {
        c: e for c, e in (pairs or schema.ERROR_OF).items() if c in df.columns and e in df.columns
    }
    pixels = set(schema.pixel_cols(df) if pixels is None else pixels)
    drawn = df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    new = {}
    for c, e in pairs.items():
        sigma = F.col(c) * F.col(e) if c in pixels else F.col(e)
        z = normal(F.lit(seed), F.col(key), F.col("draw"), F.lit(c))
        new[c] = F.col(c) + sigma * z
    return drawn.withColumns(new)


def to_float32(df: DataFrame, cols) -> DataFrame:
    """F-21: cast columns to single precision."""
    return df.withColumns({c: F.col(c).cast("float") for c in as_list(cols)})


class CalibrationPrep(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Flux normalisation, error columns and pixel normalisation as one fitted stage.

    ``fit`` learns the median flux and the half time step of the calibration table; the fitted stage applies
    the same numbers to new data, so a saved pipeline holds every step (F-2, F-4, F-6, F-7, F-8, S-12).
    """

    order = Param(Params._dummy(), "order", "row order column", TypeConverters.toString)
    normalizePixels = Param(
        Params._dummy(), "normalizePixels", "divide pixels by their row sum", TypeConverters.toBoolean
    )

    @keyword_only
    def __init__(self, *, order="idx", normalizePixels=True):
        super().__init__()
        self._setDefault(order="idx", normalizePixels=True)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "CalibrationPrepModel":
        model = CalibrationPrepModel()
        return model._set(
            medianFlux=median_value(df, "flux"),
            halfStep=half_step(df, "bmjd", self.getOrDefault(self.order)),
            normalizePixels=self.getOrDefault(self.normalizePixels),
        )


class CalibrationPrepModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    medianFlux = Param(Params._dummy(), "medianFlux", "raw median flux", TypeConverters.toFloat)
    halfStep = Param(Params._dummy(), "halfStep", "median half time step", TypeConverters.toFloat)
    normalizePixels = Param(
        Params._dummy(), "normalizePixels", "divide pixels by their row sum", TypeConverters.toBoolean
    )

    def _transform(self, df: DataFrame) -> DataFrame:
        m = F.lit(self.getOrDefault(self.medianFlux))
        scaled = [c for c in schema.FLUX_SCALED if c in df.columns]
        df = df.withColumns({c: F.col(c) / m for c in scaled})
        df = df.withColumn("bmjd_err", F.lit(self.getOrDefault(self.halfStep)))
        if "yerr" in df.columns:
            df = noise_pixel_error(df)
        if "fluxerr" in df.columns:
            df = pixel_errors(df)
        if self.getOrDefault(self.normalizePixels):
            df = pld_normalize(df)
        return df
