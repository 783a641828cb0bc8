"""Scalers with population statistics, as ``pyspark.ml`` stages (D-S1 .. D-S8).

The built-in standard scaler divides by the sample deviation and the built-in range scaler maps a constant
column to the middle of the range; these divide by the population deviation and map constants to zero.
Fitting is one ``Summarizer`` aggregate; applying is array arithmetic in generated code, without Python.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfit.functions.kernels import CELLS, cells
from lumenfit.operators.common import as_list, join_stats, sum_cells


def literal_array(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


class _InOut(HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Input and output vector columns, shared by the stages here."""


class AffineModel(Model, _InOut):
    """``(x - shift) / scale + offset`` per vector element."""

    shift = Param(Params._dummy(), "shift", "subtracted", TypeConverters.toListFloat)
    scale = Param(Params._dummy(), "scale", "divided by", TypeConverters.toListFloat)
    offset = Param(Params._dummy(), "offset", "added", TypeConverters.toListFloat)

    def __init__(self):
        super().__init__()

    def numbers(self) -> tuple[list[float], list[float], list[float]]:
        return tuple(self.getOrDefault(p) for p in (self.shift, self.scale, self.offset))

    def _transform(self, df: DataFrame) -> DataFrame:
        shift, scale, offset = self.numbers()
        shifts, scales, offsets = (literal_array(v) for v in (shift, scale, offset))

        def scaled(x: Column, i: Column) -> Column:
            x = x - shifts.getItem(i)
            x = x / scales.getItem(i) if any(s != 1.0 for s in scale) else x
            return x + offsets.getItem(i) if any(offset) else x

        out = F.transform(vector_to_array(F.col(self.getInputCol())), scaled)
        return df.withColumn(self.getOutputCol(), array_to_vector(out))

    def inverse(self, df: DataFrame, col: str, output: str) -> DataFrame:
        """Undo the scaling on a vector column."""
        shift, scale, offset = self.numbers()
        out = F.zip_with(vector_to_array(F.col(col)), literal_array(offset), lambda x, s: x - s)
        out = F.zip_with(out, literal_array(scale), lambda x, s: x * s)
        out = F.zip_with(out, literal_array(shift), lambda x, s: x + s)
        return df.withColumn(output, array_to_vector(out))


def affine(input_col, output_col, shift, scale, offset=None) -> AffineModel:
    shift, scale = [float(v) for v in shift], [float(v) for v in scale]
    return AffineModel()._set(
        inputCol=input_col, outputCol=output_col, shift=shift, scale=scale,
        offset=[float(v) for v in offset] if offset is not None else [0.0] * len(shift),
    )


def vector_stats(df: DataFrame, col: str):
    """Count, mean, population variance, minimum and maximum of a vector column in one pass."""
    s = Summarizer.metrics("count", "mean", "variance", "min", "max").summary(F.col(col))
    row = df.select(s.alias("s")).first()["s"]
    n = row["count"]
    var = [v * (n - 1) / n if n > 1 else 0.0 for v in row["variance"]]
    return n, list(row["mean"]), var, list(row["min"]), list(row["max"])


def moments(df: DataFrame, cols: list) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, means and sample covariance matrix of scalar columns; only the matrix reaches the driver.

    Nulls are skipped as SQL's ``avg`` and ``covar_samp`` skip them: a mean is over a column's values, a covariance over
    the rows that have both. Two passes: the means, then, per pair, the count, the sums and the products of the centred
    columns, multiplied by Arrow batch and added up by Spark cell by cell. A column without a value has mean NaN, and a
    pair without two common rows covariance NaN. NaN values are values.
    """
    d, names = len(cols), [f"x{i}" for i in range(len(cols))]
    cols = [F.col(c) if isinstance(c, str) else c for c in cols]
    data = df.select(*[c.cast("double").alias(n) for c, n in zip(cols, names)])
    row = data.agg(F.count(F.lit(1)), *[F.avg(c) for c in names]).first()
    n, means = row[0], np.array([np.nan if m is None else m for m in row[1:]], dtype=float)
    centre = np.where(np.isfinite(means), means, 0.0)
    size = d * d

    def products(batches):
        total = np.zeros(3 * size)
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - centre
            there = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            x = np.where(there > 0, x, 0.0)
            total[:size] += (x.T @ x).ravel()
            total[size : 2 * size] += (x.T @ there).ravel()  # sums of a over the rows that have b
            total[2 * size :] += (there.T @ there).ravel()
        yield cells(total)

    if n == 0:
        return 0, means, np.full((d, d), np.nan)
    cross, sums, counts = np.array(sum_cells(data.mapInArrow(products, CELLS))).reshape(3, d, d)
    with np.errstate(invalid="ignore", divide="ignore"):
        cov = np.where(counts > 1, (cross - sums * sums.T / counts) / (counts - 1), np.nan)
    return n, means, cov


class PopulationScaler(Estimator, _InOut):
    """D-S1: centre and divide by the population standard deviation; constants become zero."""

    withMean = Param(Params._dummy(), "withMean", "subtract the mean", TypeConverters.toBoolean)
    withStd = Param(Params._dummy(), "withStd", "divide by the deviation", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, inputCol="features", outputCol="scaled", withMean=True, withStd=True):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> AffineModel:
        _, mean, var, lo, hi = vector_stats(df, self.getInputCol())
        std = [math.sqrt(v) if a < b and v > 0 else 1.0 for v, a, b in zip(var, lo, hi)]
        return affine(
            self.getInputCol(), self.getOutputCol(),
            mean if self.getOrDefault(self.withMean) else [0.0] * len(mean),
            std if self.getOrDefault(self.withStd) else [1.0] * len(mean),
        )


class RangeScaler(Estimator, _InOut):
    """D-S3: map each element's range to [0, 1]; a constant element becomes ``constantValue``."""

    constantValue = Param(
        Params._dummy(), "constantValue", "output of constant elements", TypeConverters.toFloat
    )

    @keyword_only
    def __init__(self, *, inputCol="features", outputCol="scaled", constantValue=0.0):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="scaled", constantValue=0.0)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> AffineModel:
        _, _, _, lo, hi = vector_stats(df, self.getInputCol())
        fill = self.getOrDefault(self.constantValue)
        return affine(
            self.getInputCol(), self.getOutputCol(), lo,
            [b - a if b > a else 1.0 for a, b in zip(lo, hi)],
            [fill if b == a else 0.0 for a, b in zip(lo, hi)],
        )


class LabelScaler(Estimator, _InOut):
    """D-S2 / D-S4: scale one scalar column, ``kind`` is ``standard`` or ``minmax``."""

    kind = Param(Params._dummy(), "kind", "standard or minmax", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCol="flux", outputCol="label", kind="standard"):
        super().__init__()
        self._setDefault(inputCol="flux", outputCol="label", kind="standard")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "LabelScalerModel":
        c = self.getInputCol()
        row = df.agg(F.avg(c), F.stddev_pop(c), F.min(c), F.max(c)).first()
        if self.getOrDefault(self.kind) == "standard":
            shift, scale = row[0], row[1]
        else:
            shift, scale = row[2], row[3] - row[2]
        scale = 1.0 if row[2] == row[3] else scale
        return LabelScalerModel()._set(
            inputCol=c, outputCol=self.getOutputCol(), shift=float(shift), scale=float(scale)
        )


class LabelScalerModel(Model, _InOut):
    shift = Param(Params._dummy(), "shift", "subtracted", TypeConverters.toFloat)
    scale = Param(Params._dummy(), "scale", "divided by", TypeConverters.toFloat)

    def _transform(self, df: DataFrame) -> DataFrame:
        if self.getInputCol() not in df.columns:  # new data without labels
            return df
        x = F.col(self.getInputCol()) - F.lit(self.getOrDefault(self.shift))
        return df.withColumn(self.getOutputCol(), x / F.lit(self.getOrDefault(self.scale)))

    def inverse(self, col: Column) -> Column:
        """A prediction back on the label's own scale."""
        return col * F.lit(self.getOrDefault(self.scale)) + F.lit(self.getOrDefault(self.shift))


def scale_by_group(df: DataFrame, cols, by) -> DataFrame:
    """D-S5: min-max scale columns separately within each group (e.g. per split)."""
    cols, by = as_list(cols), as_list(by)
    stats = df.groupBy(*by).agg(
        *[F.min(c).alias(f"_lo_{c}") for c in cols], *[F.max(c).alias(f"_hi_{c}") for c in cols]
    )
    out = join_stats(df, stats, by)

    def scaled(c: str) -> Column:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        return F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(F.col(c) * 0.0)

    out = out.withColumns({c: scaled(c) for c in cols})
    return out.drop(*[f"_{s}_{c}" for s in ("lo", "hi") for c in cols])


class ColumnDropper(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Remove intermediate columns at the end of a chained pipeline."""

    names = Param(Params._dummy(), "names", "columns to drop", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, names=None):
        super().__init__()
        self._setDefault(names=[])
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.getOrDefault(self.names))
