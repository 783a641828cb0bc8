"""Pixel linear model (R-16): ordinary least squares from the covariance matrix of its terms.

Normalised pixels sum to one, so they are collinear with the intercept. The coefficients are the minimum-norm
solution; fitted values are unique.
"""

from __future__ import annotations

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfit import schema
from lumenfit.operators.scale import moments

NULL_DIRECTION = 1e-9  # relative size below which a covariance eigenvalue counts as zero


class _Terms(HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    pixCols = Param(Params._dummy(), "pixCols", "pixel columns", TypeConverters.toListString)
    timeCol = Param(Params._dummy(), "timeCol", "time column", TypeConverters.toString)
    slope = Param(Params._dummy(), "slope", "fit a linear trend", TypeConverters.toBoolean)
    curvature = Param(Params._dummy(), "curvature", "fit a quadratic trend", TypeConverters.toBoolean)

    def _term_columns(self, time_mean: float) -> list[Column]:
        t = F.col(self.getOrDefault(self.timeCol)) - F.lit(time_mean)
        trend = [t] if self.getOrDefault(self.slope) else []
        trend += [t * t] if self.getOrDefault(self.curvature) else []
        return trend + [F.col(c) for c in self.getOrDefault(self.pixCols)]


class PixelLinearModel(Estimator, _Terms):
    """``flux = intercept + slope (t - mean t) [+ curvature (t - mean t)^2] + sum c_k pix_k``."""

    @keyword_only
    def __init__(
        self, *, pixCols=None, timeCol="bmjd", slope=True, curvature=False, labelCol="flux",
        predictionCol="prediction",
    ):
        super().__init__()
        self._setDefault(
            pixCols=schema.PIXELS, timeCol="bmjd", slope=True, curvature=False, labelCol="flux",
            predictionCol="prediction",
        )
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> "FittedPixelLinearModel":
        t_mean = df.agg(F.avg(self.getOrDefault(self.timeCol))).first()[0]
        terms = self._term_columns(t_mean)
        _, means, cov = moments(df, [*terms, F.col(self.getLabelCol())])
        width = np.sqrt(np.diag(cov)[:-1])
        width[width == 0] = 1.0
        corr = cov[:-1, :-1] / np.outer(width, width)
        beta = np.linalg.pinv(corr, rcond=NULL_DIRECTION, hermitian=True) @ (cov[:-1, -1] / width)
        beta = beta / width
        model = FittedPixelLinearModel()
        self._copyValues(model)
        return model._set(
            timeMean=float(t_mean), coefficients=beta.tolist(),
            intercept=float(means[-1] - means[:-1] @ beta),
        )


class FittedPixelLinearModel(Model, _Terms):
    timeMean = Param(Params._dummy(), "timeMean", "mean time of the fit", TypeConverters.toFloat)
    intercept = Param(Params._dummy(), "intercept", "constant term", TypeConverters.toFloat)
    coefficients = Param(Params._dummy(), "coefficients", "term weights", TypeConverters.toListFloat)

    def _transform(self, df: DataFrame) -> DataFrame:
        out = F.lit(self.getOrDefault(self.intercept))
        terms = self._term_columns(self.getOrDefault(self.timeMean))
        for b, term in zip(self.getOrDefault(self.coefficients), terms):
            out = out + F.lit(b) * term
        return df.withColumn(self.getPredictionCol(), out)
