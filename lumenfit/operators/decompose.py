"""Covariance, centred PCA, whitening and symmetric ICA (D-P1 .. D-I1, D-C1), and the chained pipelines."""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.feature import PCA, ElementwiseProduct, PCAModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfit.functions.kernels import CELLS, cells, matrix
from lumenfit.operators.common import sum_cells
from lumenfit.operators.scale import (
    AffineModel, ColumnDropper, PopulationScaler, RangeScaler, _InOut, affine, moments, vector_stats,
)
from lumenfit.session import materialise_for_passes

MEMORY = 7  # steps remembered by a descent
SMALLEST = 2.0**-10  # shortest part of a step tried
FLATTEST = 1e-2  # smallest curvature divided by
INLINE_TERMS = 600  # beyond this many products a linear map is a loop instead of generated code


def covariance(df: DataFrame, cols: list[str]) -> DataFrame:
    """D-C1: sample covariances as a long table ``(a, b, cov)``, every pair of columns once."""
    _, _, cov = moments(df, cols)
    rows = [(a, b, float(cov[i, j])) for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]
    return df.sparkSession.createDataFrame(rows, "a string, b string, cov double")


def linear_map(arr: Column, matrix: np.ndarray) -> Column:
    """``matrix @ x`` for an array column as built-in expressions."""
    rows, d = matrix.shape
    if rows * d <= INLINE_TERMS:
        out = []
        for r in matrix:
            terms = [F.element_at(arr, i + 1) * F.lit(float(v)) for i, v in enumerate(r)]
            acc = terms[0]
            for t in terms[1:]:
                acc = acc + t
            out.append(acc)
        return F.array(*out)
    lit = F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in matrix])
    zero = F.lit(0.0)
    return F.transform(
        lit,
        lambda r: F.aggregate(
            F.zip_with(r, arr, lambda a, b: a * b), zero, lambda acc, v: acc + v
        ),
    )


class CenteredPCA(Estimator, _InOut):
    """D-P1 / D-P2: principal components of the centred data, optionally whitened.

    The built-in PCA projects without centring; here a centring stage runs before it, and a scaling stage after
    it fixes signs (the largest loading of a component is positive) and divides by the component deviations.
    """

    k = Param(Params._dummy(), "k", "components, 0 for all", TypeConverters.toInt)
    whiten = Param(Params._dummy(), "whiten", "scale components to unit variance", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, inputCol="features", outputCol="components", k=0, whiten=False):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="components", k=0, whiten=False)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> PipelineModel:
        src, out = self.getInputCol(), self.getOutputCol()
        df = df.select(src).persist()  # read four times below
        try:
            n, mean, var, _, _ = vector_stats(df, src)
            k = self.getOrDefault(self.k) or len(mean)
            # Components do not depend on the origin, so the fit itself reads the uncentred column.
            pca = PCA(k=k, inputCol=src, outputCol=f"_{out}_raw").fit(df).setInputCol(f"_{out}_centred")
        finally:
            df.unpersist()
        centre = affine(src, f"_{out}_centred", mean, [1.0] * len(mean))
        loadings = pca.pc.toArray()
        sign = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(k)])
        factor = sign
        if self.getOrDefault(self.whiten):
            total = sum(var) * n / (n - 1)
            lam = np.maximum(pca.explainedVariance.toArray() * total, 0.0)
            usable = lam > 1e-12 * max(lam.max(), 1e-300)
            factor = np.where(usable, sign / np.sqrt(np.where(usable, lam, 1.0)), 0.0)
        scale = ElementwiseProduct(
            scalingVec=Vectors.dense(factor), inputCol=f"_{out}_raw", outputCol=out
        )
        drop = ColumnDropper(names=[f"_{out}_centred", f"_{out}_raw"])
        return PipelineModel([centre, pca, scale, drop])


def _stages(model) -> list:
    """All leaf stages of a possibly nested pipeline model."""
    if isinstance(model, PipelineModel):
        return [leaf for s in model.stages for leaf in _stages(s)]
    return [model]


def pca_summary(model) -> tuple[np.ndarray, np.ndarray]:
    """(explained variance ratios, sign-fixed loadings as columns) of a fitted :class:`CenteredPCA`."""
    pca = next(s for s in _stages(model) if isinstance(s, PCAModel))
    loadings = pca.pc.toArray()
    sign = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(loadings.shape[1])])
    return pca.explainedVariance.toArray(), loadings * sign


def components_for(model, frac: float = 0.95) -> int:
    """D-P3: the smallest number of components explaining at least ``frac`` of the variance."""
    ratio, _ = pca_summary(model)
    reached = np.flatnonzero(np.cumsum(ratio) >= frac - 1e-12)
    return int(reached[0]) + 1 if len(reached) else len(ratio)


class RotationModel(Model, _InOut):
    """A fixed linear map of a vector column."""

    matrix = Param(Params._dummy(), "matrix", "row-major map", TypeConverters.toListFloat)
    rows = Param(Params._dummy(), "rows", "output length", TypeConverters.toInt)
    iterations = Param(Params._dummy(), "iterations", "passes over the rows", TypeConverters.toInt)
    change = Param(Params._dummy(), "change", "largest entry of the last gradient", TypeConverters.toFloat)

    def as_array(self) -> np.ndarray:
        return np.array(self.getOrDefault(self.matrix)).reshape(self.getOrDefault(self.rows), -1)

    def _transform(self, df: DataFrame) -> DataFrame:
        tmp = f"_{self.getOutputCol()}_a"
        df = df.withColumn(tmp, vector_to_array(F.col(self.getInputCol())))
        mapped = array_to_vector(linear_map(F.col(tmp), self.as_array()))
        return df.withColumn(self.getOutputCol(), mapped).drop(tmp)


def _decorrelate(w: np.ndarray) -> np.ndarray:
    s, u = np.linalg.eigh(w @ w.T)
    return u @ np.diag(1.0 / np.sqrt(np.maximum(s, 1e-15))) @ u.T @ w


def _rotation(skew: np.ndarray) -> np.ndarray:
    """The orthogonal exponential of a skew-symmetric matrix."""
    lam, v = np.linalg.eigh(1j * skew)
    return ((v * np.exp(-1j * lam)) @ v.conj().T).real


class SymmetricICA(Estimator, _InOut):
    """D-I1: independent components with a tanh contrast, by a preconditioned quasi-Newton descent over rotations.

    The data are whitened once and kept. One pass over all rows gives, per task and added up by Spark, the k*k + 2k sums of
    ``g(y) z'``, ``g'(y)`` and ``log cosh y`` for ``y = Wz``: from them the driver has the loss, its skew gradient and the
    diagonal Hessian that holds where the components are independent, which preconditions a limited-memory step. A step that
    raises the loss is halved. A component's contrast is minimised or maximised by the sign of ``E[g'(y)] - E[g(y) y]``, so
    flat and peaked sources are both found; stationary points are those of the symmetric fixed point, reached also where
    near-normal components make it circle. It ends when no entry of the gradient exceeds ``tol``, or after ``maxIter`` passes;
    the model tells passes (``iterations``) and the last largest entry (``change``).
    """

    k = Param(Params._dummy(), "k", "components, 0 for all", TypeConverters.toInt)
    maxIter = Param(Params._dummy(), "maxIter", "largest number of passes", TypeConverters.toInt)
    tol = Param(Params._dummy(), "tol", "convergence tolerance", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed of the starting matrix", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol="features", outputCol="sources", k=0, maxIter=200, tol=1e-4, seed=42):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="sources", k=0, maxIter=200, tol=1e-4, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> PipelineModel:
        src, out = self.getInputCol(), self.getOutputCol()
        white = CenteredPCA(
            inputCol=src, outputCol=f"_{out}_white", k=self.getOrDefault(self.k), whiten=True
        ).fit(df)
        z = white.transform(df).select(vector_to_array(F.col(f"_{out}_white")).alias("z"))
        z = materialise_for_passes(z)
        try:
            n = z.count()
            factor = next(s for s in white.stages if isinstance(s, ElementwiseProduct)).getScalingVec()
            keep = np.flatnonzero(np.array(factor) != 0.0)  # null directions carry no source
            w = _decorrelate(
                np.random.default_rng(self.getOrDefault(self.seed)).normal(size=(len(keep), len(keep)))
            )
            w, passes, change = self._iterate(z, w, keep, n)
        finally:
            z.unpersist()
        full = np.zeros((len(keep), len(np.array(factor))))
        full[:, keep] = w
        rotate = RotationModel()._set(
            inputCol=f"_{out}_white", outputCol=out, matrix=full.ravel().tolist(),
            rows=len(keep), iterations=passes, change=change,
        )
        return PipelineModel([white, rotate, ColumnDropper(names=[f"_{out}_white"])])

    def _iterate(self, z: DataFrame, w: np.ndarray, keep: np.ndarray, n: int) -> tuple[np.ndarray, int, float]:
        tasks, limit, passes = z.rdd.getNumPartitions(), self.getOrDefault(self.maxIter), 1
        memory, at = deque(maxlen=MEMORY), _contrast(z, w, keep, n, tasks)
        while at.change >= self.getOrDefault(self.tol) and passes < limit:
            step, size, moved = _direction(at, memory), 1.0, None
            while passes < limit and size > SMALLEST:
                trial = _decorrelate(_rotation(size * step) @ w)
                new, passes = _contrast(z, trial, keep, n, tasks), passes + 1
                if new.loss(at.sign) < at.loss(at.sign):
                    moved = size * step
                    break
                size /= 2
            if moved is None:
                if not memory:
                    break  # no descent left beyond rounding
                memory.clear()
                continue
            if (new.sign == at.sign).all():
                bend = new.gradient - at.gradient
                if (bend * moved).sum() > 0:
                    memory.append((moved, bend))
            else:
                memory.clear()  # another loss from here on
            w, at = trial, new
        return w, passes, at.change


class _Contrast:
    """Loss, skew gradient and diagonal Hessian of one rotation, from the means of a pass."""

    def __init__(self, products: np.ndarray, slopes: np.ndarray, costs: np.ndarray):
        excess = slopes - np.diag(products)
        self.sign, self.costs = np.where(excess < 0, -1.0, 1.0), costs
        signed = self.sign[:, None] * products
        self.gradient = (signed - signed.T) / 2
        self.hessian = np.maximum((np.abs(excess)[:, None] + np.abs(excess)) / 2, FLATTEST)
        self.change = float(np.abs(self.gradient).max(initial=0.0))

    def loss(self, sign: np.ndarray) -> float:
        return float((sign * self.costs).sum())


def _direction(at: _Contrast, memory) -> np.ndarray:
    """The limited-memory step, preconditioned by the diagonal Hessian; the plain one where it would not descend."""
    q, scales = at.gradient.copy(), []
    for moved, bend in reversed(memory):
        a = (moved * q).sum() / (moved * bend).sum()
        scales.append(a)
        q = q - a * bend
    q = q / at.hessian
    for (moved, bend), a in zip(memory, reversed(scales)):
        q = q + (a - (bend * q).sum() / (moved * bend).sum()) * moved
    if (q * at.gradient).sum() <= 0:
        memory.clear()
        q = at.gradient / at.hessian
    return -q


def _contrast(z: DataFrame, w: np.ndarray, keep: np.ndarray, n: int, tasks: int) -> _Contrast:
    """One pass over all rows at the rotation ``w``."""
    k = len(keep)

    def partial(batches):
        total = np.zeros(k * k + 2 * k)
        for batch in batches:
            x = matrix(batch.column("z"))[:, keep]
            y = x @ w.T
            g = np.tanh(y)
            total[: k * k] += (g.T @ x).ravel()
            total[k * k: k * k + k] += (1.0 - g * g).sum(axis=0)
            total[k * k + k:] += (np.logaddexp(y, -y) - np.log(2.0)).sum(axis=0)
        yield cells(total)

    sums = np.array(sum_cells(z.mapInArrow(partial, CELLS), tasks)) / n
    return _Contrast(sums[: k * k].reshape(k, k) @ w.T, sums[k * k: k * k + k], sums[k * k + k:])


def build_pipeline(
    cols: list[str], standard: bool = True, pca: bool = False, ica: bool = False,
    minmax: bool = False, whiten: bool = True, output: str = "features",
) -> Pipeline:
    """D-S7 / D-S8: the chain picked by flags over named columns; see :func:`pipeline_header`."""
    stages, last = [VectorAssembler(inputCols=cols, outputCol="_v0")], "_v0"
    steps = []
    if standard:
        steps.append(lambda i, o: PopulationScaler(inputCol=i, outputCol=o))
    if pca:
        steps.append(lambda i, o: CenteredPCA(inputCol=i, outputCol=o, whiten=whiten))
    if ica:
        steps.append(lambda i, o: SymmetricICA(inputCol=i, outputCol=o))
    if minmax:
        steps.append(lambda i, o: RangeScaler(inputCol=i, outputCol=o))
    temps = [last]
    for number, step in enumerate(steps, 1):
        nxt = output if number == len(steps) else f"_v{number}"
        stages.append(step(last, nxt))
        temps.append(nxt)
        last = nxt
    if not steps:
        stages[0].setOutputCol(output)
        return Pipeline(stages=stages)
    return Pipeline(stages=[*stages, ColumnDropper(names=[t for t in temps if t != output])])


def pipeline_header(standard=True, pca=False, ica=False, minmax=False) -> str:
    """The name recording which steps a pipeline takes, in order."""
    parts = [p for p, on in (("SS", standard), ("PCA", pca), ("ICA", ica), ("MM", minmax)) if on]
    return "_".join(["STD", *parts])
