"""Boosted trees (R-11 .. R-14)."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfit.functions.hashing import uniform
from lumenfit.operators.ensemble import LeafTableModel, predict_as, tree_sum
from lumenfit.operators.forest import _TreeParams, leaf_table
from lumenfit.operators.median import exact_quantile, exact_quantile_value
from lumenfit.session import ensure_checkpoint_dir, materialise


def boosted(
    maxDepth=3, stepSize=0.1, rounds=100, subsample=1.0, validationCol=None, featuresCol="features",
    labelCol="flux", seed=42, checkpointInterval=10,
) -> GBTRegressor:
    """R-11 / R-13: squared-loss boosting; rows where ``validationCol`` is true stop it early.

    The built-in stopping tolerance is absolute below an error of 0.01, far above squared flux residuals, so it
    is set to zero: boosting stops when the validation error no longer falls.
    """
    gbt = GBTRegressor(
        lossType="squared", maxDepth=maxDepth, stepSize=stepSize, maxIter=rounds, subsamplingRate=subsample,
        featuresCol=featuresCol, labelCol=labelCol, seed=seed, checkpointInterval=checkpointInterval,
    )
    return gbt.copy({gbt.validationIndicatorCol: validationCol, gbt.validationTol: 0.0}) if validationCol else gbt


def fit_boosted(df: DataFrame, **kw):
    """Fit :func:`boosted` with the checkpoint folder in place, so its lineage is really cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return boosted(**kw).fit(df)


def resume_boosted(model, df: DataFrame, rounds: int, labelCol="flux", **kw) -> GBTRegressionModel:
    """R-14: continue squared-loss boosting, which is boosting the residuals of the fitted model."""
    rest = predict_as(model, df, "_old").withColumn("_rest", F.col(labelCol) - F.col("_old"))
    more = fit_boosted(rest.drop("_old"), rounds=rounds, labelCol="_rest", **kw)
    trees, weights = [*model.trees, *more.trees], [*model.treeWeights, *more.treeWeights]
    return tree_sum(trees, weights, model.getFeaturesCol())


class QuantileBoost(Estimator, _TreeParams):
    """R-12: gradient boosting with the quantile loss.

    Each round fits a tree to the loss gradient and then sets every leaf to the exact ``alpha`` quantile of the
    residuals in it, all leaves in one selection, in which a leaf may hold any share of the rows.
    """

    alpha = Param(Params._dummy(), "alpha", "quantile", TypeConverters.toFloat)
    stepSize = Param(Params._dummy(), "stepSize", "learning rate", TypeConverters.toFloat)
    subsample = Param(Params._dummy(), "subsample", "share of rows per round", TypeConverters.toFloat)
    checkpointInterval = Param(
        Params._dummy(), "checkpointInterval", "rounds between checkpoints", TypeConverters.toInt
    )

    @keyword_only
    def __init__(
        self, *, alpha=0.9, numTrees=100, stepSize=0.1, maxDepth=3, subsample=1.0, minInstances=1,
        featuresCol="features", labelCol="flux", predictionCol="prediction", keyCol="idx", seed=42,
        parallelism=1, checkpointInterval=5,
    ):
        super().__init__()
        self._defaults(
            self._input_kwargs, alpha=0.9, maxDepth=3, stepSize=0.1, subsample=1.0, checkpointInterval=5
        )

    def _fit(self, df: DataFrame) -> LeafTableModel:
        start = exact_quantile_value(df, self.getLabelCol(), self.getOrDefault(self.alpha))
        return self.resume(LeafTableModel(base=start), df, self.getOrDefault(self.numTrees))

    def resume(self, model: LeafTableModel, df: DataFrame, rounds: int) -> LeafTableModel:
        """R-14: ``rounds`` further rounds on top of a fitted model."""
        x, y, key = self.getFeaturesCol(), self.getLabelCol(), self.getOrDefault(self.keyCol)
        alpha, step = self.getOrDefault(self.alpha), self.getOrDefault(self.stepSize)
        share, every = self.getOrDefault(self.subsample), self.getOrDefault(self.checkpointInterval)
        trees, tables = list(model.trees.trees) if model.trees else [], model.tables()
        weights = list(model.getOrDefault(model.weights))
        keyed = df.select(x, y, *([key] if share < 1.0 else []))
        data = model.copy({model.predictionCol: "_f"}).transform(keyed).persist()
        held, done = [data], len(trees)
        for t in range(done, done + rounds):
            rest = F.col(y) - F.col("_f")
            work = data.withColumns({"_r": rest, "_g": F.when(rest > 0, alpha).otherwise(alpha - 1.0)})
            bag = work
            if share < 1.0:
                bag = work.where(uniform(F.lit(self.getSeed()), F.lit(t), F.col(key)) < share)
            tree = self._tree(labelCol="_g", leafCol="_leaf", seed=self.getSeed() + t).fit(bag)
            tree = tree.setPredictionCol("")
            table = leaf_table(dict(exact_quantile(tree.transform(bag), "_r", alpha, "_leaf").collect()))
            trees.append(tree)
            tables.append(table)
            weights.append(step)
            value = F.array(*[F.lit(v) for v in table])[F.col("_leaf").cast("int")]
            data = tree.transform(data).withColumn("_f", F.col("_f") + F.lit(step) * value).drop("_leaf")
            if (t + 1) % every == 0:
                data = materialise(data)
                for old in held:
                    old.unpersist()
                held = []
            data = data.persist()
            held.append(data)
        for old in held:
            old.unpersist()
        out = LeafTableModel(trees, tables, weights, "sum", model.getOrDefault(model.base), x)
        return out._set(predictionCol=self.getPredictionCol())
