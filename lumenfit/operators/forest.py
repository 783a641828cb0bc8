"""Forests, importances and what is built on them (R-1 .. R-10, R-15, R-21, W-4 .. W-6, P-5)."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfit.operators import levelwise
from lumenfit.operators.common import as_list, spread
from lumenfit.operators.decompose import CenteredPCA, SymmetricICA, _stages
from lumenfit.operators.ensemble import EnsembleModel, LeafTableModel, tree_sum
from lumenfit.operators.scale import ColumnDropper, PopulationScaler, _InOut
from lumenfit.operators.splits import bootstrap_weights
from lumenfit.session import materialise


class SteadyForest(RandomForestRegressor):
    """The built-in forest on rows dealt by a hash, so that bags and trees do not depend on cores or input partitions.

    Rows are dealt by ``idx`` if the table has it, else by their features and label.
    """

    def _fit(self, df: DataFrame):
        cols = [self.getFeaturesCol(), self.getLabelCol()]
        if self.isSet(self.weightCol):
            cols.append(self.getWeightCol())
        key = F.col("idx") if "idx" in df.columns else F.xxhash64(*cols)
        return super()._fit(spread(df.select(*cols, key.alias("_key")), "_key").drop("_key"))


def forest(
    numTrees=100, maxDepth=30, subset="all", subsample=1.0, minInstances=1, seed=42,
    featuresCol="features", labelCol="flux", maxBins=32,
) -> RandomForestRegressor:
    """R-1 / R-6 / R-21: a configured built-in forest.

    Node ids are cached because deep trees would otherwise be walked from the root for every row and level.
    """
    return SteadyForest(
        numTrees=numTrees, maxDepth=maxDepth, featureSubsetStrategy=str(subset),
        subsamplingRate=subsample, minInstancesPerNode=minInstances, seed=seed, maxBins=maxBins,
        featuresCol=featuresCol, labelCol=labelCol, cacheNodeIds=maxDepth > 10,
    )


# --- importances -------------------------------------------------------------------------------------------


def importances(model, names: list[str], spark: SparkSession) -> DataFrame:
    """R-8: ``(feature, importance, std)``, the spread being over trees."""
    leaf = _stages(model)[-1]
    mean = leaf.featureImportances.toArray()
    per_tree = np.array([t.featureImportances.toArray() for t in leaf.trees])
    rows = [(n, float(m), float(s)) for n, m, s in zip(names, mean, per_tree.std(axis=0))]
    return spark.createDataFrame(rows, "feature string, importance double, std double")


def rank_importances(imp: DataFrame, by=None) -> DataFrame:
    """W-4: features from most to least important, ties by name, with their rank."""
    w = Window.partitionBy(*as_list(by) or [F.lit(0)]).orderBy(F.desc("importance"), "feature")
    return imp.withColumn("rank", F.row_number().over(w))


def select_k(imp: DataFrame, frac: float = 0.95, by=None) -> DataFrame:
    """W-5: rank, cumulative importance, and the smallest k whose cumulative importance reaches ``frac``.

    All features are kept when the total never reaches it.
    """
    group = Window.partitionBy(*as_list(by) or [F.lit(0)])
    upto = group.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    ranked = rank_importances(imp, by).withColumn("cumulative", F.sum("importance").over(upto))
    short = F.sum((F.col("cumulative") < frac).cast("bigint")).over(group)
    k = F.least(short + 1, F.count(F.lit(1)).over(group))
    return ranked.withColumn("k", k).withColumn("selected", F.col("rank") <= F.col("k"))


def slice_features(df: DataFrame, names: list[str], keep: list[str], vector="features", out="selected"):
    """W-6: the elements of a feature vector that belong to ``keep``, in that order."""
    return VectorSlicer(inputCol=vector, outputCol=out, indices=[names.index(n) for n in keep]).transform(df)


class ImportanceSelector(Estimator, _InOut, HasLabelCol, HasSeed):
    """Keep the features a forest finds most important (R-4's first half): W-4, W-5 and W-6 as one stage."""

    frac = Param(Params._dummy(), "frac", "share of importance to keep", TypeConverters.toFloat)
    numTrees = Param(Params._dummy(), "numTrees", "trees of the ranking forest", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of the ranking forest", TypeConverters.toInt)

    @keyword_only
    def __init__(
        self, *, inputCol="features", outputCol="selected", labelCol="flux", frac=0.95, numTrees=100,
        maxDepth=30, seed=42,
    ):
        super().__init__()
        self._setDefault(
            inputCol="features", outputCol="selected", labelCol="flux", frac=0.95, numTrees=100,
            maxDepth=30, seed=42,
        )
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> VectorSlicer:
        model = forest(
            numTrees=self.getOrDefault(self.numTrees), maxDepth=self.getOrDefault(self.maxDepth),
            seed=self.getSeed(), featuresCol=self.getInputCol(), labelCol=self.getLabelCol(),
        ).fit(df)
        d = model.numFeatures
        imp = importances(model, [f"{i:06d}" for i in range(d)], df.sparkSession)
        kept = select_k(imp, self.getOrDefault(self.frac)).where("selected").orderBy("rank")
        return VectorSlicer(
            inputCol=self.getInputCol(), outputCol=self.getOutputCol(),
            indices=[int(r["feature"]) for r in kept.collect()],
        )


APPROACHES = {
    "STD": [], "PCA": ["PCA"], "ICA": ["ICA"], "RFI": ["RFI"],
    "RFI_PCA": ["RFI", "PCA"], "RFI_ICA": ["RFI", "ICA"],
}


def approach(
    name: str, cols: list[str], regressor=None, standard: bool = True, labelCol="flux", seed=42,
    ranking_trees=100, ranking_depth=30, **forest_args,
) -> Pipeline:
    """R-1 .. R-5: assemble, scale, then PCA / ICA / importance selection as named, then a regressor."""
    stages = [VectorAssembler(inputCols=cols, outputCol="_x")]
    last, temps = "_x", ["_x"]
    if standard:
        stages.append(PopulationScaler(inputCol=last, outputCol="_xs"))
        last = "_xs"
        temps.append(last)
    for step in APPROACHES[name]:
        out = f"_x{step.lower()}"
        if step == "RFI":
            stages.append(ImportanceSelector(
                inputCol=last, outputCol=out, labelCol=labelCol, seed=seed,
                numTrees=ranking_trees, maxDepth=ranking_depth,
            ))
        elif step == "PCA":
            stages.append(CenteredPCA(inputCol=last, outputCol=out, whiten=True))
        else:
            stages.append(SymmetricICA(inputCol=last, outputCol=out, seed=seed))
        last = out
        temps.append(out)
    if regressor is None:
        regressor = forest(labelCol=labelCol, seed=seed, **forest_args)
    regressor = regressor.copy({regressor.featuresCol: last})
    return Pipeline(stages=[*stages, regressor, ColumnDropper(names=temps)])


# --- forests fitted tree by tree ---------------------------------------------------------------------------


class _TreeParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed,
                  DefaultParamsReadable, DefaultParamsWritable):
    numTrees = Param(Params._dummy(), "numTrees", "trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "largest depth", TypeConverters.toInt)
    minInstances = Param(Params._dummy(), "minInstances", "rows per leaf", TypeConverters.toInt)
    keyCol = Param(Params._dummy(), "keyCol", "unique row key", TypeConverters.toString)
    parallelism = Param(Params._dummy(), "parallelism", "trees fitted at once", TypeConverters.toInt)

    def _defaults(self, kwargs: dict, **more) -> None:
        base = dict(
            featuresCol="features", labelCol="flux", predictionCol="prediction", seed=42, numTrees=100,
            maxDepth=30, minInstances=1, keyCol="idx", parallelism=4,
        )
        self._setDefault(**{**base, **more})
        self._set(**kwargs)

    def _tree(self, **kw) -> DecisionTreeRegressor:
        depth = self.getOrDefault(self.maxDepth)
        return DecisionTreeRegressor(**{
            "featuresCol": self.getFeaturesCol(), "labelCol": self.getLabelCol(), "maxDepth": depth,
            "minInstancesPerNode": self.getOrDefault(self.minInstances), "seed": self.getSeed(),
            "cacheNodeIds": depth > 10, **kw,
        })


class OOBForest(Estimator, _TreeParams):
    """R-7: a bootstrap forest with its out-of-bag R2.

    Row weights per tree are Poisson(1) counts from a hash of (seed, row, tree), so which rows are out of a tree's bag is
    known without a second look. All trees grow together, level by level, on ``maxBins`` - 1 quantiles of each feature.
    """

    maxBins = Param(Params._dummy(), "maxBins", "parts that a feature's values are cut into", TypeConverters.toInt)

    @keyword_only
    def __init__(
        self, *, numTrees=100, maxDepth=6, minInstances=1, maxBins=32, featuresCol="features", labelCol="flux",
        predictionCol="prediction", keyCol="idx", seed=42,
    ):
        super().__init__()
        self._defaults(self._input_kwargs, maxDepth=6, maxBins=32)

    def _fit(self, df: DataFrame) -> EnsembleModel:
        n, x, y = self.getOrDefault(self.numTrees), self.getFeaturesCol(), self.getLabelCol()
        key = self.getOrDefault(self.keyCol)
        bags = bootstrap_weights(df.select(key, x, y), key, n, self.getSeed(), "_w")
        data, d, mean = levelwise.prepared(bags, x, y, "_w")
        try:
            cuts = levelwise.quantile_cuts(data, d, self.getOrDefault(self.maxBins) - 1)
            trees = levelwise.grow(
                data, d, n, self.getOrDefault(self.maxDepth), self.getOrDefault(self.minInstances), self.getSeed(), cuts
            )
            score = levelwise.out_of_bag_r2(data, trees, n)
        finally:
            data.unpersist()
        forest_model = levelwise.as_forest(df.sparkSession, trees, mean, d, x, "prediction")
        model = EnsembleModel([forest_model], "sum", score=math.nan if score is None else score)
        return model._set(predictionCol=self.getPredictionCol())


class ExtraTrees(Estimator, _TreeParams):
    """R-9: extremely randomised trees on all rows; every node draws one threshold per feature and keeps the best.

    Draws are digests of (seed, tree, node, feature), so trees depend on neither cores nor partitions.
    """

    @keyword_only
    def __init__(
        self, *, numTrees=100, maxDepth=10, minInstances=1, featuresCol="features", labelCol="flux",
        predictionCol="prediction", seed=42,
    ):
        super().__init__()
        self._defaults(self._input_kwargs, maxDepth=10)

    def _fit(self, df: DataFrame) -> RandomForestRegressionModel:
        n, x = self.getOrDefault(self.numTrees), self.getFeaturesCol()
        data, d, mean = levelwise.prepared(df, x, self.getLabelCol())
        try:
            depth, least = self.getOrDefault(self.maxDepth), self.getOrDefault(self.minInstances)
            trees = levelwise.grow(data, d, n, depth, least, self.getSeed())
        finally:
            data.unpersist()
        return levelwise.as_forest(df.sparkSession, trees, mean, d, x, self.getPredictionCol())


def leaf_table(found: dict[float, float]) -> list[float]:
    """Leaf values by leaf number; leaves that no row reached predict zero."""
    return [float(found.get(float(i), 0.0)) for i in range(int(max(found)) + 1)]


class AdaBoostR2(Estimator, _TreeParams):
    """R-10: AdaBoost.R2 with linear loss and a weighted-median prediction.

    Row weights live in a column. Each round is one tree fit and one aggregate; every ``checkpointInterval``
    rounds the weights are checkpointed so that the plan stays short and a lost executor costs few rounds.
    """

    checkpointInterval = Param(
        Params._dummy(), "checkpointInterval", "rounds between checkpoints", TypeConverters.toInt
    )

    @keyword_only
    def __init__(
        self, *, numTrees=50, maxDepth=3, minInstances=1, featuresCol="features", labelCol="flux",
        predictionCol="prediction", keyCol="idx", seed=42, parallelism=1, checkpointInterval=5,
    ):
        super().__init__()
        self._defaults(self._input_kwargs, numTrees=50, maxDepth=3, checkpointInterval=5)

    def _fit(self, df: DataFrame) -> LeafTableModel:
        x, y = self.getFeaturesCol(), self.getLabelCol()
        data = df.select(x, F.col(y).cast("double").alias(y)).withColumn("_w", F.lit(1.0)).persist()
        held, trees, tables, weights = [data], [], [], []
        n = data.count()
        for t in range(self.getOrDefault(self.numTrees)):
            tree = self._tree(weightCol="_w", leafCol="_leaf", seed=self.getSeed() + t).fit(data)
            scored = tree.transform(data).withColumn("_e", F.abs(F.col("prediction") - F.col(y)))
            # One row per leaf: its value, its largest error, its weighted error and its weight.
            leaves = scored.groupBy("_leaf").agg(
                F.max("prediction"), F.max("_e"), F.sum(F.col("_w") * F.col("_e")), F.sum("_w")
            ).collect()
            worst, mass = max(r[2] for r in leaves), sum(r[4] for r in leaves)
            loss = sum(r[3] for r in leaves) / (worst * mass) if worst else 0.0
            if loss >= 0.5 and trees:
                break
            beta = max(loss, 1e-12) / (1.0 - min(loss, 0.5))
            trees.append(tree)
            tables.append(leaf_table({r[0]: r[1] for r in leaves}))
            weights.append(max(-math.log(beta), 1e-12))
            if not worst or loss >= 0.5:
                break
            shrink = F.pow(F.lit(beta), 1.0 - F.col("_e") / F.lit(worst))
            data = scored.withColumn("_w", F.col("_w") * shrink).select(x, y, "_w")
            # Keep the mean weight at one, so that tiny weights do not vanish in the tree statistics.
            total = data.agg(F.sum("_w")).first()[0]
            data = data.withColumn("_w", F.col("_w") * F.lit(n / total))
            if (t + 1) % self.getOrDefault(self.checkpointInterval) == 0:
                data = materialise(data)
                for old in held:
                    old.unpersist()
                held = []
            data = data.persist()
            held.append(data)
        for old in held:
            old.unpersist()
        model = LeafTableModel(trees, tables, weights, "weighted_median", features=x)
        return model._set(predictionCol=self.getPredictionCol())


# --- resampled and resumed forests -------------------------------------------------------------------------


def per_draw(df: DataFrame, estimator: Estimator, by: str = "draw", parallelism: int = 2) -> EnsembleModel:
    """R-15: one fitted model per Monte-Carlo draw (see ``features.resample``), predictions averaged."""
    draws = sorted(r[0] for r in df.select(by).distinct().collect())
    df = df.persist()
    try:
        with ThreadPoolExecutor(parallelism) as pool:
            models = list(pool.map(lambda d: estimator.fit(df.where(F.col(by) == d)), draws))
    finally:
        df.unpersist()
    return EnsembleModel([_ending_in_model(m) for m in models], "mean")


def _ending_in_model(model):
    """A pipeline cut after its predictor (trailing clean-up stages write no prediction)."""
    if not isinstance(model, PipelineModel):
        return model
    stages = list(model.stages)
    while not stages[-1].hasParam("predictionCol"):
        stages.pop()
    return PipelineModel(stages)


def resume_forest(model, estimator: RandomForestRegressor, df: DataFrame, more: int) -> EnsembleModel:
    """R-14: ``more`` further trees next to those of a fitted forest."""
    grown = estimator.copy({estimator.numTrees: more, estimator.seed: estimator.getSeed() + 1}).fit(df)
    trees = [*model.trees, *grown.trees]
    return EnsembleModel([tree_sum(trees, [1.0 / len(trees)] * len(trees), model.getFeaturesCol())], "sum")
