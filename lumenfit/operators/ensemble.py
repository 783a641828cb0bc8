"""One fitted model made of many: the shared result type of the custom forests and boosters."""

from __future__ import annotations

import os

from pyspark import SparkContext
from pyspark.ml import Model, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasPredictionCol
from pyspark.ml.regression import GBTRegressionModel
from pyspark.ml.util import (
    DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def predict_as(member, df: DataFrame, name: str) -> DataFrame:
    """Apply a member, a model or a pipeline of stages ending in one, writing its prediction to ``name``."""
    before, keep = [], df.columns
    if isinstance(member, PipelineModel):
        *before, member = member.stages
    for stage in before:
        df = stage.transform(df)
    out = member.copy({member.getParam("predictionCol"): name}).transform(df)
    return out.select(*keep, name) if before else out


def tree_sum(trees: list, weights: list[float], features: str) -> GBTRegressionModel:
    """Fitted trees over the same features as one built-in model predicting their weighted sum.

    Spark's boosted-tree model is such a sum and has a public constructor, so a thousand trees are one function
    call per row and one node of the plan, instead of a thousand chained transformations.
    """
    sc = SparkContext.getOrCreate()
    ml = sc._jvm.org.apache.spark.ml
    parts = sc._gateway.new_array(ml.regression.DecisionTreeRegressionModel, len(trees))
    scale = sc._gateway.new_array(sc._jvm.double, len(trees))
    for i, (tree, w) in enumerate(zip(trees, weights)):
        parts[i], scale[i] = tree._java_obj, float(w)
    uid = ml.util.Identifiable.randomUID("treesum")
    model = GBTRegressionModel(ml.regression.GBTRegressionModel(uid, parts, scale))
    return model.setFeaturesCol(features)


class LeafTableModel(Model, HasPredictionCol, MLReadable, MLWritable):
    """Trees whose leaves carry values of their own, combined by weighted ``sum`` or ``weighted_median``.

    The built-in model reports the leaf a row reaches in every tree at once; the prediction is a lookup per tree
    and a fold over them, all built-in expressions.
    """

    combine = Param(Params._dummy(), "combine", "sum or weighted_median", TypeConverters.toString)
    weights = Param(Params._dummy(), "weights", "weight per tree", TypeConverters.toListFloat)
    base = Param(Params._dummy(), "base", "added to a sum", TypeConverters.toFloat)
    values = Param(Params._dummy(), "values", "leaf values, tree after tree", TypeConverters.toListFloat)
    leaves = Param(Params._dummy(), "leaves", "leaves per tree", TypeConverters.toListInt)

    def __init__(self, trees=None, tables=None, weights=None, combine="sum", base=0.0, features="features"):
        super().__init__()
        self.trees = tree_sum(trees, [1.0] * len(trees), features) if trees else None
        self._setDefault(predictionCol="prediction")
        self._set(
            combine=combine, base=float(base), weights=[float(w) for w in weights or []],
            values=[float(v) for t in tables or [] for v in t], leaves=[len(t) for t in tables or []],
        )

    def tables(self) -> list[list[float]]:
        values, out, at = self.getOrDefault(self.values), [], 0
        for n in self.getOrDefault(self.leaves):
            out.append(values[at:at + n])
            at += n
        return out

    def _transform(self, df: DataFrame) -> DataFrame:
        out, base = self.getPredictionCol(), F.lit(self.getOrDefault(self.base))
        if self.trees is None:
            return df.withColumn(out, base)
        text = ", ".join("array(" + ", ".join(f"{v!r}D" for v in t) + ")" for t in self.tables())
        reached = self.trees.setLeafCol("_leaves").setPredictionCol("").transform(df)
        leaf = vector_to_array(F.col("_leaves")).cast("array<int>")
        found = F.zip_with(F.expr(f"array({text})"), leaf, lambda table, i: table[i])
        weights = F.expr("array(" + ", ".join(f"{w!r}D" for w in self.getOrDefault(self.weights)) + ")")
        if self.getOrDefault(self.combine) == "sum":
            terms = F.zip_with(found, weights, lambda v, w: v * w)
            return reached.withColumn(out, F.aggregate(terms, base, lambda a, v: a + v)).drop("_leaves")
        pairs = F.arrays_zip(found.alias("p"), weights.alias("w"))
        total = sum(self.getOrDefault(self.weights))
        return reached.withColumn(out, weighted_median(pairs, total)).drop("_leaves")

    def copy(self, extra=None):
        that = super().copy(extra)
        that.trees = self.trees
        return that

    def write(self) -> "EnsembleWriter":
        return EnsembleWriter(self, [self.trees] if self.trees else [])

    @classmethod
    def read(cls) -> "EnsembleReader":
        return EnsembleReader(cls)

    def _restore(self, members: list) -> None:
        self.trees = members[0] if members else None


def weighted_median(pairs: Column, total: float) -> Column:
    """The smallest ``p`` of an array of (p, w) at which half the total weight is reached."""
    half = F.lit(total / 2.0 * (1.0 - 1e-12))
    start = F.struct(F.lit(0.0).alias("seen"), F.lit(None).cast("double").alias("at"))

    def step(acc: Column, pair: Column) -> Column:
        seen = acc["seen"] + pair["w"]
        return F.struct(seen.alias("seen"), F.coalesce(acc["at"], F.when(seen >= half, pair["p"])).alias("at"))

    return F.aggregate(F.array_sort(pairs), start, step)["at"]


class EnsembleModel(Model, HasPredictionCol, MLReadable, MLWritable):
    """A few fitted models combined by weighted ``mean`` or by weighted ``sum`` plus ``base``.

    Members are chained, one plan node each; trees over common features belong in :func:`tree_sum`.
    """

    combine = Param(Params._dummy(), "combine", "mean or sum", TypeConverters.toString)
    weights = Param(Params._dummy(), "weights", "weight per member", TypeConverters.toListFloat)
    base = Param(Params._dummy(), "base", "added to a sum", TypeConverters.toFloat)
    score = Param(Params._dummy(), "score", "out-of-bag score", TypeConverters.toFloat)

    def __init__(self, members=None, combine="mean", weights=None, base=0.0, score=float("nan")):
        super().__init__()
        self.members = list(members or [])
        self._setDefault(predictionCol="prediction")
        self._set(
            combine=combine, base=float(base), score=float(score),
            weights=[float(w) for w in (weights or [1.0] * len(self.members))],
        )

    @property
    def oob_score_(self) -> float:
        return self.getOrDefault(self.score)

    def _transform(self, df: DataFrame) -> DataFrame:
        weights, keep = self.getOrDefault(self.weights), df.columns
        mean = self.getOrDefault(self.combine) == "mean"
        total = sum(weights) if mean else 1.0
        out = F.lit(0.0 if mean else self.getOrDefault(self.base))
        for i, (member, w) in enumerate(zip(self.members, weights)):
            df = predict_as(member, df, f"_m{i}")
            out = out + F.lit(w / total) * F.col(f"_m{i}")
        return df.select(*keep, out.alias(self.getPredictionCol()))

    def copy(self, extra=None):
        that = super().copy(extra)
        that.members = self.members
        return that

    def write(self) -> "EnsembleWriter":
        return EnsembleWriter(self, self.members)

    @classmethod
    def read(cls) -> "EnsembleReader":
        return EnsembleReader(cls)

    def _restore(self, members: list) -> None:
        self.members = members


class EnsembleWriter(MLWriter):
    """Metadata next to one folder per member, on any Hadoop file system."""

    def __init__(self, instance, members: list):
        super().__init__()
        self.instance, self.members = instance, members

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(
            self.instance, path, self.sparkSession, extraMetadata={"members": len(self.members)}
        )
        for i, member in enumerate(self.members):
            member.write().save(os.path.join(path, "members", f"{i:05d}"))


class EnsembleReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls()
        model._restore([
            DefaultParamsReader.loadParamsInstance(
                os.path.join(path, "members", f"{i:05d}"), self.sparkSession
            )
            for i in range(metadata["members"])
        ])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
