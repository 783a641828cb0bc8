"""Hyper-parameter search and comparison of approaches (H-1 .. H-4, E-11, R-22, R-23)."""

from __future__ import annotations

import itertools
import time
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark.ml import Estimator
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lumenfit.operators.ensemble import predict_as
from lumenfit.operators.forest import approach
from lumenfit.operators.metrics import chi_expr, fit_report, r2_expr
from lumenfit.operators.splits import hash_folds, hash_split
from lumenfit.session import ensure_checkpoint_dir
from lumenfit.sources import models, runs

# The boosted-tree search space.
BOOST_GRID = {
    "maxDepth": list(range(2, 15)),
    "maxIter": [b * 10**p for b in (1, 2, 5) for p in range(1, 5)],
    "stepSize": [b * 10.0**p for b in (1, 2, 5) for p in range(-4, 0)],
}


def neg_rmse(label: str, pred: str) -> Column:
    e = F.col(label) - F.col(pred)
    return -F.sqrt(F.avg(e * e))


SCORERS = {"neg_rmse": neg_rmse, "r2": r2_expr}


def grid(**lists) -> list[dict]:
    """H-1: every combination of the given values, as parameter dicts."""
    names = list(lists)
    return [dict(zip(names, values)) for values in itertools.product(*lists.values())]


def rescore(spark: SparkSession, root: str, path: str, df: DataFrame, y="flux", err="fluxerr", key="idx") -> DataFrame:
    """A stored run scored again from its path: one row of R2 and chi-square on the split the path describes.

    Share and seed of the split come from the path, the model is loaded from ``root/path`` and never refitted. A run that
    was stored without them is an error.
    """
    config = runs.parse_run(spark.createDataFrame([(path,)], "path string")).first()
    if config["test_size"] is None or config["random_state"] is None:
        raise ValueError(f"{path}: no test size or random state")
    rows = hash_split(df, key, config["test_size"], config["random_state"])
    scored = models.load(f"{root.rstrip('/')}/{path.strip('/')}", spark).transform(rows)
    off = chi_expr(y, "prediction", err)
    parts = [F.sum(F.when(F.col("split") == part, off)).alias(f"chisq_{part}") for part in ("train", "test")]
    whole = scored.withColumn("path", F.lit(path))
    return fit_report(whole, y, err=err, by="path").join(whole.groupBy("path").agg(*parts), "path")


def rescore_all(spark: SparkSession, root: str, paths: list[str], df: DataFrame, **columns) -> DataFrame:
    """:func:`rescore` of every run of a registry, one row each."""
    return reduce(DataFrame.unionByName, [rescore(spark, root, p, df, **columns) for p in paths])


def _params(estimator: Estimator, chosen: dict) -> dict:
    return {estimator.getParam(k): v for k, v in chosen.items()}


def random_search(
    df: DataFrame, estimator: Estimator, space: list[dict], n: int = 100, k: int = 10, scorers=None,
    seed: int = 42, key="idx", label: str = "flux", parallelism: int = 4,
) -> DataFrame:
    """H-2: ``n`` random settings, each cross-validated on ``k`` hash folds, without a refit.

    Returns one row per (setting, fold) with test and train value of every scorer and the seconds taken.
    """
    scorers = scorers or SCORERS
    ensure_checkpoint_dir(df.sparkSession)
    rng = np.random.default_rng(seed)
    picked = [space[i] for i in rng.choice(len(space), size=min(n, len(space)), replace=False)]
    folded = hash_folds(df, key, k, seed).persist()

    def one(job):
        number, fold = job
        started = time.monotonic()
        train = folded.where(F.col("fold") != fold)
        model = estimator.copy(_params(estimator, picked[number])).fit(train)
        scored = predict_as(model, folded, "_p")
        parts = scored.groupBy((F.col("fold") == fold).alias("held")).agg(
            *[fn(label, "_p").alias(name) for name, fn in scorers.items()]
        )
        values = {
            f"{'' if r['held'] else 'train_'}{name}": float(r[name])
            for r in parts.collect() for name in scorers
        }
        return {
            "setting": number, "fold": fold, **picked[number],
            **{f"{p}{s}": values[f"{p}{s}"] for s in scorers for p in ("", "train_")},
            "seconds": time.monotonic() - started,
        }

    try:
        with ThreadPoolExecutor(parallelism) as pool:
            rows = list(pool.map(one, itertools.product(range(len(picked)), range(k))))
    finally:
        folded.unpersist()
    return df.sparkSession.createDataFrame([Row(**r) for r in rows])


def search_summary(results: DataFrame, by_params: list[str], metric: str = "r2") -> DataFrame:
    """Mean and spread of a score over the folds of each setting, best first."""
    return (
        results.groupBy("setting", *by_params)
        .agg(F.avg(metric).alias(f"mean_{metric}"), F.stddev_pop(metric).alias(f"std_{metric}"))
        .orderBy(F.desc(f"mean_{metric}"), "setting")
    )


def holdout(
    df: DataFrame, estimator: Estimator, test_size: float = 0.25, key="idx", label="flux", seed=42
) -> tuple[object, DataFrame]:
    """H-3: fit on the training part of a fixed split; returns the model and its report row (E-11)."""
    ensure_checkpoint_dir(df.sparkSession)
    parts = df if "split" in df.columns else hash_split(df, key, test_size, seed)
    model = estimator.fit(parts.where("split = 'train'"))
    return model, fit_report(model.transform(parts), label)


def compare_approaches(
    df: DataFrame, cols: list[str], names=("STD", "PCA", "ICA", "RFI"), test_size=0.25, key="idx",
    label="flux", seed=42, extra: dict | None = None, **forest_args,
) -> DataFrame:
    """H-4: one report row per approach; ``extra`` adds named estimators (e.g. boosting) on the same split."""
    parts = hash_split(df, key, test_size, seed).persist()
    estimators = {n: approach(n, cols, labelCol=label, seed=seed, **forest_args) for n in names}
    estimators.update(extra or {})
    try:
        rows = []
        for name, est in estimators.items():
            _, report = holdout(parts, est, key=key, label=label)
            rows.append((name, *report.first()))
        fields = "approach string, n_train bigint, n_test bigint, train_r2_pct double, test_r2_pct double"
        return df.sparkSession.createDataFrame(rows, fields)
    finally:
        parts.unpersist()


def score(model, df: DataFrame, by=None, name: str = "prediction") -> DataFrame:
    """R-22 / R-23: append a saved model's prediction; files are told apart by a ``file_key`` column."""
    out = model.transform(df)
    return out if name == "prediction" else out.withColumnRenamed("prediction", name)
