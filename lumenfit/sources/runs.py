"""The run registry: configuration and scores carried in path names (M-1 .. M-6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfit.operators.common import as_list

# The short name and type of each setting in a run's path.
RUN_FIELDS = {
    "n_nalu_layers": ("nnl", "int"),
    "n_nalu_neurons": ("nnn", "int"),
    "n_classes": ("nc", "int"),
    "batch_size": ("bs", "int"),
    "learning_rate": ("lr", "double"),
    "n_epochs": ("ne", "int"),
    "test_size": ("ts", "double"),
    "random_state": ("rs", "int"),
    "pre_process": ("PP", "boolean"),
    "pca_transform": ("PCA", "boolean"),
}
# The score fields of a checkpoint's file name.
CHECKPOINT_FIELDS = {
    "loss": r"_l([0-9.eE+-]+)_a",
    "accuracy": r"_a([0-9.eE+-]+)_BatchR2",
    "batch_r2": r"_BatchR2-([0-9.eE+-]+)_TestR2",
    "test_r2": r"_TestR2-([0-9.eE+-]+?)(?:\.ckpt.*)?$",
}


def compose_run(df: DataFrame, prefix: Column | str = "saves", name: str = "path") -> DataFrame:
    """M-1: the directory name of a run from its setting columns; booleans become 0 / 1.

    A ``warm_start`` column, where present and not null, is recorded as ``_WS<value>``.
    """
    head = F.lit(prefix) if isinstance(prefix, str) else prefix
    parts = [head]
    if "warm_start" in df.columns:
        parts.append(F.coalesce(F.concat(F.lit("_WS"), F.col("warm_start").cast("string")), F.lit("")))
    for field, (short, kind) in RUN_FIELDS.items():
        value = F.col(field)
        text = value.cast("int").cast("string") if kind == "boolean" else value.cast("string")
        parts += [F.lit(f"_{short}"), text]
    return df.withColumn(name, F.concat(*parts, F.lit("/")))


def _found(path: Column, pattern: str) -> Column:
    """The first group, or null where the pattern is absent."""
    hit = F.regexp_extract(path, pattern, 1)
    return F.when(hit != "", hit)


def parse_run(df: DataFrame, path: str = "path") -> DataFrame:
    """M-2: typed settings back from a run's path."""
    out = {}
    for field, (short, kind) in RUN_FIELDS.items():
        text = _found(F.col(path), f"_{short}([^_/]+)")
        out[field] = (text == "1") if kind == "boolean" else text.cast(kind)
    out["warm_start"] = _found(F.col(path), "_WS([^_/]+)")
    return df.withColumns(out)


def compose_checkpoint(df: DataFrame, run: Column | str = "", name: str = "path") -> DataFrame:
    """The file name of a checkpoint under its run's path, from ``epoch`` (null: the final one) and the score columns.

    :func:`parse_checkpoint` reads the same numbers back.
    """
    head = F.lit(run) if isinstance(run, str) else run
    epoch = F.coalesce(F.col("epoch").cast("int").cast("string"), F.lit("_FINAL"))
    scores = [F.lit("_l"), "loss", F.lit("_a"), "accuracy", F.lit("_BatchR2-"), "batch_r2", F.lit("_TestR2-"), "test_r2"]
    parts = [F.col(p).cast("double").cast("string") if isinstance(p, str) else p for p in scores]
    return df.withColumn(name, F.concat(head, F.lit("model_epoch"), epoch, *parts, F.lit(".ckpt")))


def parse_checkpoint(df: DataFrame, path: str = "path") -> DataFrame:
    """M-3: epoch (null for the final one) and scores from a checkpoint's file name."""
    out = {"epoch": _found(F.col(path), r"model_epoch([0-9]+)_").cast("int")}
    out["is_final"] = F.col(path).contains("model_epoch_FINAL")
    for field, pattern in CHECKPOINT_FIELDS.items():
        out[field] = _found(F.col(path), pattern).cast("double")
    return df.withColumns(out)


def parse_approach(df: DataFrame, path: str = "path") -> DataFrame:
    """M-4: the forest approach named in a save file, e.g. ``RFI_PCA`` of ``randForest_RFI_PCA_approach.save``."""
    parts = F.split(F.col(path), "_")
    second = F.when(parts[2] != "approach.save", F.concat(parts[1], F.lit("_"), parts[2]))
    return df.withColumn("rf_type", F.coalesce(second, parts[1]))


def default_neurons(df: DataFrame, n_features: int, col: str = "n_nalu_neurons") -> DataFrame:
    """M-5: zero neurons means one per feature."""
    return df.withColumn(col, F.when(F.col(col) > 0, F.col(col)).otherwise(F.lit(n_features)))


def best_run(df: DataFrame, metric: str = "test_r2", by=None, path: str = "path") -> DataFrame:
    """M-6: the run with the best score; of equal scores the one whose path sorts last."""
    order = F.struct(F.col(metric), F.col(path))
    return df.groupBy(*as_list(by)).agg(
        F.max_by(path, order).alias("best_path"), F.max(metric).alias(f"best_{metric}")
    )
