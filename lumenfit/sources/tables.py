"""Reading and writing calibration tables (S-1 .. S-9, S-13, S-14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfit import schema as sch
from lumenfit.operators.common import join_stats

# The feature variants a transform run stores.
VARIANTS = ["raw", "full_pipe", "standard", "pca_of_standard", "minmax", "minmax_of_pca"]


def read_calibration(
    spark: SparkSession, path, fmt: str = "csv", schema: T.StructType | None = None, file_order: bool = False
) -> DataFrame:
    """S-1: read wide calibration tables without a schema-inference pass.

    Spark rows have no order; ``file_order=True`` adds ``idx``, the row's position over all files.
    """
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).schema(schema or sch.RAW_SCHEMA)
    elif schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    return with_file_order(df) if file_order else df


def with_file_order(df: DataFrame, name: str = "idx") -> DataFrame:
    """Add the row's position in its files: file, then block, then place within the block.

    A scan numbers a block's rows consecutively, so a block's first number and size place all its rows. That is
    one small row per block; its count is checked before it is broadcast, and then no data row is shuffled.
    """
    placed = df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"),
    )
    blocks = placed.groupBy("_file", "_block").agg(
        F.count(F.lit(1)).alias("_size"), F.min("_seq").alias("_first")
    )
    before = Window.partitionBy(F.lit(0)).orderBy("_file", "_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = blocks.select(
        "_file", "_block", "_first", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")
    )
    return (
        join_stats(placed, starts, ["_file", "_block"])
        .withColumn(name, F.col("_start") + F.col("_seq") - F.col("_first"))
        .drop("_file", "_block", "_seq", "_start", "_first")
    )


def file_key(path_col="_metadata.file_path"):
    """The token after the last underscore of a file's name, up to its first dot."""
    name = F.element_at(F.split(F.col(path_col), "/"), -1)
    return F.split(F.element_at(F.split(name, "_"), -1), r"\.")[0]


def read_targets(
    spark: SparkSession, glob: str, fmt: str = "csv", schema: T.StructType | None = None,
    exclude: str = "NALU",
) -> DataFrame:
    """S-5: all target files of a glob with their ``file_key``; names containing ``exclude`` are skipped.

    The condition is on file metadata, so excluded files are dropped before they are opened.
    """
    df = read_calibration(spark, glob, fmt, schema or sch.TARGET_SCHEMA)
    return df.where(~F.col("_metadata.file_name").contains(exclude)).select(
        "*", file_key().alias("file_key")
    )


def variant_rows(df: DataFrame, vectors: dict[str, str], order: str = "idx") -> DataFrame:
    """One row per (row, variant) with the vector's elements as ``f0 .. f<n>``, in one pass over ``df``."""
    from pyspark.ml.functions import vector_to_array

    stacked = df.select(order, F.explode(F.array(*[
        F.struct(F.lit(v).alias("variant"), vector_to_array(F.col(c)).alias("x"))
        for v, c in vectors.items()
    ])).alias("r"))
    # The width is fixed by the pipeline; one vector is enough to read it.
    width = len(df.select(vector_to_array(F.col(next(iter(vectors.values()))))).first()[0])
    return stacked.select(
        order, F.col("r.variant").alias("variant"), *[F.col("r.x")[i].alias(f"f{i}") for i in range(width)]
    )


def write_variants(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S-6: store feature variants as one dataset partitioned by variant."""
    df.write.mode(mode).partitionBy("variant").parquet(path)


def load_features(
    spark: SparkSession, path: str, variant: str | None = None, pre_process: bool = False, pca: bool = False
) -> DataFrame:
    """S-3: one stored variant, by name or by flags; only its partition is read.

    ``idx`` stays, because rows meet their labels by key and not by position."""
    if variant is None:
        variant = {
            (False, False): "raw", (True, False): "minmax",
            (False, True): "pca_of_standard", (True, True): "full_pipe",
        }[(pre_process, pca)]
    return spark.read.parquet(path).where(F.col("variant") == variant).drop("variant")


def write_labels(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S-6: labels and errors, ``(idx, Flux, Flux_err)``."""
    labels(df).write.mode(mode).parquet(path)


def labels(df: DataFrame) -> DataFrame:
    return df.select("idx", F.col("flux").alias("Flux"), F.col("fluxerr").alias("Flux_err"))


def load_labels(spark: SparkSession, path: str) -> DataFrame:
    """S-4: stored labels and errors."""
    return spark.read.parquet(path).select("idx", "Flux", "Flux_err")


def prediction_table(df: DataFrame, pred: str = "prediction", name: str = "RF_Predict") -> DataFrame:
    """S-7: the published columns of a scored table."""
    return df.select("bmjd", "flux", "fluxerr", F.col(pred).alias(name))


def prediction_path(source: str, rf_type: str) -> str:
    """S-7: where the predictions for an input file go."""
    return source.replace(".csv", f"_{rf_type}_save.txt")


def write_predictions(df: DataFrame, path: str, pred: str = "prediction", mode: str = "overwrite") -> None:
    """S-7: predictions as CSV files."""
    prediction_table(df, pred).write.mode(mode).option("header", True).csv(path)


def write_bare_predictions(df: DataFrame, path: str | None, pred="prediction", mode="overwrite") -> bool:
    """S-8: only keys and predictions, and only when a place to save them is given."""
    if not path:
        return False
    df.select("idx", pred).write.mode(mode).option("header", True).csv(path)
    return True


def write_importances(imp: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S-9: feature importances (one row per feature)."""
    imp.write.mode(mode).parquet(path)


def read_importances(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_split(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S-13: which row went to which part, next to the model."""
    df.select("idx", "split").write.mode(mode).parquet(path)


def write_history(history: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S-14: the epoch history."""
    history.write.mode(mode).option("header", True).csv(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(sch.HISTORY_SCHEMA).csv(path)
