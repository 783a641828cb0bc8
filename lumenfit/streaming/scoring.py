"""New target files arrive; a frozen pipeline scores them (ST-1, ST-2).

Scoring is stateless, so no watermark is needed: each file is read once, scored and appended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfit import schema as sch
from lumenfit.sources.models import exists
from lumenfit.sources.tables import file_key


def stream_targets(
    spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType | None = None,
    max_files: int | None = None, exclude: str = "NALU",
) -> DataFrame:
    """A streaming read of target files with their ``file_key``, from the file name unless the schema has one.

    As in a batch read, files whose names contain ``exclude`` are skipped.
    """
    reader = spark.readStream.format(fmt).schema(schema or sch.TARGET_SCHEMA)
    if fmt == "csv":
        reader = reader.option("header", True)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    stream = reader.load(path)
    stream = stream.where(~F.col("_metadata.file_name").contains(exclude))
    return stream if "file_key" in stream.columns else stream.select("*", file_key().alias("file_key"))


def score_stream(stream: DataFrame, model, out: str, checkpoint: str, fmt: str = "parquet"):
    """ST-1: score what has arrived and append it; returns the started query.

    The checkpoint folder makes the sink exactly-once over restarts.
    """
    return (
        model.transform(stream)
        .writeStream.format(fmt)
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


SUMS = ("n", "sum_y", "sum_yy", "sse", "chisq")


def residual_stream(
    stream: DataFrame, model, out: str, checkpoint: str, y: str = "flux", err: str = "fluxerr"
):
    """ST-2: residual scores per file, as a streaming aggregation whose state is one row of sums per ``file_key``.

    Every micro-batch replaces the older of two folders under ``out`` by the totals of all files so far, so the table stays
    as large as the number of files, however many batches made it. The checkpoint folder holds the state: a restarted query
    goes on from it, and a replayed batch writes the same totals again. Rows without a label or a prediction do not count;
    a null ``file_key`` is a file of its own.
    """
    label, off = F.col(y), F.col(y) - F.col("prediction")
    scored = model.transform(stream).where(label.isNotNull() & F.col("prediction").isNotNull())
    totals = scored.groupBy("file_key").agg(
        F.count(F.lit(1)).alias("n"), F.sum(label).alias("sum_y"), F.sum(label * label).alias("sum_yy"),
        F.sum(off * off).alias("sse"), F.sum((off / F.col(err)) ** 2).alias("chisq"),
    )

    def replace(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/slot={batch_id % 2}")

    return (
        totals.writeStream.foreachBatch(replace)
        .outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_residuals(spark: SparkSession, out: str) -> DataFrame:
    """One row per file over all micro-batches: ``file_key, n, r2, chisq``.

    Only a folder whose write was committed is read, the newer one if both were.
    """
    slots = [f"{out}/slot={s}" for s in (0, 1) if exists(spark, f"{out}/slot={s}/_SUCCESS")]
    newest = {s: spark.read.parquet(s).agg(F.max("batch")).first()[0] for s in slots}
    written = [s for s in slots if newest[s] is not None]  # a batch without rows has no number
    sums = spark.read.parquet(max(written or slots, key=lambda s: newest[s] or 0)).select("file_key", *SUMS)
    spread = F.col("sum_yy") - F.col("sum_y") * F.col("sum_y") / F.col("n")
    return sums.select("file_key", "n", F.when(spread > 0, 1 - F.col("sse") / spread).alias("r2"), "chisq")
