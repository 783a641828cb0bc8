"""Saving and loading fitted pipelines (S-10 .. S-12)."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import SparkSession


def save(model, path: str, overwrite: bool = True) -> None:
    """S-10: write a fitted stage or pipeline."""
    writer = model.write()
    (writer.overwrite() if overwrite else writer).save(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(sc._jsc.hadoopConfiguration()).exists(where)


def save_if_absent(model, path: str, spark: SparkSession) -> bool:
    """S-11: write only where nothing is stored yet; says whether it wrote."""
    if exists(spark, path):
        return False
    save(model, path, overwrite=False)
    return True


def load(path: str, spark: SparkSession):
    """S-12: read back whatever was saved; apply it with ``transform``, never refit."""
    metadata = DefaultParamsReader.loadMetadata(path, spark)
    if metadata["class"].endswith("PipelineModel"):
        return PipelineModel.load(path)
    return DefaultParamsReader.loadParamsInstance(path, spark)
