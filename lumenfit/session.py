"""Session helpers: builder defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "lumenfit", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings this library is tested with.

    Shuffle partitions are left to the cluster's own setting; AQE coalesces them.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    ship_code(spark)
    return spark


_SHIPPED = "lumenfit-code.zip"


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors, once per context, so that Arrow tasks can import it there."""
    sc = spark.sparkContext
    if any(str(f).endswith(_SHIPPED) for f in sc.listFiles):
        return
    root = Path(__file__).resolve().parent
    if not root.is_dir():  # runs from an archive that was shipped already
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="lumenfit-code-"), _SHIPPED)
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for f in sorted(root.rglob("*.py")):
            out.write(f, f.relative_to(root.parent))
    sc.addPyFile(archive)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder reliable checkpoints and intermediate tables go to.

    A cluster names a shared folder in ``spark.checkpoint.dir``. Only a local master, where one machine
    runs every task, may fall back to a temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lumenfit-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path for an intermediate table, under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, which outlives the executors that wrote it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialise_for_passes(df: DataFrame) -> DataFrame:
    """A checkpointed and cached table for algorithms that read it many times.

    Passes read the cache; an executor lost with its cached blocks is replaced from the checkpoint, with the
    same rows in the same partitions, and no pass plans the upstream query again.
    """
    return materialise(df).persist()
