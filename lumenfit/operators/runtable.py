"""A registry of trained networks as a table, one row per run, and all of them scored in one pass (M-6, E-5, E-6, E-11).

A run is its path, which tells the share and seed of its split, the layout of its network and its flat weights. Scoring is one
job for a whole slice of runs: every task passes its rows through all networks of the slice in numpy, over Arrow batches, and
emits two rows of sums per run, which Spark adds up. Neither plan nor jobs grow with the runs, only the slices of weights do.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfit.functions import kernels
from lumenfit.operators.neural import NetworkModel, _features
from lumenfit.operators.splits import held_out, split_cuts
from lumenfit.session import materialise, ship_code
from lumenfit.sources import runs as names

RUN_SCHEMA = "path string, spec string, weights array<double>"
SCORE_SCHEMA = ("path string, n_train bigint, n_test bigint, train_r2_pct double, test_r2_pct double, "
                "chisq_train double, chisq_test double")
SLICE_BYTES = 64 << 20  # of weights sent to the tasks at a time
BLOCK_ROWS = 4096
SUMS = ("n", "sum_y", "sum_yy", "sse", "chisq")
PARTIAL = "run int, held boolean, " + ", ".join(f"{c} double" for c in SUMS)


def run_rows(spark: SparkSession, models: dict[str, NetworkModel]) -> DataFrame:
    """Trained networks by their paths as rows of a registry."""
    return spark.createDataFrame([(p, json.dumps(m.spec()), m.flat().tolist()) for p, m in models.items()], RUN_SCHEMA)


def store_runs(rows: DataFrame, table: str) -> None:
    """Append runs to a registry."""
    rows.select("path", "spec", "weights").write.mode("append").parquet(table)


def _slices(runs: DataFrame) -> Iterator[list]:
    """Runs in slices of about bounded weight, so that the driver holds one slice at a time."""
    held = materialise(runs.withColumn("_at", F.monotonically_increasing_id()))
    weight, n = held.agg(F.sum(8 * F.size("weights")), F.count(F.lit(1))).first()
    parts = min(n, max(1, -(-(weight or 0) // SLICE_BYTES)))
    place = F.pmod(F.xxhash64("_at"), F.lit(parts))
    for part in range(parts):
        rows = held.where(place == part).collect()
        if rows:
            yield [(r["path"], (r["test_size"], r["random_state"]), json.loads(r["spec"]), np.array(r["weights"])) for r in rows]


def score_runs(
    df: DataFrame, runs: DataFrame, features: str = "features", y: str = "flux", err: str = "fluxerr", key="idx"
) -> DataFrame:
    """One row per run: rows, R2 in percent and chi-square of the training and test rows that its path describes.

    ``runs`` has the columns of :data:`RUN_SCHEMA`; a run stored twice is scored twice. A path without test size or random
    state is an error. Rows without label, error or features take part in drawing splits but in no score. A part without
    rows has no R2 and a chi-square of zero; a constant label has no R2. ``key`` must be unique.
    """
    spark = df.sparkSession
    ship_code(spark)
    parsed = names.parse_run(runs.select("path", "spec", "weights"))
    lost = parsed.where("test_size is null or random_state is null").select("path").limit(3).collect()
    if lost:
        raise ValueError(f"no test size or random state: {[r[0] for r in lost]}")
    plans = [tuple(r) for r in parsed.select("test_size", "random_state").distinct().orderBy("test_size", "random_state").collect()]
    if not plans:
        return spark.createDataFrame([], SCORE_SCHEMA)
    x = _features(df, features)
    whole = F.col(y).isNotNull() & F.col(err).isNotNull() & F.col(features).isNotNull()
    out, centre = [], df.where(whole).agg(F.avg(y)).first()[0] or 0.0
    cuts = split_cuts(df, plans, key)
    rows = df.where(whole).select(
        x.alias("x"), (F.col(y).cast("double") - F.lit(centre)).alias("y"), F.col(err).cast("double").alias("err"),
        held_out(plans, cuts, key).alias("held"),
    )
    for part in _slices(parsed):
        nets = [(plans.index(split), spec, flat) for _, split, spec, flat in part]
        sums = rows.mapInArrow(_pass(nets, centre), PARTIAL).groupBy("run", "held").agg(*[F.sum(c).alias(c) for c in SUMS])
        out += _reports([p[0] for p in part], sums.collect())
    return spark.createDataFrame(out, SCORE_SCHEMA)


def _pass(nets: list, centre: float):
    """What a task does: the sums of every (run, part) over its rows."""

    def sums(batches):
        total = np.zeros((len(nets), 2, len(SUMS)))
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK_ROWS):
                b = batch.slice(first, BLOCK_ROWS)
                x, label, err = kernels.matrix(b.column("x")), b.column("y").to_numpy(), b.column("err").to_numpy()
                test = b.column("held").flatten().to_numpy(zero_copy_only=False).reshape(len(label), -1)
                parts = np.stack([~test, test]).astype(float)  # (part, row, split)
                moments = np.stack([np.ones(len(label)), label, label * label], axis=1)
                by_split = np.einsum("prs,rm->spm", parts, moments)
                for i, (split, spec, flat) in enumerate(nets):
                    off = (label + centre - kernels.forward(spec, flat, x)[0]) ** 2
                    total[i, :, :3] += by_split[split]
                    total[i, :, 3:] += parts[:, :, split] @ np.stack([off, off / (err * err)], axis=1)
        run, held = np.divmod(np.arange(2 * len(nets)), 2)
        flat_sums = total.reshape(-1, len(SUMS))
        columns = [pa.array(run, pa.int32()), pa.array(held == 1), *[pa.array(c) for c in flat_sums.T.copy()]]
        yield pa.RecordBatch.from_arrays(columns, ["run", "held", *SUMS])

    return sums


def _reports(paths: list[str], sums: list) -> list[tuple]:
    """Rows of :data:`SCORE_SCHEMA` from the sums of a slice."""
    found = {(r["run"], r["held"]): r for r in sums}

    def part(i: int, held: bool):
        r = found.get((i, held))
        if r is None or not r["n"]:
            return 0, None, 0.0
        spread = r["sum_yy"] - r["sum_y"] ** 2 / r["n"]
        return int(r["n"]), 100.0 * (1.0 - r["sse"] / spread) if spread > 0 else None, r["chisq"]

    out = []
    for i, path in enumerate(paths):
        (n_train, r2_train, chi_train), (n_test, r2_test, chi_test) = part(i, False), part(i, True)
        out.append((path, n_train, n_test, r2_train, r2_test, chi_train, chi_test))
    return out
