"""Order-dependent operators without a global single-task sort (W-1, W-2, W-3, W-7).

A window without PARTITION BY sends every row to one task. Here the rows are dealt by range over all order columns into
buckets of bounded size and stored, so that a bucket's rows stay the same however often they are read; the window runs
inside buckets, and what crosses a bucket edge (row offsets, the last value before the edge) is a per-bucket aggregate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfit.operators.common import as_list, join_on, join_stats
from lumenfit.session import materialise

ROWS_PER_BUCKET = 1_000_000
SAMPLE_ROWS = 1 << 20


def sampled_quantiles(df: DataFrame, col: Column, n: int, probs: list[float]) -> list[float]:
    """Quantiles of a sample of bounded size, so its sketch fits one reducer whatever ``n`` is."""
    seen = df.sample(fraction=SAMPLE_ROWS / n, seed=7) if n > 2 * SAMPLE_ROWS else df
    accuracy = max(10_000, 10 * len(probs))
    return list(seen.agg(F.percentile_approx(col, probs, accuracy)).first()[0] or [])


def with_order_buckets(
    df: DataFrame, order, rows_per_bucket: int = ROWS_PER_BUCKET, rows: int | None = None
) -> tuple[DataFrame, list[str]]:
    """Add a bucket column that follows the order ``order`` (columns of any sortable type, together unique).

    No column is added when one bucket holds all rows. Otherwise there are half as many more buckets than needed, so that
    sampled edges leave none much above ``rows_per_bucket``. Edges are tuples of all order columns: however many rows tie
    on the leading columns, or have null there, the following columns cut them.
    """
    order = as_list(order)
    n = df.count() if rows is None else rows
    if n <= rows_per_bucket:
        return df, []
    buckets = math.ceil(1.5 * n / rows_per_bucket)
    dealt = df.repartitionByRange(buckets, *order).withColumn("_bucket", F.spark_partition_id())
    return materialise(dealt), ["_bucket"]


def with_dense_index(
    df: DataFrame, order, name: str = "rn", rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """W-2: add the 0-based position of each row in the given order."""
    keyed, buckets = with_order_buckets(df, order, rows_per_bucket)
    w = Window.partitionBy(*buckets or [F.lit(0)]).orderBy(*as_list(order))
    local = F.row_number().over(w).cast("bigint") - 1
    if not buckets:
        return df.withColumn(name, local)
    before = Window.partitionBy().orderBy(*buckets).rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    sizes = keyed.groupBy(*buckets).agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select(*buckets, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return (
        join_stats(keyed.withColumn("_local", local), offsets, buckets)
        .withColumn(name, F.col("_local") + F.col("_offset"))
        .drop(*buckets, "_local", "_offset")
    )


def lag_diff(
    df: DataFrame, col: str, order="idx", name: str | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """W-1: add ``col`` minus its value on the previous row in the given order (null on the first row)."""
    name = name or f"{col}_diff"
    order = as_list(order)
    keyed, buckets = with_order_buckets(df, order, rows_per_bucket)
    w = Window.partitionBy(*buckets or [F.lit(0)]).orderBy(*order)
    previous = F.lag(col).over(w)
    if not buckets:
        return df.withColumn(name, F.col(col) - previous)
    last = keyed.groupBy(*buckets).agg(F.max_by(F.col(col), F.struct(*order)).alias("_last"))
    before = Window.partitionBy().orderBy(*buckets)  # a row per bucket
    carried = last.select(*buckets, F.lag("_last").over(before).alias("_carry"))
    first = F.row_number().over(w) == 1
    return (
        join_stats(keyed.withColumns({"_prev": previous, "_first": first}), carried, buckets)
        .withColumn(
            name,
            F.col(col) - F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_prev")),
        )
        .drop(*buckets, "_prev", "_first", "_carry")
    )


def time_span(df: DataFrame, col: str = "bmjd", order="idx") -> DataFrame:
    """W-3: one row with the minimum, maximum, range and smallest step of a time column."""
    return lag_diff(df, col, order, "_step").agg(
        F.min(col).alias("t_min"),
        F.max(col).alias("t_max"),
        (F.max(col) - F.min(col)).alias("t_range"),
        F.min("_step").alias("min_step"),
        F.count(F.lit(1)).alias("n"),
    )


def running_best(
    history: DataFrame, metric: str, by=None, epoch: str = "epoch",
    start: float = -math.inf, chunk: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """W-7: add the running maximum of ``metric`` and whether the row sets or ties the record.

    Epochs are cut into chunks; the best of all earlier chunks is joined back, so one very long run is not
    one task. A record must also reach ``start``.
    """
    by = as_list(by)
    h = history.withColumn("_chunk", F.floor(F.col(epoch) / F.lit(chunk)))
    tops = h.groupBy(*by, "_chunk").agg(F.max(metric).alias("_top"))
    before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*by, "_chunk", F.max("_top").over(before).alias("_before"))
    inside = Window.partitionBy(*by, "_chunk").orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("_inside", F.max(metric).over(inside))
    best = F.greatest("_inside", "_before", F.lit(float(start)))
    return (
        join_on(h, tops, [*by, "_chunk"])
        .withColumn("best", best)
        .withColumn("is_record", F.col(metric) >= F.col("best"))
        .drop("_chunk", "_inside", "_before")
    )
