"""Exact medians and quantiles that do not hold a group in one buffer (E-21).

``median()`` keeps every distinct value of a group in a single aggregation buffer. Beyond a row count where that
is safe, sampled quantiles bracket the wanted ranks first and only rows inside the bracket are sorted. The
bracket is checked by counting, so the sample affects speed only.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfit.operators.common import BROADCAST_ROWS, as_list, join_on
from lumenfit.operators.index import sampled_quantiles, with_order_buckets
from lumenfit.session import materialise

SMALL = 500_000
MOST_BUCKETS = 256  # that groups' values are dealt to: their edges and tasks stay few whatever the rows


def _values(df: DataFrame, col: str, by: list[str]) -> DataFrame:
    """The column as a double next to the group keys, NaN made null.

    Nulls are skipped by the aggregates below rather than filtered: a null filter on a long derived expression
    makes the optimizer infer constraints for every part of it.
    """
    v = F.col(col).cast("double")
    return df.select(*by, F.when(~F.isnan(v), v).alias("_v"))


def _ranks(n: int, p: float) -> tuple[int, int, float]:
    """The two 0-based ranks whose linear interpolation is the quantile, and the weight of the second."""
    position = p * (n - 1)
    low = math.floor(position)
    return low, min(low + 1, n - 1), position - low


def exact_quantile_value(df: DataFrame, col: str, p: float = 0.5, small: int = SMALL) -> float:
    """The exact quantile of a column (linear interpolation) as a number on the driver."""
    vals = _values(df, col, [])
    n = vals.agg(F.count("_v")).first()[0]
    if n <= small:
        value = vals.agg(F.percentile("_v", F.lit(p))).first()[0]
        return math.nan if value is None else float(value)
    vals = materialise(vals)  # one column, read several times below
    low, high, weight = _ranks(n, p)
    first = _value_at(vals, low, n, small)
    if weight == 0 or high == low:
        return first
    upto, following = vals.agg(
        F.count_if(F.col("_v") <= first), F.min(F.when(F.col("_v") > first, F.col("_v")))
    ).first()
    second = first if upto > high else following
    return float(first + (second - first) * weight)


def _value_at(vals: DataFrame, rank: int, n: int, small: int) -> float:
    """The value with ``rank`` values before it in sorted order.

    Each round brackets the rank between two data values and continues strictly between them, so ties on a
    bound, however many, are settled by counting.
    """
    below, inside, rows, reach = 0, n, vals, 0.003
    v = F.col("_v")
    while inside > small:
        at = (rank - below) / inside
        probs = [max(0.0, at - reach), min(1.0, at + reach)]
        lo, hi = sampled_quantiles(rows, v, inside, probs)
        lo = -math.inf if probs[0] == 0.0 else lo
        hi = math.inf if probs[1] == 1.0 else hi
        under, on_lo, between, on_hi = rows.agg(
            F.count_if(v < lo), F.count_if(v == lo), F.count_if((v > lo) & (v < hi)),
            F.count_if((v == hi) & (v > lo)),
        ).first()
        r = rank - below
        if not under <= r < under + on_lo + between + on_hi:
            reach *= 4
            continue
        if r < under + on_lo:
            return float(lo)
        if r >= under + on_lo + between:
            return float(hi)
        below, inside, reach = below + under + on_lo, between, 0.003
        rows = vals.where((v > lo) & (v < hi))
    return float(rows.orderBy("_v").offset(rank - below).limit(1).first()["_v"])


def median_value(df: DataFrame, col: str, small: int = SMALL) -> float:
    """The exact median of a column as a number on the driver."""
    return exact_quantile_value(df, col, 0.5, small)


def exact_median(
    df: DataFrame, col: str, by=None, name: str = "median", small: int = SMALL
) -> DataFrame:
    """E-21: the exact median per group (one row when ``by`` is None)."""
    return exact_quantile(df, col, 0.5, by, name, small)


def exact_quantile(
    df: DataFrame, col: str, p: float, by=None, name: str = "quantile", small: int = SMALL
) -> DataFrame:
    """The exact quantile (linear interpolation) per group, of any number of groups at once.

    Up to ``small`` rows in all, the built-in aggregate is used. Beyond that distinct values are counted per group,
    so that ties cost nothing, and dealt by range of (group, value) into buckets: a group's counts per bucket say
    which bucket holds its two ranks, and only values of that bucket are ordered. Beyond :data:`MOST_BUCKETS` of ``small``
    rows buckets grow with the table; a task sorts its bucket with spilling, and none is held in memory.
    """
    by = as_list(by)
    vals = _values(df, col, by)
    n = vals.agg(F.count("_v")).first()[0]
    if n <= small:
        return vals.groupBy(*by).agg(F.percentile("_v", F.lit(p)).alias(name))
    if not by:
        value = exact_quantile_value(df, col, p, small)
        return df.sparkSession.createDataFrame([(value,)], f"{name} double")

    tally = vals.where("_v is not null").groupBy(*by, "_v").agg(F.count("_v").alias("_c"))
    cut, buckets = with_order_buckets(tally, [*by, "_v"], max(small, -(-n // MOST_BUCKETS)), n)
    cut = cut if buckets else cut.withColumn("_bucket", F.lit(0))
    group = Window.partitionBy(*by)
    upto = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    sizes = cut.groupBy(*by, "_bucket").agg(F.sum("_c").alias("_size"))
    wanted = materialise(
        sizes.withColumns({"_end": F.sum("_size").over(upto), "_n": F.sum("_size").over(group)})
        .withColumns({
            "_start": F.col("_end") - F.col("_size"),
            "_low": F.floor((F.col("_n") - 1) * F.lit(p)),
            "_share": (F.col("_n") - 1) * F.lit(p) - F.floor((F.col("_n") - 1) * F.lit(p)),
        })
        .withColumn("_high", F.least(F.col("_low") + 1, F.col("_n") - 1))
        .where("_start <= _high and _end > _low")
        .select(*by, "_bucket", "_start", "_low", "_high", "_share")
    )
    keys = [*by, "_bucket"]
    # Two rows per group at most: if they are few, the other buckets' rows never leave their task.
    found = join_on(cut, F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, keys)
    inside = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    return (
        found.withColumn("_to", F.col("_start") + F.sum("_c").over(inside))
        .withColumn("_from", F.col("_to") - F.col("_c"))
        .where("(_from <= _low and _to > _low) or (_from <= _high and _to > _high)")
        .groupBy(*by)
        .agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"), F.first("_share").alias("_share"))
        .select(*by, F.when(F.col("_a") == F.col("_b"), F.col("_a"))
                .otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_share")).alias(name))
    )
