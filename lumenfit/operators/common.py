"""Small helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfit.session import materialise


def as_list(by) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def sum_of(cols) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c) if isinstance(c, str) else c for c in cols])


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


BROADCAST_ROWS = 500_000  # a group-statistics row is about a hundred bytes


def join_stats(left: DataFrame, stats: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Put per-group statistics next to the rows of their group.

    The statistics are stored first, so their row count is known: up to :data:`BROADCAST_ROWS` they are
    broadcast and the rows, hot groups included, stay where they are. More groups than that go through an
    ordinary join, where AQE splits skewed partitions.
    """
    stats = materialise(stats)
    small = stats.count() <= BROADCAST_ROWS
    return join_on(left, F.broadcast(stats) if small else stats, keys, how)


ROWS_PER_PART = 100_000


def spread(df: DataFrame, key: str = "idx") -> DataFrame:
    """Rows dealt by a hash of the key into a number of partitions that depends on their count alone, and sorted there.

    Built-in tree fits draw bags and candidate splits per partition, in row order: dealt like this, a fit depends neither
    on the cores nor on how the input was partitioned.
    """
    parts = max(8, -(-df.count() // ROWS_PER_PART))
    return df.repartition(parts, key).sortWithinPartitions(key)


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that also matches null keys and keeps one copy of them."""
    names = {k: f"_r_{k}" for k in keys}
    right = right.withColumnsRenamed(names)
    cond = all_of([F.col(k).eqNullSafe(F.col(r)) for k, r in names.items()])
    return left.join(right, cond, how).drop(*names.values())


FEW_TASKS = 64


def sum_cells(parts: DataFrame, tasks: int | None = None) -> list[float]:
    """Add up the ``(pos, v)`` rows that tasks emit for one vector of sums.

    The vectors of a known handful of tasks are added here; more are summed by Spark first, so that the driver receives one
    number per position either way.
    """
    if tasks is None or tasks > FEW_TASKS:
        parts = parts.groupBy("pos").agg(F.sum("v").alias("v"))
    total: dict[int, float] = {}
    for pos, v in parts.collect():
        total[pos] = total.get(pos, 0.0) + v
    return [total[i] for i in range(len(total))]
