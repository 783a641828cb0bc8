"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfit.session import scratch_path, ship_code

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOT_PARTS = 1024  # a key with more than 1/1024 of all rows is hot, so there are fewer than 1024 hot keys


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def write_scratch(df: DataFrame, tag: str) -> DataFrame:
    """The rows written once as Parquet in the shared checkpoint folder and read from there.

    Later plans scan only the columns they need, and a lost executor costs a file read, not the work before it.
    """
    ship_code(df.sparkSession)
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Text that is all ASCII takes the byte-wise path, with the same answer."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def crc_fold(key: Column, parts: int) -> Column:
    """``crc32`` of the key's text modulo ``parts``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(parts)


def held_out(key: Column, parts: int, fold: int) -> Column:
    """Whether the key falls into the held-out fold; a null key does not."""
    return F.coalesce(crc_fold(key, parts) == fold, F.lit(False))


def hash_sample(rows: DataFrame, key: str, bound: int, by: str | None = None, seed: int = 0) -> DataFrame:
    """All rows if there are at most ``bound``, else about ``bound`` of them, chosen by a hash of the key.

    With ``by``, a column of few values, that holds for the rows of each value. The choice does not depend on
    partitioning. Copies of a key are chosen together.
    """
    whole = 1 << 32
    group = F.col(by) if by else F.lit(0)
    counts = rows.groupBy(group.alias("value")).count().collect()
    limits = [(r["value"], int(bound / r["count"] * whole)) for r in counts if r["count"] > bound]
    if not limits:
        return rows
    limit = F.lit(whole)
    for value, most in limits:
        limit = F.when(group.eqNullSafe(F.lit(value)), most).otherwise(limit)
    return rows.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(whole)) < limit)


def with_group(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str, total: int) -> DataFrame:
    """Inner join of rows with one row per key, where a key may hold any share of the rows.

    ``groups`` has the number of rows of each key in ``size``. Keys of more than ``total / HOT_PARTS`` rows, fewer than
    HOT_PARTS in all, are broadcast, so their rows stay where they are; all other keys meet by sort-merge join in groups
    that are at most that large. Null keys do not match.
    """
    limit = total // HOT_PARTS
    hot = groups.where(F.col(size) > limit)
    cold = groups.where(F.col(size) <= limit)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold.hint("merge"), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


BROADCAST_ROWS = 500_000  # rows of a few short columns: some tens of MB


def few(rows: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table of narrow rows, marked for broadcast if it has at most ``bound`` rows; else joins shuffle."""
    return F.broadcast(rows) if rows.count() <= bound else rows


def write_bucketed(rows: DataFrame, path: str, keys: list[str], buckets: int) -> tuple[str, DataFrame]:
    """The rows stored under ``path``, one sorted file per bucket of the keys; joins on the keys need no shuffle.

    The catalogue knows them by the name that comes back first, until :func:`forget`; the files stay.
    """
    name = f"bucketed_{uuid.uuid4().hex}"
    dealt = rows.repartition(buckets, *keys)
    dealt.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return name, rows.sparkSession.table(name)


def forget(spark: SparkSession, names: list[str]) -> None:
    """Remove stored tables' names from the catalogue."""
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
