"""Deterministic splits, folds, batches and bootstrap weights (P-1 .. P-5, W-8 .. W-10).

Rows are ordered by ``md5(key:seed)``. An exact-size split needs the digest at one rank; it is found by counting
digest prefixes, never by sorting the table.
"""

from __future__ import annotations

import math
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfit.functions.hashing import (
    DRAWS, HALF_BITS, HASH_BITS, hash60, key_string, md5_key, poisson1, poisson1_cdf, uniform,
)
from lumenfit.operators.common import join_on
from lumenfit.operators.index import with_dense_index

SELECT_AT_MOST = 20_000
KEYS_AT_ONCE = 1_000  # rows whose bags are drawn together
LISTED_AT_MOST = 1_000  # digests of one split sorted in an array


def _ceil(x: float) -> int:
    return math.ceil(round(x, 9))


def _digest_at(df: DataFrame, rank: int, sizes: list[tuple[int, int]]) -> str:
    """The digest with ``rank`` smaller ones, starting from the counts per leading 12 bits."""
    below, low, width = 0, 0, 2**HASH_BITS
    while True:
        step = width >> 12
        for part, size in sizes:
            if below + size > rank:
                break
            below += size
        low, width = low + part * step, step
        inside = df.where(F.col("_h").between(low, low + width - 1))
        if size <= SELECT_AT_MOST or width == 1:
            row = inside.select("_d").orderBy("_d").offset(rank - below).limit(1).first()
            return row["_d"]
        sizes = _prefix_sizes(inside, low, width >> 12)


def _prefix_sizes(df: DataFrame, low: int, step: int) -> list[tuple[int, int]]:
    part = F.expr(f"(_h - {low}L) div {step}L")
    return sorted(tuple(r) for r in df.groupBy(part.alias("p")).count().collect())


def _split_at(df: DataFrame, key, seed: int, plan) -> DataFrame:
    """Name rows by digest rank; ``plan(n)`` gives ``[(name, end_rank), ..., (name, n)]``."""
    keyed = df.select(md5_key(key, seed).alias("_d"), hash60(key, seed).alias("_h"))
    sizes = _prefix_sizes(keyed, 0, 2 ** (HASH_BITS - 12))
    n = sum(size for _, size in sizes)
    parts = plan(n)
    digest = md5_key(key, seed)
    split = F.lit(parts[-1][0])
    for name, end in reversed(parts[:-1]):
        if end >= n:
            split = F.lit(name)
        elif end > 0:
            split = F.when(digest < F.lit(_digest_at(keyed, end, sizes)), F.lit(name)).otherwise(split)
    return df.withColumn("split", split)


def hash_split(
    df: DataFrame, key="idx", test_size: float = 0.25, seed: int = 42, exact: bool = True
) -> DataFrame:
    """P-1: add ``split`` (``test`` / ``train``) with exactly ``ceil(test_size * n)`` test rows.

    ``key`` must be unique. ``exact=False`` thresholds the hash without any job; sizes are then binomial.
    """
    if not exact:
        cut = F.lit(int(test_size * 2**HASH_BITS))
        return df.withColumn("split", F.when(hash60(key, seed) < cut, "test").otherwise("train"))
    return _split_at(df, key, seed, lambda n: [("test", _ceil(test_size * n)), ("train", n)])


def split_cuts(df: DataFrame, plans: list[tuple[float, int]], key="idx") -> list[str]:
    """The digest below which a row is a test row of :func:`hash_split`, for many (test share, seed) at once.

    All splits are narrowed together: one aggregate keyed (split, part of its digest range) counts them, Spark finds the part
    that holds each rank, and the driver receives one row per split. An empty text cuts off no row, ``g`` every row.
    """
    n = df.count()
    ends = [_ceil(share * n) for share, _ in plans]
    cuts = {i: "" if end <= 0 else "g" for i, end in enumerate(ends) if not 0 < end < n}
    wide = {i: (0, 2**HASH_BITS, end) for i, end in enumerate(ends) if i not in cuts}
    narrow = {}

    def inside(ranges: dict) -> DataFrame:
        listed = F.array(*[
            F.struct(F.lit(i).alias("i"), F.lit(str(plans[i][1])).alias("seed"), F.lit(low).cast("bigint").alias("low"),
                     F.lit(width).cast("bigint").alias("width"), F.lit(rank).cast("bigint").alias("rank"))
            for i, (low, width, rank) in ranges.items()
        ])
        rows = df.select(key_string(key).alias("_k"), F.explode(listed).alias("s")).select("_k", "s.*")
        rows = rows.withColumn("d", F.md5(F.concat_ws(":", "_k", "seed")))
        rows = rows.withColumn("h", F.conv(F.substring("d", 1, HASH_BITS // 4), 16, 10).cast("bigint"))
        return rows.where("h >= low and h - low < width")

    while wide:
        counts = inside(wide).groupBy("i", "low", "width", "rank", F.expr("(h - low) div (width div 4096)").alias("part")).count()
        upto = F.sum("count").over(Window.partitionBy("i").orderBy("part"))  # at most 4,096 rows
        found = counts.withColumn("below", upto - F.col("count")).where("below <= rank and rank < below + count").collect()
        wide = {}
        for r in found:
            step = r["width"] >> 12
            at = (r["low"] + r["part"] * step, step, r["rank"] - r["below"])
            (narrow if r["count"] <= LISTED_AT_MOST or step == 1 else wide)[r["i"]] = at
    if narrow:
        picked = F.element_at(F.sort_array(F.collect_list("d")), F.col("rank").cast("int") + 1)
        cuts.update((r["i"], r["cut"]) for r in inside(narrow).groupBy("i", "rank").agg(picked.alias("cut")).collect())
    return [cuts[i] for i in range(len(plans))]


def held_out(plans: list[tuple[float, int]], cuts: list[str], key="idx") -> Column:
    """An array saying, for each (test share, seed), whether a row is a test row; see :func:`split_cuts`."""
    listed = F.array(*[F.struct(F.lit(str(seed)).alias("seed"), F.lit(cut).alias("cut")) for (_, seed), cut in zip(plans, cuts)])
    return F.transform(listed, lambda s: F.md5(F.concat_ws(":", key_string(key), s["seed"])) < s["cut"])


def hash_split3(df: DataFrame, key="idx", fracs=None, seed: int = 42) -> DataFrame:
    """P-2 / P-3: three-way split, e.g. ``{"val": .2, "test": .4, "train": .4}``.

    Parts are carved off in the given order, each taking the ceiling of its share of what is left.
    """
    fracs = fracs or {"train": 0.6, "test": 0.2, "val": 0.2}

    def plan(n: int):
        parts, end, share = [], 0, sum(fracs.values())
        for name, frac in fracs.items():
            end += _ceil((n - end) * frac / share) if share > 1e-12 else 0
            share -= frac
            parts.append((name, min(end, n)))
        return parts

    return _split_at(df, key, seed, plan)


def hash_folds(df: DataFrame, key="idx", k: int = 10, seed: int = 42) -> DataFrame:
    """P-4: add ``fold`` in ``0 .. k-1``."""
    return df.withColumn("fold", (hash60(key, seed) % k).cast("int"))


def bootstrap_weights(
    df: DataFrame, key="idx", n_trees: int = 100, seed: int = 42, name: str = "w", own_digests: bool = False
) -> DataFrame:
    """P-5: add an array with each row's Poisson(1) bootstrap count per tree; zero means out of bag.

    A digest of (seed, row, block) gives the counts of four trees, from 30 bits each; with ``own_digests`` every count comes
    from 52 bits of a digest of (seed, row, tree).
    """
    if own_digests:
        trees = F.sequence(F.lit(0), F.lit(n_trees - 1))
        draws = F.transform(trees, lambda t: uniform(F.lit(seed), F.col(key), t))
        return df.withColumn(name, F.transform(draws, poisson1))
    return df.withColumn(name, _counts(n_trees, seed)(F.col(key).cast("string")))


def _counts(n_trees: int, seed: int):
    """An Arrow-batched function from a row's key, as text, to its counts: the draws of ``hashing.draw_sql``, batch by batch."""
    cdf, blocks, half = np.array(poisson1_cdf()), -(-n_trees // DRAWS), HALF_BITS

    @F.arrow_udf("array<int>")
    def counts(keys: pa.Array) -> pa.Array:
        ends = [f":{b}".encode() for b in range(blocks)]
        made = []
        for first in range(0, len(keys), KEYS_AT_ONCE):
            heads = [str(seed) if k is None else f"{seed}:{k}" for k in keys.slice(first, KEYS_AT_ONCE).to_pylist()]
            digests = b"".join([md5(h + e).digest() for h in map(str.encode, heads) for e in ends])
            high, low = np.frombuffer(digests, ">u8").astype(np.uint64).reshape(-1, 2).T
            words = np.stack([high >> np.uint64(4), (high & np.uint64(15)) << np.uint64(56) | low >> np.uint64(8)], axis=1)
            bits = np.stack([words >> np.uint64(half), words & np.uint64((1 << half) - 1)], axis=2)
            u = (bits.astype(float) + 0.5) * 2.0**-half
            made.append(np.searchsorted(cdf, u.reshape(len(heads), -1)[:, :n_trees], side="right").astype(np.int32))
        flat = np.concatenate(made).ravel() if made else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * n_trees), pa.array(flat))

    return counts


def epoch_order(df: DataFrame, epoch: int, seed: int = 42, key="idx") -> DataFrame:
    """W-8: add the sort key of a per-epoch reshuffle; labels stay on their rows."""
    return df.withColumn("order_key", md5_key(key, epoch, seed))


def assign_batches(
    df: DataFrame, size: int, drop_last: bool = True, order="idx", **sizes
) -> DataFrame:
    """W-9: add ``batch`` numbers of ``size`` consecutive rows; the partial last batch is dropped.

    A row count that is a multiple of ``size`` keeps every row.
    """
    numbered = with_dense_index(df, order, "_rn", **sizes)
    batched = numbered.withColumn("batch", F.expr(f"_rn div {size}")).drop("_rn")
    return batched.where(F.col("batch") < df.count() // size) if drop_last else batched


def sample_batches(
    df: DataFrame, n_batches: int, size: int, epoch: int = 0, seed: int = 42, order="idx"
) -> DataFrame:
    """W-10: ``n_batches`` batches of ``size`` rows drawn with replacement, reproducible per epoch.

    Draws are generated as rows of their own and joined to the drawn positions.
    """
    numbered = with_dense_index(df, order, "_pos")
    n = df.count()
    spark = df.sparkSession
    draws = spark.range(n_batches * size).select(
        F.expr(f"id div {size}").alias("batch"),
        (F.col("id") % size).alias("slot"),
        F.floor(uniform(F.lit(seed), F.lit(epoch), F.col("id")) * n).cast("bigint").alias("_pos"),
    )
    return join_on(numbered, draws, ["_pos"]).drop("_pos")
