"""Connected components of a table of links, without bringing links or components to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfit.llm.common import write_scratch


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of the undirected links ``a, b``.

    Alternating large-star and small-star steps: each hangs a node's larger (smaller) neighbours on the smallest node in
    sight, until every link points to its component's smallest node. A step keeps at most one row per link, takes minima
    with partial aggregation, and joins them back where a hot node's links are split by AQE. Each round is written to the
    shared folder, which also cuts lineage. Self-links and repeated links are harmless; an empty table gives no rows.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = write_scratch(pairs, "links")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        now = write_scratch(_small_star(_large_star(now)), "links")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _large_star(pairs: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest among the node and its neighbours."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    out = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m"))
    moved = pairs.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    kept = low.select("u", F.col("m").alias("v"))
    return moved.unionByName(kept).where("u <> v").distinct()
