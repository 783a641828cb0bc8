"""Exact deduplication against a persistent digest index.

The index is a Parquet table with one row per distinct digest, bucketed and sorted by digest. New rows are reduced to one
row per digest (partial sums first, so a digest that holds a third of all rows is one row per task), anti-joined with the
index by sort-merge on co-located buckets, and the digests that are new are appended.

A large table comes in batches, larger ids first, so that a digest's holder is in the first batch that has it and all later
batches meet it in the index.

Defined cases: a null text counts as the empty text; a null id is a row like any other and stays only if its group has no
other id; repeated rows are separate rows of their group, and one of those with its largest id stays; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfit.llm.common import ascii_lower, documents, with_group, write_scratch
from lumenfit.llm.registry import query
from lumenfit.session import scratch_path


BATCHES = 3  # batches that the query feeds the table in


def text_digest(text: Column) -> Column:
    """SHA-256 of the text with A-Z lower-cased, as 32 bytes."""
    return F.unhex(F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256))


class DigestIndex:
    """A stored set of digests with the id that holds each one.

    ``path`` is a folder that every executor can reach. A later session opens the same folder with the same number of
    buckets. One writer at a time.
    """

    SCHEMA = "digest BINARY, keep_id BIGINT"

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} ({self.SCHEMA}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) "
            f"INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def fresh(self, keys: DataFrame) -> DataFrame:
        """The keys (one row per digest) that the index does not hold, by sort-merge anti-join."""
        return keys.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, keys: DataFrame) -> None:
        """Store keys that :meth:`fresh` returned; each task writes one sorted bucket file."""
        rows = keys.select("digest", F.col("keep_id").cast("bigint")).repartition(self.buckets, "digest")
        writer = rows.write.mode("append").format("parquet").option("path", self.path)
        writer.bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)
        self.spark.catalog.refreshTable(self.table)

    def add(self, rows: DataFrame) -> DataFrame:
        """Index a batch of ``(doc_id, tie, digest)`` rows; what comes back is one row per digest of the batch.

        ``digest, n, keep_id, tie, in_index``: the batch's rows of the digest, the id that holds it (of a new digest the
        batch's largest id, with the largest ``tie`` of its rows; else the id stored earlier, and no ``tie``) and whether an
        earlier batch had it.
        """
        top = F.max(F.struct("doc_id", "tie"))
        keys = rows.groupBy("digest").agg(F.count("*").alias("n"), top.alias("top"))
        keys = write_scratch(keys.select("digest", "n", F.col("top.doc_id").alias("keep_id"), "top.tie"), "batch")
        new = write_scratch(self.fresh(keys), "fresh")
        known = keys.drop("keep_id", "tie").join(self.rows().hint("merge"), "digest").withColumn("tie", F.lit(None).cast("bigint"))
        out = write_scratch(
            known.withColumn("in_index", F.lit(True)).unionByName(new.withColumn("in_index", F.lit(False))), "added"
        )
        self.append(new)
        return out

    def close(self) -> None:
        """Forget the table's name; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def exact_groups(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text",
                 batches: int = 1) -> DataFrame:
    """Every row of a table with its group: ``doc_id, keep_id, group_size, kept, digest``.

    The rows are added to the index in ``batches`` of falling ids. ``group_size`` counts the table's rows. ``kept`` is true
    for one row of a group new to the index, with the largest id, and for none of a group that the index had before.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), text_digest(F.col(text_col)).alias("digest"))
    rows = write_scratch(slim.withColumn("tie", F.monotonically_increasing_id()), "digests")
    shares = [k / batches for k in range(1, batches)] or [0.5]
    edges, total = rows.agg(F.percentile_approx("doc_id", shares, 1_000), F.count("*")).first()
    edges = sorted(set(edges or []), reverse=True) if batches > 1 else []
    below = sum([(F.col("doc_id") < F.lit(e)).cast("int") for e in edges], F.lit(0))
    dealt = rows.withColumn("batch", F.coalesce(below, F.lit(len(edges))))
    added = [index.add(dealt.where(F.col("batch") == b).drop("batch")) for b in range(len(edges) + 1)]
    every = reduce(DataFrame.unionByName, added)
    # The holder comes from the batch that met no stored digest; of a digest stored before all batches, from the index.
    groups = write_scratch(every.groupBy("digest").agg(
        F.sum("n").alias("n"), F.max("keep_id").alias("keep_id"), F.max("tie").alias("first"),
    ), "groups")
    out = with_group(rows, groups, "digest", "n", total)
    kept = F.coalesce(F.col("tie") == F.col("first"), F.lit(False))
    return out.select("doc_id", "keep_id", F.col("n").alias("group_size"), kept.alias("kept"), "digest")


@query("op6_exact_dedup", """
with t as (
  select row_number() over () as rid, doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))
    as text_sha256 from documents),
g as (
  select text_sha256, max(doc_id) as keep_id, count(*) as group_size, first(rid order by doc_id desc nulls last) as first
  from t group by text_sha256)
select doc_id, keep_id, group_size, rid = first as kept, text_sha256 from t join g using (text_sha256)""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = DigestIndex(spark, scratch_path(spark, "digest-index"))
    try:
        out = exact_groups(documents(spark, sf_dir), index, batches=BATCHES)
    finally:
        index.close()
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
