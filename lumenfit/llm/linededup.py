"""Repeated lines, found with levelled sorted runs of line hashes. DataFrame operations only.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased; keys of ``min_chars`` characters or more
take part, as 128-bit hashes. Documents come in batches, larger ids first. A batch's keys are merge-anti-joined with the
runs stored so far: a key that none of them holds is new, and its holder is the batch's largest document with it. The batch
then adds its own sorted run of keys, with the number of its documents and, for new keys, the holder. When a level has as
many runs as the fan-out, they are merged into one run of the next level. Runs are bucketed and sorted by hash, so the
anti-joins read them without a shuffle.

Keys that at least ``min_docs`` documents hold lose their lines everywhere but in the holder.

Defined cases: a null or empty text is one empty line; a line that repeats within a document counts once; rows of one id
count as one document, and if it is a line's largest they all keep it; rows without an id count as one document too, which
holds a line only if no row with an id has it; ids of any range do; an empty table gives no rows; other columns are kept by
:func:`without_repeats` and not read else.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfit.llm.common import ascii_lower, documents, few, forget, with_group, write_bucketed, write_scratch
from lumenfit.llm.registry import query
from lumenfit.session import scratch_path

SPACE = " \t\n\x0b\x0c\r"
HASH = ["h1", "h2"]
BATCHES, FAN_OUT = 4, 3
_ID, _TEXT, _DROP = "__lost_id", "__lost_text", "__lost_lines"  # names that no table is expected to use


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _hashes(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def _long(line: Column, min_chars: int) -> Column:
    return (F.octet_length(line) >= min_chars) & (F.char_length(F.btrim(line, F.lit(SPACE))) >= min_chars)


class LineRuns:
    """Sorted runs of line hashes in levels, under a folder that every executor can reach."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, fan_out: int = FAN_OUT):
        self.spark, self.path, self.fan_out = spark, path, fan_out
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, DataFrame]]] = []
        self.written = 0
        self.names: list[str] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for _, run in level]

    def _store(self, rows: DataFrame, level: int) -> tuple[str, DataFrame]:
        self.written += 1
        path = f"{self.path}/level-{level}-run-{self.written}"
        name, run = write_bucketed(rows, path, HASH, self.buckets)
        self.names.append(name)
        return path, run

    def close(self) -> None:
        """Forget the runs' names; their files stay."""
        forget(self.spark, self.names)
        self.names = []

    def fresh(self, keys: DataFrame) -> DataFrame:
        """The keys that no run holds: one merge-anti-join per run, all on the same buckets."""
        return reduce(lambda rows, run: rows.join(run.select(*HASH).hint("merge"), HASH, "left_anti"), self.runs(), keys)

    def add(self, keys: DataFrame) -> DataFrame:
        """Add a batch of ``h1, h2, n, holder`` (one row per key); the run it adds comes back, new keys with a holder."""
        known = reduce(
            lambda rows, run: rows.unionByName(keys.join(run.where("fresh").select(*HASH).hint("merge"), HASH, "left_semi")),
            self.runs(), keys.limit(0),
        )
        rows = self.fresh(keys).withColumn("fresh", F.lit(True)).unionByName(
            known.withColumns({"holder": F.lit(None).cast(keys.schema["holder"].dataType), "fresh": F.lit(False)})
        )
        stored = self._store(rows, 0)
        self._put(stored, 0)
        return stored[1]

    def _put(self, run: tuple[str, DataFrame], level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan_out:
            merged = self._store(self.merged([path for path, _ in self.levels[level]]), level + 1)
            self.levels[level] = []
            self._put(merged, level + 1)

    def merged(self, paths: list[str] | None = None) -> DataFrame:
        """One row per key of the runs: ``h1, h2, n, holder, fresh``.

        The files are read as plain Parquet: Spark 4.1 takes a union of bucketed scans for partitioned by the bucket
        columns although it lists their partitions one after the other, and sums each run on its own.
        """
        paths = [path for level in self.levels for path, _ in level] if paths is None else paths
        every = self.spark.read.schema(self.runs()[0].schema).parquet(*paths)
        return every.groupBy(*HASH).agg(F.sum("n").alias("n"), F.max("holder").alias("holder"), F.bool_or("fresh").alias("fresh"))


def repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = BATCHES, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, drop``: for each document that loses lines, the hashes of the keys it loses.

    Rows of one id are told apart by a hash of their text, so that those without an id do not gather in one group. What a
    line loses depends on its key and id alone, so texts that share a hash do no harm.
    """
    spark = docs.sparkSession
    line = F.filter(split_lines(F.col(text_col)), lambda x: _long(x, min_chars))
    own = F.array_distinct(F.transform(line, lambda x: _hashes(line_key(x))))
    slim = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.explode(own).alias("h"))
    lines = write_scratch(slim.select("doc_id", "text_hash", "h.h1", "h.h2"), "lines")
    shares = [k / batches for k in range(1, batches)] or [0.5]
    edges, total = lines.agg(F.percentile_approx("doc_id", shares, 1_000), F.count("*")).first()
    below = [(F.col("doc_id") < F.lit(edge)).cast("int") for edge in set(edges or [])] if batches > 1 else []
    batch = F.coalesce(reduce(lambda a, b: a + b, below, F.lit(0)), F.lit(batches - 1))
    held = lines.groupBy(*HASH, batch.alias("batch"))
    keys = held.agg(  # null ids are one document
        (F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))).alias("n"), F.max("doc_id").alias("holder")
    )
    path = scratch_path(spark, "line-runs")
    runs = LineRuns(spark, path)
    name, dealt = write_bucketed(keys, f"{path}/batches", HASH, runs.buckets)
    for b in range(batches):
        runs.add(dealt.where(F.col("batch") == b).drop("batch"))
    repeated = write_scratch(runs.merged().where(F.col("n") >= min_docs).select(*HASH, "n", "holder"), "repeated-lines")
    runs.close()
    forget(spark, [name])
    marked = few(repeated)
    hit = lines.join(marked, HASH) if marked is not repeated else with_group(lines, repeated, HASH, "n", total)
    gone = hit.where(~F.col("doc_id").eqNullSafe(F.col("holder")))
    return gone.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct(*HASH)).alias("drop"))


def _with_kept(docs: DataFrame, min_chars: int, min_docs: int, batches: int, id_col: str, text_col: str) -> DataFrame:
    """The rows with ``_DROP``, the hashes their lines lose (null: none)."""
    drops = write_scratch(repeated_lines(docs, min_chars, min_docs, batches, id_col, text_col), "lost-lines")
    size = drops.agg(F.coalesce(F.sum(F.size("drop") + 4), F.lit(0))).first()[0]  # 16 bytes each
    drops = drops.select(F.col("doc_id").alias(_ID), F.col("text_hash").alias(_TEXT), F.col("drop").alias(_DROP))
    side = F.broadcast(drops) if size <= 2_000_000 else drops
    same = F.col(id_col).eqNullSafe(F.col(_ID)) & (F.xxhash64(text_col) == F.col(_TEXT))
    return docs.join(side, same, "left").drop(_ID, _TEXT)


def _kept(text: Column, min_chars: int) -> Column:
    """The lines that stay; lines are hashed again only where the document loses some."""
    lines = split_lines(text)
    stays = F.filter(lines, lambda x: ~(_long(x, min_chars) & F.array_contains(F.col(_DROP), _hashes(line_key(x)))))
    return F.when(F.col(_DROP).isNull(), lines).otherwise(stays)


def line_report(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = BATCHES, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_text`` of every row."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = _with_kept(slim, min_chars, min_docs, batches, "doc_id", "text")
    found = rows.select("doc_id", F.size(split_lines(F.col("text"))).alias("n_lines"), _kept(F.col("text"), min_chars).alias("kept"))
    return found.select(
        "doc_id", F.col("n_lines").cast("bigint"), (F.col("n_lines") - F.size("kept")).cast("bigint").alias("n_dropped"),
        F.array_join("kept", "\n").alias("kept_text"),
    )


def without_repeats(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = BATCHES, id_col: str = "doc_id",
                    text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """The rows with the lines that stay; texts that lose none are untouched, others get their new size in ``size_col``."""
    rows = _with_kept(docs, min_chars, min_docs, batches, id_col, text_col)
    lost = F.col(_DROP).isNotNull()
    text = F.when(lost, F.array_join(_kept(F.col(text_col), min_chars), "\n")).otherwise(F.col(text_col))
    out = rows.withColumn(text_col, text)
    if size_col in docs.columns:
        kind = docs.schema[size_col].dataType
        out = out.withColumn(size_col, F.when(lost, F.char_length(F.col(text_col)).cast(kind)).otherwise(F.col(size_col)))
    return out.select(*docs.columns)


@query("op2_line_dedup", """
with d as (select row_number() over () as rid, doc_id, text from documents),
l as (
  select rid, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from d),
k as (
  select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
r as (
  select key, max(doc_id) as holder from (select distinct doc_id, key from k where length(key) >= 40)
  group by key having count(*) >= 5),
j as (select k.*, r.key is not null and doc_id is distinct from holder as gone from k left join r using (key))
select doc_id, count(*) as n_lines, sum(gone::int)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from j group by rid, doc_id""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_report(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
