"""Interleaving sources by target weights, with Pfair scheduling. DataFrame operations only.

Rows of a source are put in a hashed order and cut into blocks. A source of weight w (a number of ``slots`` out of ``period``)
has its i-th block (from 0) released at slot floor(i / w) and due by slot ceil((i + 1) / w); in every slot the released block
with the earliest deadline comes next. All blocks meet their windows, so after any number of slots each source is less than
one block from its share. Windows repeat with the period, so the schedule of one period (a fold over its slots, on one row
per source) gives the slot of every block; it is a table of ``period`` rows.

Every row gets a slot. When a source has no block left, its slots stay empty and the others go on at the pace of their
weights; ``on_target`` marks the rows before the first empty slot, up to which the shares are kept.

Defined cases: a null source is a source of its own; an id names a row, so repeated rows of a source share a position; a
null id is an id; sources without a weight have no slot, null positions, and come last; an empty table gives no rows; other
columns are kept by :func:`in_mixed_order` and not read else.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfit.llm.common import documents, few, write_scratch
from lumenfit.llm.registry import query

PERIOD = 1_000  # slots, or ten for each source if that is more
BLOCK_ROWS = 16
BUCKET_ROWS = 50_000  # rows of a source that one window orders
PRECISION = 1_000


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null, keeping the left side's."""
    named = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(named, on, how).drop(*[f"__{k}" for k in keys])


def source_slots(weights: DataFrame, period: int | None = None) -> DataFrame:
    """``source, number, slots, period`` from ``source, weight`` (whole numbers): slots by largest remainder, one at least.

    The table has one row per source, a matter of configuration; windows over it take one task.
    """
    every = W.partitionBy()
    n = F.count("*").over(every)
    size = F.lit(period).cast("bigint") if period else F.greatest(F.lit(PERIOD).cast("bigint"), 10 * n)
    shared = weights.where("weight > 0").select(
        "source", F.col("weight").cast("bigint").alias("weight"), n.alias("n"), size.alias("period"),
        F.sum(F.col("weight").cast("bigint")).over(every).alias("all"),
        (F.row_number().over(W.orderBy(F.col("source").asc_nulls_first())) - 1).alias("number"),
    )
    free = F.col("weight") * (F.col("period") - F.col("n"))
    parts = shared.withColumns({"whole": F.expr("(weight * (period - n)) div all"), "rest": free % F.col("all")})
    left = F.col("period") - F.col("n") - F.sum("whole").over(every)
    extra = F.row_number().over(W.orderBy(F.desc("rest"), "number")) <= left
    return parts.select("source", "number", (F.col("whole") + 1 + extra.cast("bigint")).alias("slots"), "period")


def schedule(slots: DataFrame) -> DataFrame:
    """``number, turn, slot``: the slot of each source's blocks of one period, earliest deadline first."""
    row = slots.agg(
        F.transform(F.array_sort(F.collect_list(F.struct("number", "slots"))), lambda x: x["slots"]).alias("slots"),
        F.max("period").alias("period"),
    ).where("period is not null")
    fold = """
      aggregate(sequence(0L, period - 1L),
        named_struct('turn', transform(slots, x -> 0L), 'picks', cast(array() as array<struct<number: int, turn: bigint>>)),
        (state, t) -> transform(array(array_min(filter(
            transform(state.turn, (k, i) -> if(
              k < slots[i] and (k * period) div slots[i] <= t,
              named_struct('due', ((k + 1L) * period + slots[i] - 1L) div slots[i], 'number', i), null)),
            x -> x is not null)).number),
          p -> named_struct(
            'turn', transform(state.turn, (k, i) -> if(i = p, k + 1L, k)),
            'picks', concat(state.picks, array(named_struct('number', p, 'turn', state.turn[p])))))[0],
        state -> state.picks)"""
    picks = row.select(F.posexplode(F.expr(fold)).alias("slot", "pick"))
    return picks.select("pick.number", "pick.turn", F.col("slot").cast("bigint"))


def _draw(key: Column, seed: int) -> Column:
    """128 bits as text: the order of a source's rows."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))


def source_ranks(rows: DataFrame, seed: int, total: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``source, id, rank``: the place (from 0) of each distinct ``source, id`` in its source's hashed order.

    The order is cut into ranges of the hash, so that a window gets a share of a source's rows, however many it has; the
    sizes of the ranges before give the offset. There are at least as many ranges as shuffle partitions, so that one hot
    source spreads over all of them.
    """
    ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_rows))
    head = F.conv(F.substring(_draw(F.col("id"), seed), 1, 8), 16, 10).cast("bigint")
    dealt = rows.withColumn("draw", _draw(F.col("id"), seed)).withColumn("range", ((head * ranges) / F.lit(1 << 32)).cast("int"))
    sizes = dealt.groupBy("source", "range").agg(F.count("*").alias("size"))
    before = F.sum("size").over(W.partitionBy("source").orderBy("range")) - F.col("size")
    starts = sizes.select("source", "range", before.alias("start"))
    place = F.row_number().over(W.partitionBy("source", "range").orderBy("draw", "id")) - 1
    placed = dealt.select("source", "id", "range", place.alias("place"))
    joined = _null_safe(placed, starts, ["source", "range"])
    return joined.select("source", "id", (F.col("start") + F.col("place")).alias("rank"))


def tempered(rows: DataFrame) -> DataFrame:
    """Target weights ``source, weight`` in proportion to the square root of each source's size, as whole numbers."""
    return rows.groupBy("source").agg(F.floor(F.sqrt(F.count("*").cast("double")) * PRECISION).alias("weight"))


def mixed(docs: DataFrame, weights: Mapping[str, int] | None = None, seed: int = 7, block_rows: int = BLOCK_ROWS,
          period: int | None = None, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``doc_id, source, rank, block, release, due, slot, position, on_target`` of every distinct id of every source.

    ``position`` orders the rows; it has gaps where slots are empty. ``release`` and ``due`` are the block's window.
    """
    spark = docs.sparkSession
    rows = write_scratch(
        docs.select(F.col(source_col).cast("string").alias("source"), F.col(id_col).alias("id")).distinct(), "mixture-rows"
    )
    if weights is None:
        target = tempered(rows)
    else:
        target = spark.createDataFrame([(s, int(w)) for s, w in weights.items()], "source string, weight bigint")
    slots = write_scratch(source_slots(target, period), "source-slots")
    turns = write_scratch(schedule(slots), "schedule")
    blocks = source_ranks(rows, seed, rows.count()).withColumn("block", F.floor(F.col("rank") / block_rows).cast("bigint"))
    blocks = _null_safe(blocks, F.broadcast(slots), ["source"], "left")  # a row per source
    blocks = blocks.withColumn("turn", F.expr("block % slots"))
    placed = blocks.join(F.broadcast(turns), ["number", "turn"], "left")  # a row per slot of the period
    slot = F.expr("block div slots * period") + F.col("slot")
    window = {"release": F.expr("block * period div slots"), "due": F.expr("((block + 1) * period + slots - 1) div slots")}
    # The first slot that stays empty: the least slot of any source's first block that is not full.
    counts = _null_safe(rows.groupBy("source").agg(F.count("*").alias("n")), F.broadcast(slots), ["source"])
    ends = counts.withColumn("block", F.expr(f"n div {block_rows}")).withColumn("turn", F.expr("block % slots"))
    first = ends.join(F.broadcast(turns), ["number", "turn"]).agg(F.min(slot)).first()[0]
    out = placed.withColumns(window | {"slot": slot})
    position = F.col("slot") * block_rows + F.col("rank") % block_rows
    return out.select(
        F.col("id").alias("doc_id"), "source", "rank", "block", "release", "due", "slot", position.alias("position"),
        F.coalesce(F.col("slot") < F.lit(first), F.lit(False)).alias("on_target"),
    )


def in_mixed_order(docs: DataFrame, weights: Mapping[str, int] | None = None, seed: int = 7, block_rows: int = BLOCK_ROWS,
                   id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """All rows with all columns, dealt to partitions and sorted by position: files written from it follow the mixture."""
    spark = docs.sparkSession
    found = mixed(docs, weights, seed, block_rows, id_col=id_col, source_col=source_col)
    # Partitions are ranges of positions; the narrow table is dealt by range to number them.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = found.select(
        F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("position").alias("__position")
    ).repartitionByRange(parts, F.col("__position").asc_nulls_last())
    places = write_scratch(ranged.withColumn("__part", F.spark_partition_id()), "positions")
    on = F.col(id_col).eqNullSafe(F.col("__id")) & F.col(source_col).cast("string").eqNullSafe(F.col("__source"))
    rows = docs.join(few(places), on)
    last = places.agg(F.coalesce(F.max("__part"), F.lit(0))).first()[0]
    out = rows.repartitionById(last + 1, F.col("__part"))
    return out.sortWithinPartitions(F.col("__position").asc_nulls_last(), id_col).select(*docs.columns)


@query("op3_source_mixing", """
with recursive src as (select source, count(*) as n, floor(sqrt(count(*)::double) * 1000)::bigint as weight from documents group by source),
s1 as (
  select *, count(*) over () as k, greatest(1000, 10 * count(*) over ()) as period, sum(weight) over ()::bigint as total,
    row_number() over (order by source nulls first) - 1 as number from src),
s2 as (select *, (weight * (period - k)) // total as whole, (weight * (period - k)) % total as rest from s1),
s3 as (
  select source, n, number, period, whole + 1 + (row_number() over (order by rest desc, number)
    <= period - k - (sum(whole) over ()))::bigint as slots from s2),
lists as (select list(slots order by number) as slots, max(period) as period from s3),
steps(t, turn, pick, slots, period) as (
  select 0::bigint, list_transform(slots, lambda x: 0::bigint), null::bigint, slots, period from lists
  union all
  select t + 1, list_transform(turn, lambda x, i: x + (i = pick)::bigint), pick, slots, period from (
    select t, turn, slots, period, list_min(list_filter(list_transform(turn, lambda x, i:
      case when x < slots[i] and (x * period) // slots[i] <= t
      then {'due': ((x + 1) * period + slots[i] - 1) // slots[i], 'i': i::bigint} end), lambda y: y is not null)).i as pick
    from steps where t < period)),
turns as (
  select t - 1 as slot, pick - 1 as number, count(*) over (partition by pick order by t) - 1 as turn
  from steps where pick is not null),
ranked as (
  select doc_id, source, row_number() over (partition by source order by md5('7:' || doc_id), doc_id) - 1 as rank from documents),
placed as (
  select doc_id, r.source, rank, rank // 16 as block, (rank // 16) * s3.period // slots as release,
    ((rank // 16 + 1) * s3.period + slots - 1) // slots as due, (rank // 16) // slots * s3.period + slot as slot
  from ranked r join s3 on r.source is not distinct from s3.source
  join turns on turns.number = s3.number and turn = (rank // 16) % slots),
first as (
  select min((n // 16) // slots * period + slot) as empty from s3 join turns on turns.number = s3.number and turn = (n // 16) % slots)
select doc_id, source, rank, block, release, due, slot, slot * 16 + rank % 16 as position, slot < empty as on_target
from placed, first""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(documents(spark, sf_dir))
