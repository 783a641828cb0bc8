"""Near copies by exact overlap of word shingles: a set-similarity join with prefix, size and position filters.

A text is the set of 64-bit hashes of its word shingles. Two texts are near copies if the sets' intersection is at least
LEAST of their union. All sets are put in one order, rare shingles first; then two near copies of at least that overlap
have a shingle in common among the first n - ceil(LEAST * n) + 1 of each, so only texts that meet in such a prefix are
compared, and none is missed. What is rare is estimated from a sample: any order gives the same links, a good one makes
fewer pairs. The sample is a fixed share of the texts, so a family of some hundreds is in it at any size of the table. A
pair also needs sizes, and positions of the shingle met, that leave room for the overlap; where both positions are beyond
a ninth of the size there is never room, so a text whose own words fill more than that of it meets no other such text.

Of the texts that meet in a shingle each is first compared with the one of them that has it earliest, as a text without many
shingles of its own is nearest to the others. That is a row per text and shingle, and joins most of a large family of copies; then only pairs that this left in different classes are
compared. The texts of a frequent shingle are dealt to several tasks, with such a text each, and these are
compared with the earliest of all. Every pair is verified on the whole sets before it counts as a link, and classes are the
connected components of links. Pairs with the square of a family's size are left where texts have between an eighteenth and
a ninth of their shingles for themselves and lack as many of the family's.

Defined cases: a null or blank text is the set of one empty shingle, and a copy of any other such text; fewer words than a
shingle hold are one shingle; equal texts are one node; null ids and ids shared by several texts join nothing; an empty
table gives no rows; other columns are kept by :func:`one_of_each` and not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfit.llm.common import HOT_PARTS, few, hash_sample, with_group, write_scratch
from lumenfit.llm.components import components
from lumenfit.llm.simhash import shingle_hashes

LEAST = (4, 5)  # the overlap of near copies, as a fraction
SAMPLE_ROWS = 20_000  # texts from which the order of shingles is estimated, or
SAMPLE_SHARE = 16  # one in so many texts, if that is more
HOT_ROWS = 64  # a task's share of a frequent shingle's texts holds at least so many of the sample
COMMON = 1 << 19  # shingles known to be common, the others count as rare


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct hashes in order; the empty shingle for a text without words."""
    found = np.unique(np.array(shingle_hashes(text, words), np.uint64))
    return found if len(found) else np.zeros(1, np.uint64)


def _common(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of several texts of a sample, in order, with their numbers of texts and of tasks to deal their texts to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py(), words).view(np.int64))], ["h"])

    bound = max(SAMPLE_ROWS, texts.count() // SAMPLE_SHARE)
    sample = hash_sample(texts, "node", bound).select("text").mapInArrow(run, "h bigint")
    held = sample.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    h, n = held.column("h").to_numpy().view(np.uint64), held.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order], np.minimum(n[order] // max(bound // HOT_PARTS, HOT_ROWS), HOT_PARTS)


def _prefixes(texts: DataFrame, words: int) -> DataFrame:
    """``node, size, prefix, part``: the size of each text's set and its first shingles, rare ones first.

    ``part`` is 0 for a shingle that is not frequent, else the part of its texts, from 1, that this one belongs to.
    """
    shared = texts.sparkSession.sparkContext.broadcast(_common(texts, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, dealt = shared.value
        for b in batches:
            nodes = b.column("node").to_numpy()
            _, first = np.unique(nodes, return_index=True)
            sizes, prefixes, parts = [], [], []
            for i in first.tolist():
                found = shingle_set(b.column("text")[i].as_py(), words)
                rank = many = np.zeros(len(found), np.int64)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                    rank, many = (np.where(keys[at] == found, c[at], 0) for c in (counts, dealt))
                n = len(found)
                top = n + LEAST[0] * n // -LEAST[1] + 1
                first_ones = np.lexsort((found, rank))[:top]
                sizes.append(n)
                prefixes.append(found[first_ones].view(np.int64))
                many = many[first_ones]
                parts.append(np.where(many > 1, 1 + nodes[i] % np.maximum(many, 1), 0).astype(np.int32))
            ends = pa.array(np.cumsum([0, *map(len, prefixes)]), pa.int32())
            flat = [np.concatenate(some) if some else np.zeros(0, kind) for some, kind in ((prefixes, np.int64), (parts, np.int32))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes[first]), pa.array(sizes, pa.int32()), *[pa.ListArray.from_arrays(ends, some) for some in flat]],
                ["node", "size", "prefix", "part"])

    return texts.select("node", "text").mapInArrow(run, "node bigint, size int, prefix array<bigint>, part array<int>")


def _room(size: Column, pos: Column, other: Column, other_pos: Column) -> Column:
    """Whether two sets that first meet in a shingle at these positions can overlap enough."""
    most = F.least(size - pos, other - other_pos)
    return most * sum(LEAST) >= (size + other) * LEAST[0]



def _late() -> Column:
    """How far down its text's order a shingle is."""
    return F.col("pos") / F.col("size")


def _meetings(prefixes: DataFrame) -> DataFrame:
    """``h, part, node, size, pos, hub, hub_size, hub_pos``: the nodes of a shingle's part with the earliest one, the hub.

    The hub itself has a row, with itself as hub, only where the shingle has several parts.
    """
    rows = prefixes.select("node", "size", F.posexplode(F.arrays_zip("prefix", "part")).alias("pos", "met"))
    rows = rows.select(F.col("met.prefix").alias("h"), F.col("met.part").alias("part"), "node", "size", "pos")
    dealt = rows.repartition("h", "part").sortWithinPartitions("h", "part", _late(), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hub = None, None  # the row before, and the first row of its part
        for b in batches:
            if not b.num_rows:
                continue
            cols = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("h", "part", "node", "size", "pos")], 1)
            if last is not None:
                cols = np.concatenate([hub[None], last[None], cols])
            node = cols[:, 2]
            new = np.r_[True, (cols[1:, :2] != cols[:-1, :2]).any(axis=1)]
            start = np.maximum.accumulate(np.where(new, np.arange(len(cols)), 0))
            keep = (node != node[start]) | (new & (cols[:, 1] > 0))  # also leaves out further rows of the hub
            keep[1:] &= new[1:] | (node[1:] != node[:-1])  # equal texts of several batches
            if last is not None:
                keep[:2] = False
            last, hub = cols[-1], cols[start[-1]]
            out = np.concatenate([cols[keep], cols[start[keep]][:, 2:]], 1)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out.T], list(names))

    names = ("h", "part", "node", "size", "pos", "hub", "hub_size", "hub_pos")
    return dealt.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def _hubs(met: DataFrame) -> DataFrame:
    """The hubs of a frequent shingle's parts with the earliest of them, in the same columns."""
    each = met.where("part > 0 and node = hub").select("h", "part", "node", "size", "pos")
    least = each.groupBy("h").agg(F.min(F.struct(_late().alias("late"), "node", "size", "pos")).alias("least"))
    found = each.join(least, "h").where("node <> least.node")
    return found.select(each.columns + [F.col(f"least.{c}").alias(n) for c, n in (
        ("node", "hub"), ("size", "hub_size"), ("pos", "hub_pos"))])


def _verified(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """The distinct pairs ``a, b`` of nodes whose sets overlap enough."""
    pairs = write_scratch(pairs.distinct(), "pairs")
    nodes = write_scratch(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    held = texts.join(few(nodes), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), words).view(np.int64) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "held"])

    sets = write_scratch(held.mapInArrow(run, "node bigint, held array<bigint>"), "shingle-sets")
    both = pairs.join(sets.withColumnsRenamed({"node": "a", "held": "x"}), "a").join(
        sets.withColumnsRenamed({"node": "b", "held": "y"}), "b")
    same = F.size(F.array_intersect("x", "y"))
    enough = same * LEAST[1] >= (F.size("x") + F.size("y") - same) * LEAST[0]
    return write_scratch(both.where(enough).select("a", "b"), "verified")


def links(texts: DataFrame, words: int = 5, proposed: DataFrame | None = None) -> DataFrame:
    """Verified links ``a, b`` that connect the nodes of ``texts`` (``node, text``) as all near copies would.

    Pairs ``a, b`` of nodes that another method proposes are verified with the first ones.
    """
    met = write_scratch(_meetings(write_scratch(_prefixes(texts, words), "prefixes")), "meetings")
    room = _room(F.col("size"), F.col("pos"), F.col("hub_size"), F.col("hub_pos"))
    starts = met.where("node <> hub").unionByName(_hubs(met)).where(room)
    pairs = starts.select(F.col("hub").alias("a"), F.col("node").alias("b"))
    first = _verified(pairs if proposed is None else pairs.unionByName(proposed), texts, words)
    classes = write_scratch(components(first), "first-classes")
    named = met.select("h", "node", "size", "pos").join(few(classes), "node", "left")
    named = write_scratch(named.withColumn("component", F.coalesce("component", "node")), "named")
    split = named.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    apart = write_scratch(named.join(few(write_scratch(split.select("h"), "split")), "h", "left_semi"), "apart")
    more = _apart(apart).select(F.least("one.node", "two.node").alias("a"), F.greatest("one.node", "two.node").alias("b"))
    return first.unionByName(_verified(more, texts, words))


def _apart(rows: DataFrame) -> DataFrame:
    """``one, two``: the pairs of rows of a shingle that have room for the overlap and are in different classes.

    Room for the overlap means that one of the positions is within a ninth of the size, so only such rows are on one side.
    """
    early = F.col("pos") * (sum(LEAST)) <= F.col("size") * (LEAST[1] - LEAST[0])
    one, two = rows.alias("one"), rows.where(early).alias("two")
    once = (F.col("one.pos") * sum(LEAST) > F.col("one.size") * (LEAST[1] - LEAST[0])) | (F.col("one.node") < F.col("two.node"))
    near = _room(F.col("one.size"), F.col("one.pos"), F.col("two.size"), F.col("two.pos"))
    return one.join(two, (F.col("one.h") == F.col("two.h")) & once & near & (F.col("one.component") != F.col("two.component")))


def one_of_each(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text",
                propose: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its class of near copies.

    ``propose`` takes the texts (``node, text``) and the words of a shingle and gives further pairs ``a, b`` to verify.
    An id names a document: repeated rows of an id stay or go together, and go only if none of them holds its class. A row
    without an id goes if its class has one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("node"))
    texts = docs.select(F.xxhash64(text).alias("node"), text.alias("text"))
    nodes = write_scratch(rows.groupBy("node").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")), "nodes")
    found = components(links(texts, words, propose(texts, words) if propose else None))
    named = write_scratch(
        nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "named-nodes")
    holders = named.groupBy("component").agg(F.min("id").alias("holder"))
    classes = write_scratch(named.join(holders, "component").select("node", "n", "holder"), "classes")
    placed = with_group(rows, classes, "node", "n", rows.count())
    ids = placed.where("doc_id is not null").groupBy("doc_id").agg(F.bool_and(F.col("doc_id") != F.col("holder")).alias("goes"))
    gone = ids.where("goes").select(F.col("doc_id").alias("_id"), F.lit(None).cast("bigint").alias("_node")).unionByName(
        placed.where("doc_id is null and holder is not null").select(F.col("doc_id").alias("_id"), F.col("node").alias("_node"))
        .distinct())
    own = F.when(F.col(id_col).isNull(), F.xxhash64(text))
    on = F.col(id_col).eqNullSafe(F.col("_id")) & own.eqNullSafe(F.col("_node"))
    return docs.join(few(write_scratch(gone, "gone")), on, "left_anti")
