"""SimHash fingerprints and near-duplicate classes by a self-join of binary tries.

A fingerprint has a bit set if more than half of the hashes of the document's word shingles have it. Distinct fingerprints
are joined with themselves by walking a binary trie: a pair of nodes carries the number of differing bits so far, the
children of both are paired, and a pair whose count exceeds the budget is dropped. Two fingerprints with at most k
differing bits agree in one of k + 1 equal blocks of bits, so k + 1 tries are walked, each over the bits rotated so that
another block comes first, and each starts from pairs of equal nodes below the first block. That spreads the walk over the
nodes at the first block's depth with k + 1 copies of a fingerprint. A node that holds too many fingerprints for one task
is walked further by Spark: its children become pairs of their own, within the budget, until they are small.

Links found in one task are reduced to a forest there (as many rows as fingerprints at most), and components are found by
star contraction in Spark.

Defined cases: a null or blank text has no words and fingerprint zero, and links like any other; fewer words than a shingle
hold are one shingle; repeated rows and equal texts share a fingerprint and so a class; a null id takes part and counts as
larger than any other, a class without an id has a null one; rows without an id, or rows that share one, are not linked by
that; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfit.llm.common import documents, few, with_group, write_scratch
from lumenfit.llm.components import components
from lumenfit.llm.registry import query

BITS, SEED = 64, 42
NODE_ROWS = 20_000  # fingerprints under one trie node that a single task walks
LEAF_PAIRS = 64  # node pairs with at most so many fingerprint pairs are compared directly
FRONT = 1 << 16  # node pairs walked at a time
COMPARED = 1 << 19  # fingerprint pairs compared at a time: some 30 MB
STEP = 8  # bits by which a full node is walked further in Spark

_HALF = np.arange(BITS, dtype=np.uint64)


def shingle_hashes(text: str | None, words: int) -> list[int]:
    """Hashes of the lower-cased (A-Z) text's word shingles; words are separated by ASCII white space."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return []
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(tokens) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())]


def fingerprint(text: str | None, words: int) -> int:
    """Of the lower-cased (A-Z) text's word shingles; words are separated by ASCII white space."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), SEED)
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(tokens) - words + 1].tolist()
    digest, n = xxhash.xxh64_intdigest, len(starts)
    ones = np.zeros(BITS, dtype=np.int64)
    stops = ends[words - 1 :].tolist()
    for i in range(0, n, 65_536):
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[i : i + 65_536], stops[i : i + 65_536])]
        raw = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << _HALF[2 * ones > n]).sum(dtype=np.uint64)) if n else 0


def fingerprints(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed 64-bit number, one row per row of ``docs``."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in b.column("text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, fp bigint")


def _rotated(fp: Column, by: int) -> Column:
    if by == 0:
        return fp
    return F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, BITS - by))


def _bits(key: Column, start: int, count: int) -> Column:
    return F.shiftrightunsigned(key, BITS - start - count).bitwiseAND((1 << count) - 1)


def _roots(fps: DataFrame, budget: int) -> DataFrame:
    """Node pairs to start from: ``node`` (a name), ``depth``, ``err``, and each fingerprint under it with its ``side``.

    Side 0: both nodes of the pair are the same one. Sides 1 and 2: the two nodes of the pair.
    """
    block = BITS // (budget + 1)
    each = [
        fps.select(
            F.concat(F.lit(f"{r}:"), _bits(_rotated(F.col("fp"), r * block), 0, block).cast("string")).alias("node"),
            F.lit(block).alias("depth"), F.lit(0).alias("err"), F.lit(0).alias("side"),
            _rotated(F.col("fp"), r * block).alias("key"), "id",
        )
        for r in range(budget + 1)
    ]
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return out


def _children(rows: DataFrame, budget: int, depth: int) -> DataFrame:
    """The pairs of nodes STEP bits further down that stay within the budget."""
    step = min(STEP, BITS - depth)
    masks = F.array(*[F.lit(m).cast("bigint") for m in range(1 << step) if bin(m).count("1") <= budget])
    own, other = F.col("own"), F.col("own").bitwiseXOR(F.col("mask"))
    err = (F.col("err") + F.bit_count("mask")).alias("err")
    pair = (
        F.when(F.col("side") == 0, F.concat_ws("-", F.least(own, other), F.greatest(own, other)))
        .when(F.col("side") == 1, F.concat_ws("-", own, other))
        .otherwise(F.concat_ws("-", other, own))
    )
    side = F.when((F.col("side") != 0) | (F.col("mask") == 0), F.col("side")).when(own < other, 1).otherwise(2)
    return (
        rows.withColumn("own", _bits(F.col("key"), depth, step)).withColumn("mask", F.explode(masks))
        .where(F.col("err") + F.bit_count("mask") <= budget)
        .select(F.concat_ws("/", "node", pair).alias("node"), F.lit(depth + step).alias("depth"), err, side.alias("side"),
                "key", "id")
    )


def _node_pairs(fps: DataFrame, budget: int, node_rows: int) -> DataFrame:
    """Node pairs of at most ``node_rows`` fingerprints each (or at full depth), full ones walked further."""
    level, depth, done = _roots(fps, budget), BITS // (budget + 1), None
    while depth < BITS:
        full = write_scratch(
            level.groupBy("node").count().where(F.col("count") > node_rows).select("node"), "full-nodes"
        )
        if full.isEmpty():
            break
        small = level.join(full, "node", "left_anti")
        done = small if done is None else done.unionByName(small)
        level = write_scratch(_children(level.join(full, "node", "left_semi"), budget, depth), "trie-level")
        depth = min(depth + STEP, BITS)
    return level if done is None else done.unionByName(level)


class _Forest:
    """Union-find over positions, so that a task hands on a forest instead of all links."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the ends of all links: hook the larger root on the smaller, halve paths, repeat what is still apart."""
        parent = self.parent
        while len(a):
            a, b = self._root(a), self._root(b)
            apart = a != b
            a, b = a[apart], b[apart]
            if len(a):
                np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))

    def _root(self, x: np.ndarray) -> np.ndarray:
        parent = self.parent
        while True:
            up = parent[parent[x]]
            if np.array_equal(up, parent[x]):
                return up
            parent[x] = up

    def roots(self) -> np.ndarray:
        return self._root(np.arange(len(self.parent)))


def _walk(keys: np.ndarray, roots: np.ndarray, budget: int, forest: _Forest) -> None:
    """Walk node pairs over sorted runs of ``keys`` and join what is within the budget.

    A row of ``roots`` is a node pair: start and end of its two runs of keys, the bits they differ in so far, and the bit
    to look at next. A pair of a node with itself has the same run twice.
    """
    todo = [roots]
    while todo:
        pairs = todo.pop()
        if len(pairs) > FRONT:
            todo += [pairs[FRONT:], pairs[:FRONT]]
            continue
        a0, a1, b0, b1, err, bit = pairs.T
        leaf = ((a1 - a0) * (b1 - b0) <= LEAF_PAIRS) | (bit < 0)
        _compare(keys, pairs[leaf], budget, forest)
        pairs = pairs[~leaf]
        if not len(pairs):
            continue
        a0, a1, b0, b1, err, bit = pairs.T
        am, bm = _split(keys, a0, a1, bit), _split(keys, b0, b1, bit)
        same = (a0 == b0) & (a1 == b1)
        children = [
            np.stack([a0, am, b0, bm, err, bit - 1], 1), np.stack([am, a1, bm, b1, err, bit - 1], 1),
            np.stack([a0, am, bm, b1, err + 1, bit - 1], 1), np.stack([am, a1, b0, bm, err + 1, bit - 1], 1)[~same],
        ]
        below = np.concatenate(children)
        a0, a1, b0, b1, err, bit = below.T
        todo.append(below[(a1 > a0) & (b1 > b0) & (err <= budget)])


def _split(keys: np.ndarray, start: np.ndarray, end: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Where in each sorted run, whose keys agree above the bit, the bit becomes one: a binary search in all runs at once."""
    lo, hi = start.copy(), end.copy()
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) // 2
        one = (keys[mid] >> bit[open_].astype(np.uint64)) & np.uint64(1) == 1
        hi[open_[one]] = mid[one]
        lo[open_[~one]] = mid[~one] + 1


def _compare(keys: np.ndarray, pairs: np.ndarray, budget: int, forest: _Forest) -> None:
    """Compare every key of one run with every key of the other, COMPARED pairs at a time."""
    if not len(pairs):
        return
    counts = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
    for part in np.split(np.arange(len(pairs)), np.flatnonzero(np.diff(np.cumsum(counts) // COMPARED)) + 1):
        p, c = pairs[part], counts[part]
        which = np.repeat(np.arange(len(p)), c)
        at = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        wide = (p[:, 3] - p[:, 2])[which]
        i, j = p[which, 0] + at // wide, p[which, 2] + at % wide
        near = (i != j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
        forest.add(i[near], j[near])


def _forest_edges(names: np.ndarray, depth: np.ndarray, err: np.ndarray, side: np.ndarray, keys: np.ndarray,
                  ids: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one task's node pairs, as a forest: ids of nodes and of their roots."""
    order = np.lexsort((keys, side, names))
    names, depth, err, side, keys, ids = (x[order] for x in (names, depth, err, side, keys, ids))
    cuts = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]) | (side[1:] != side[:-1])])
    ends = np.r_[cuts[1:], len(names)]
    runs = np.stack([cuts, ends, names[cuts], side[cuts], err[cuts], BITS - 1 - depth[cuts]], 1)
    selves = runs[runs[:, 3] == 0]
    roots = [np.stack([selves[:, 0], selves[:, 1], selves[:, 0], selves[:, 1], selves[:, 4], selves[:, 5]], 1)]
    first, second = runs[runs[:, 3] == 1], runs[runs[:, 3] == 2]
    _, i, j = np.intersect1d(first[:, 2], second[:, 2], assume_unique=True, return_indices=True)
    roots.append(np.stack([first[i, 0], first[i, 1], second[j, 0], second[j, 1], second[j, 4], second[j, 5]], 1))
    forest = _Forest(len(keys))
    _walk(keys, np.concatenate(roots), budget, forest)
    root = forest.roots()
    linked = root != np.arange(len(root))
    return ids[linked], ids[root[linked]]


def links(fps: DataFrame, budget: int = 3, node_rows: int = NODE_ROWS) -> DataFrame:
    """Links ``a, b`` between ids of distinct fingerprints (``fp, id``) that differ in at most ``budget`` bits.

    Not all pairs, but enough of them that two fingerprints are connected if and only if such links connect them.
    """
    pairs = _node_pairs(fps, budget, node_rows)
    slim = pairs.select(F.xxhash64("node").alias("name"), "node", "depth", "err", "side", "key", "id")
    dealt = slim.repartition("name").sortWithinPartitions("name", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush(whole: pa.Table, upto: int) -> pa.RecordBatch:
            t = whole.slice(0, upto)
            nodes = t.column("node").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            cols = [t.column(c).to_numpy().astype(np.int64) for c in ("depth", "err", "side")]
            keys = t.column("key").to_numpy().view(np.uint64)
            a, b = _forest_edges(nodes.astype(np.int64), *cols, keys, t.column("id").to_numpy(), budget)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for b in batches:  # whole nodes only: what follows the last change of node waits for more rows
            held.append(b)
            rows += b.num_rows
            if rows < 4 * NODE_ROWS:
                continue
            table = pa.Table.from_batches(held)
            names = table.column("name").to_numpy()
            last = int(np.searchsorted(names, names[-1]))
            if last:
                yield flush(table, last)
                held, rows = table.slice(last).to_batches(), table.num_rows - last
        if rows:
            yield flush(pa.Table.from_batches(held), rows)

    return dealt.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, words: int = 5, budget: int = 3, id_col: str = "doc_id", text_col: str = "text",
                    node_rows: int = NODE_ROWS) -> DataFrame:
    """``doc_id, fp, component_id``: every row with its fingerprint and the smallest id its links reach."""
    found = _classes(write_scratch(fingerprints(docs, words, id_col, text_col), "fingerprints"), budget, node_rows)
    return found.select("doc_id", "fp", "component_id")


def _classes(prints: DataFrame, budget: int, node_rows: int = NODE_ROWS) -> DataFrame:
    """The stored rows ``doc_id, fp`` with ``component_id``. Fingerprints are the nodes, ids only name what they form."""
    distinct = write_scratch(
        prints.groupBy("fp").agg(F.min("doc_id").cast("bigint").alias("id"), F.count("*").alias("n")), "distinct-fingerprints"
    )
    found = components(links(distinct.select("fp", F.col("fp").alias("id")), budget, node_rows))
    named = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "n", "id", F.coalesce("component", "fp").alias("component")
    )
    named = write_scratch(named, "components")
    sizes = named.groupBy("component").agg(F.min("id").alias("component_id"), F.count("*").alias("size"))
    groups = with_group(named, write_scratch(sizes, "component-ids"), "component", "size", named.count())
    return with_group(prints, write_scratch(groups.select("fp", "n", "component_id"), "classes"), "fp", "n", prints.count())


def candidates(texts: DataFrame, words: int = 5, budget: int = 3) -> DataFrame:
    """Pairs ``a, b`` of nodes of ``texts`` (``node, text``) that connect all nodes whose fingerprints link, for a further check.

    Nodes of one fingerprint are paired with the smallest of them, fingerprints by :func:`links`: at most a pair per node each.
    """
    prints = write_scratch(fingerprints(texts, words, "node", "text").withColumnRenamed("doc_id", "b"), "fingerprints")
    distinct = write_scratch(prints.groupBy("fp").agg(F.min("b").alias("a"), F.count("*").alias("n")), "distinct-fingerprints")
    same = with_group(prints, distinct, "fp", "n", prints.count()).where("a <> b").select("a", "b")
    return same.unionByName(links(distinct.select("fp", F.col("a").alias("id")), budget))


def one_of_each(docs: DataFrame, words: int = 5, budget: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its class.

    An id names a document: repeated rows of an id stay or go together, and go only if none of them holds its class. Rows
    without an id stay unless their class has one; they are known by their texts. Texts are shuffled only if too many rows go
    for a broadcast.
    """
    own = F.when(F.col(id_col).isNull(), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    bare = fingerprints(docs.where(F.col(id_col).isNull()).select(own.alias("own"), text_col), words, "own", text_col)
    prints = write_scratch(fingerprints(docs, words, id_col, text_col), "fingerprints")
    found = write_scratch(_classes(prints, budget).select("doc_id", "fp", "component_id"), "found")
    ids = found.where("doc_id is not null").groupBy("doc_id").agg(F.bool_and(F.col("doc_id") != F.col("component_id")).alias("goes"))
    left = found.where("doc_id is null and component_id is not null").select("fp").distinct()
    gone = ids.where("goes").select(F.col("doc_id").alias("_gone"), F.lit(None).cast("string").alias("_own")).unionByName(
        bare.withColumnRenamed("doc_id", "_own").join(left, "fp").select(F.lit(None).cast("bigint").alias("_gone"), "_own").distinct()
    )
    on = F.col(id_col).eqNullSafe(F.col("_gone")) & own.eqNullSafe(F.col("_own"))
    return docs.join(few(write_scratch(gone, "gone")), on, "left_anti")


@query("op1_simhash_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir), words=3, budget=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
