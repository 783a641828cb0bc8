"""Merkle manifest of a dataset: a digest tree for each source and one over the sources.

Every row is a leaf. A source's leaves stand in order of their ids; while more than one node remains, every 16 consecutive
ones become the digest of their digests. The last node of each source, in order of the sources, is a node of a last tree of
the same kind. A row's proof is the list of siblings on its way up; folding its leaf with them must give the root.

Each level is one window over the nodes of a run. Columns at fixed offsets (lag and lead 1 to 15), masked by a node's slot
and by the length of its run, hold its siblings; the first node of a run hashes the parent from its leads. A run has 16 rows
at most, so no task holds a source. Places within a source come from rows dealt by range over source, id and leaf, numbered
within a range and moved by the counts of the ranges before. Levels are written to the shared folder and shrink sixteenfold;
the way down joins the siblings' digests of a run to its 16 children, so no level's siblings are stored for every row.

Defined cases: a null in any column is ``-`` in the leaf, an empty text is ``0:``; null sources come first and are one
source; rows without an id come first in their source and are never tampered with; rows of equal ids stand in order of
their leaves, equal rows are separate leaves with proofs of their own; texts of any length are hashed whole; an empty table
gives no rows and has no root; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfit.llm.common import ascii_lower, crc_fold, documents, few, write_scratch
from lumenfit.llm.registry import query
from lumenfit.operators.index import with_dense_index

BITS = 4
ARITY = 1 << BITS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def _none() -> Column:
    return F.lit("").cast("binary")


def digest(value: Column) -> Column:
    return F.unhex(F.sha2(value, 256))


def hex_text(value: Column) -> Column:
    return F.lower(F.hex(value))


def node_digest(children: Column) -> Column:
    """The digest of concatenated digests, which count as hexadecimal text."""
    return digest(hex_text(children))


def encoded(col: Column) -> Column:
    text = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(cols: Sequence[Column]) -> Column:
    return digest(F.concat(*map(encoded, cols)))


def _siblings(nodes: DataFrame) -> tuple[Column, list[Column], list[Column]]:
    """A node's slot in its run, and its siblings before and after it, empty where there are none."""
    slot = F.col("i") % ARITY
    length = F.least(F.lit(ARITY), F.col("n") - F.col("i") + slot)
    run = W.partitionBy("tree", "run").orderBy("i")
    before = [F.when(slot >= k, F.lag("digest", k).over(run)).otherwise(_none()) for k in range(ARITY - 1, 0, -1)]
    after = [F.when(slot + k < length, F.lead("digest", k).over(run)).otherwise(_none()) for k in range(1, ARITY)]
    return slot, before, after


def _in_runs(nodes: DataFrame) -> DataFrame:
    """Nodes of trees that have more than one left."""
    return nodes.where("n > 1").withColumn("run", F.shiftright("i", BITS))


def _parents(nodes: DataFrame) -> DataFrame:
    slot, _, after = _siblings(nodes)
    heads = _in_runs(nodes).select("tree", "run", "n", slot.alias("slot"), "digest", F.concat(*after).alias("rest"))
    return heads.where("slot = 0").select(
        "tree", F.col("run").alias("i"), F.shiftright(F.col("n") + (ARITY - 1), BITS).alias("n"),
        node_digest(F.concat("digest", "rest")).alias("digest"),
    )


def climb(leaves: DataFrame) -> list[DataFrame]:
    """The levels above stored nodes ``tree, i, n, digest`` (place in and size of a level), those first."""
    levels, most = [leaves], leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        levels.append(write_scratch(_parents(levels[-1]), "merkle-level"))
        most = -(-most // ARITY)
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """``tree, digest``: the last node of every tree."""
    found = [level.where("n = 1").select("tree", "digest") for level in levels]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def with_paths(levels: list[DataFrame], ends: DataFrame | None = None) -> DataFrame:
    """The lowest level's rows with ``path``, the siblings before and after on every level from their own to the end.

    ``ends`` has ``tree``, the ``path`` that goes on above each tree's last node, and columns to hand down; without it
    paths end there.
    """
    handed = [c for c in ends.columns if c not in ("tree", "path")] if ends else []
    nothing = F.array().cast("array<struct<before:binary,after:binary>>")
    above = None
    for depth in range(len(levels) - 1, -1, -1):
        nodes = levels[depth]
        last = nodes.where("n = 1")
        last = last.join(ends, "tree") if ends else last.withColumn("path", nothing)
        found = last.select(*nodes.columns, *handed, "path")
        if above is not None:
            _, before, after = _siblings(nodes)
            step = F.struct(F.concat(*before).alias("before"), F.concat(*after).alias("after"))
            own = _in_runs(nodes).withColumn("step", step)
            parent = above.select("tree", F.col("i").alias("run"), *handed, F.col("path").alias("rest"))
            joined = own.join(parent, ["tree", "run"]).withColumn("path", F.concat(F.array("step"), F.col("rest")))
            found = joined.select(*nodes.columns, *handed, "path").unionByName(found)
        above = write_scratch(found, "merkle-paths") if depth > 1 else found
    return above


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings give."""
    return F.aggregate(path, leaf, lambda at, s: node_digest(F.concat(s["before"], at, s["after"])))


def proof_digest(path: Column) -> Column:
    whole = F.aggregate(path, _none(), lambda at, s: F.concat(at, s["before"], s["after"]))
    return F.sha2(hex_text(whole), 256)


def _placed(rows: DataFrame) -> DataFrame:
    """``tree, i, n`` for rows of ``tree, doc_id, digest`` and more: the place within the source and its size."""
    order = ["doc_id", "digest", "tie"]
    stored = write_scratch(rows.withColumn("tie", F.monotonically_increasing_id()), "merkle-leaves")
    dealt = write_scratch(
        stored.repartitionByRange("tree", *order).withColumn("part", F.spark_partition_id()), "merkle-ranges"
    )
    sizes = dealt.groupBy("tree", "part").agg(F.count("*").alias("size"))
    tree = W.partitionBy("tree")
    before = F.sum("size").over(tree.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    offsets = write_scratch(
        sizes.select("tree", "part", F.coalesce(before, F.lit(0)).alias("before"), F.sum("size").over(tree).alias("n")),
        "merkle-offsets",
    )
    local = F.row_number().over(W.partitionBy("tree", "part").orderBy(*order)) - 1
    found = dealt.withColumn("local", local).join(few(offsets), ["tree", "part"])
    return write_scratch(found.withColumn("i", F.col("local") + F.col("before")).drop("local", "before", "part", "tie"), "merkle-placed")


def manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, changed: dict[str, Column] | None = None,
             id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``doc_id, leaf, subroot, root, path, candidate``, digests as 32 bytes, of every row.

    ``candidate`` is the leaf of the row with the columns of ``changed`` in place of its own: :func:`fold` it with the path
    to see whether the row still belongs to the root.
    """
    leaf = leaf_digest([F.col(c) for c in columns])
    other = leaf_digest([(changed or {}).get(c, F.col(c)) for c in columns])
    tree = F.coalesce(F.concat(F.lit("1"), F.col(source_col).cast("string")), F.lit("0"))  # orders as the source, null first
    rows = docs.select(tree.alias("tree"), F.col(id_col).alias("doc_id"), leaf.alias("digest"), other.alias("candidate"))
    levels = climb(_placed(rows))
    sources = write_scratch(with_dense_index(tops(levels).withColumnRenamed("tree", "name"), ["name"], "i"), "merkle-sources")
    forest = climb(sources.select(F.lit("").alias("tree"), "i", F.lit(sources.count()).cast("bigint").alias("n"), "digest", "name"))
    root = tops(forest).first()
    ends = with_paths(forest).select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "path")
    found = with_paths(levels, write_scratch(ends, "merkle-ends"))
    top = F.lit(root["digest"] if root else None).cast("binary")
    return found.select("doc_id", F.col("digest").alias("leaf"), "subroot", top.alias("root"), "path", "candidate")


_ENC = "coalesce(strlen({0}::varchar)::varchar || ':' || {0}::varchar, '-')"
_LEAF = "sha256(" + " || ".join(_ENC.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {})"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# CRC-32 of the id's decimal digits, a byte and then a bit at a time.
_CRC = """xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint), lambda a, b:
  list_reduce(range(8), lambda x, y: if(x % 2 = 1, xor(x // 2, 3988292384), x // 2), xor(a, b)), 4294967295::bigint), 4294967295)"""
# Nodes of all levels, then runs of 16 with their digests, then a row's walk up through them.
_UP = """{0}(tree, lvl, i, n, d) as (
    {1}
  union all
    select tree, lvl + 1, i // 16, max((n + 15) // 16), sha256(string_agg(d, '' order by i)) from {0} where n > 1
    group by tree, lvl, i // 16)"""
_WALK = """{0}(k, tree, lvl, i, n, cur, proof) as (
    {1}
  union all
    select k, w.tree, w.lvl + 1, w.i // 16, (w.n + 15) // 16,
      sha256(array_to_string(ds[: w.i % 16], '') || cur || array_to_string(ds[w.i % 16 + 2 :], '')),
      proof || array_to_string(ds[: w.i % 16], '') || array_to_string(ds[w.i % 16 + 2 :], '')
    from {0} w join {2} r on r.tree = w.tree and r.lvl = w.lvl and r.run = w.i // 16 where w.n > 1)"""


@query("op12_merkle_manifest", f"""
with recursive docs as (
  select *, coalesce('1' || source, '0') as tree, {_LEAF.format(_ENC.format("text"))} as leaf,
    coalesce({_CRC} % 5 = 0, false) as hit from documents),
leaves as (
  select *, row_number() over (order by tree, doc_id nulls first, leaf) as k,
    row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by tree) as n,
    case when hit then {_LEAF.format(_ENC.format(_LOWER))} else leaf end as candidate from docs),
{_UP.format("up", "select tree, 0, i, n, leaf from leaves")},
runs as (select tree, lvl, i // 16 as run, list(d order by i) as ds from up where n > 1 group by tree, lvl, i // 16),
subs as (select tree as name, d, row_number() over (order by tree) - 1 as i, count(*) over () as n from up where n = 1),
{_UP.format("top", "select '', 0, i, n, d from subs")},
top_runs as (select tree, lvl, i // 16 as run, list(d order by i) as ds from top where n > 1 group by tree, lvl, i // 16),
{_WALK.format("low", "select k, tree, 0, i, n, candidate, '' from leaves", "runs")},
{_WALK.format("high", "select k, '', 0, s.i, s.n, cur, proof from low join subs s on s.name = low.tree where low.n = 1", "top_runs")}
select doc_id, leaf, s.d as subroot, t.d as root, sha256(proof) as proof_sha256, cur as folded_root, cur = t.d as verified
from leaves join high using (k) join subs s on s.name = leaves.tree join top t on t.n = 1
where high.n = 1""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    hit = F.coalesce(crc_fold(F.col("doc_id"), 5) == 0, F.lit(False))
    found = manifest(docs, changed={"text": F.when(hit, ascii_lower(F.col("text"))).otherwise(F.col("text"))})
    folded = found.select("doc_id", "leaf", "subroot", "root", fold(F.col("candidate"), F.col("path")).alias("folded"),
                          proof_digest(F.col("path")).alias("proof_sha256"))
    return folded.select(
        "doc_id", hex_text(F.col("leaf")).alias("leaf"), hex_text(F.col("subroot")).alias("subroot"),
        hex_text(F.col("root")).alias("root"), "proof_sha256", hex_text(F.col("folded")).alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )
