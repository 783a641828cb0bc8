"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard, results merged.

Equal vectors are one node, dealt to a shard by a hash of the vector, with the smallest ids that hold it: no result can hold
more than k of them, beside the query's own. A shard's graph is built in numpy: nodes come in batches that search the graph
so far in lock-step, keep a diverse choice of the nodes found, and link back. It is stored as flat arrays (vectors, ids, and
for each layer the neighbours of every node, -1 where there is none) in one row per shard. Queries come in blocks; each
block searches every shard, exact distances in double precision rank what was found, and the best of all shards are merged.

Walks work on a shard's vectors less their mean, scaled by a power of two, in double precision, so neither the size of the
numbers nor a common offset costs candidates; a query that finds fewer than k in a shard that has more is compared with all of it.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part; vectors of another
length meet only their like; equal distances go to the smaller id; repeated rows of an id and a vector count once; a query
does not find its own id; fewer candidates than k give them all; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfit.llm.common import ship_code, write_scratch
from lumenfit.llm.registry import query

LINKS = 16  # neighbours per node and layer; twice as many in the lowest
BUILD_WIDTH, SEARCH_WIDTH = 80, 160  # candidates kept while building and searching
SHARD_ROWS = 8_192  # nodes of a shard, on average
BLOCK_ROWS = 512  # queries of a block, on average
STEP = 4  # candidates expanded at a time
FIRST, BATCH = 256, 512  # nodes linked exactly at first, and most nodes inserted at a time

INDEX = "dim int, shard int, n int, vectors binary, id_ends binary, ids binary, layers int, links binary, entry int"


def _dist(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances of each query to its own candidates (queries, candidates, dim)."""
    d = x - q[:, None, :]
    return np.einsum("ijk,ijk->ij", d, d)


def _walk(x: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of one layer for all queries at once: ids and distances, nearest first, -1 where none."""
    n = len(q)
    rows = np.arange(n)[:, None]
    seen = np.zeros((n, len(x) + 1), dtype=bool)  # the last column takes the -1s
    seen[:, -1] = True
    ids = np.full((n, width), -1)
    dist = np.full((n, width), np.inf, x.dtype)
    start = start[:, :width]
    ids[:, : start.shape[1]] = start
    d = _dist(q, x[start])
    dist[:, : start.shape[1]] = np.where(start >= 0, d, np.inf)
    seen[rows, start] = True
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    open_ = ids >= 0
    active = np.arange(n)
    while len(active):
        # The nearest candidates not yet expanded.
        rank = np.cumsum(open_[active], axis=1)
        take = open_[active] & (rank <= STEP)
        open_[active] &= ~take
        at = np.argsort(~take, axis=1, kind="stable")[:, :STEP]
        picked = np.where(np.take_along_axis(take, at, 1), np.take_along_axis(ids[active], at, 1), -1)
        near = np.where(picked[:, :, None] >= 0, links[picked], -1).reshape(len(active), -1)
        near = np.sort(near, axis=1)  # two expanded nodes may share a neighbour
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[active[:, None], near]] = -1
        seen[active[:, None], near] = True
        some = (near >= 0).any(axis=0)
        near = near[:, some]
        if near.shape[1]:
            d = np.where(near >= 0, _dist(q[active], x[near]), np.inf)
            all_ids, all_dist = np.concatenate([ids[active], near], 1), np.concatenate([dist[active], d], 1)
            all_open = np.concatenate([open_[active], near >= 0], 1)
            order = np.argsort(all_dist, axis=1, kind="stable")[:, :width]
            ids[active] = np.take_along_axis(all_ids, order, 1)
            dist[active] = np.take_along_axis(all_dist, order, 1)
            open_[active] = np.take_along_axis(all_open, order, 1)
        active = active[open_[active].any(axis=1)]
    return np.where(np.isfinite(dist), ids, -1), dist


def _unit(x: np.ndarray) -> tuple[float, np.ndarray, float]:
    """A scale, a centre of what is scaled by it, and another scale, for :func:`_moved` to bring vectors near zero."""
    first = 2.0 ** -np.frexp(np.abs(x).max(initial=0.0))[1].clip(-1000, 1000)
    centre = (x * first).mean(axis=0)
    second = 2.0 ** -np.frexp(np.abs(x * first - centre).max(initial=0.0))[1].clip(-1000, 1000)
    return first, centre, second


def _moved(x: np.ndarray, unit: tuple[float, np.ndarray, float]) -> np.ndarray:
    """Vectors in a shard's own measure; distances keep their order. Queries far outside are brought to its rim."""
    first, centre, second = unit
    return np.clip((x * first - centre) * second, -1e100, 1e100)


def _exact(x: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Distances in double precision; powers of two keep squares in range and change no digit."""
    d = x - vector
    size = 2.0 ** np.frexp(np.abs(d).max(axis=1, initial=0.0))[1].clip(-1000, 1000)
    d = d / size[:, None]
    return np.sqrt((d**2).sum(axis=1)) * size


def _diverse(x: np.ndarray, nodes: np.ndarray, ids: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (nearest first) those that are nearer to the node than to any chosen before, then the rest."""
    y = x[ids] - x[nodes][:, None, :]  # from the node: far from zero, differences of squares would lose the near ones
    norm = np.einsum("ijk,ijk->ij", y, y)
    between = norm[:, :, None] + norm[:, None, :] - 2 * y @ y.transpose(0, 2, 1)
    chosen = np.zeros(ids.shape, dtype=bool)
    for j in range(ids.shape[1]):
        blocked = (chosen & (between[:, j, :] < dist[:, j : j + 1])).any(axis=1)
        chosen[:, j] = (ids[:, j] >= 0) & ~blocked & (chosen.sum(axis=1) < most)
    order = np.argsort(np.where(ids >= 0, ~chosen, 2), axis=1, kind="stable")[:, :most]
    return np.take_along_axis(ids, order, 1)


class Graph:
    """A shard's graph: ``links[layer]`` holds the neighbours of every node, -1 where there is none."""

    def __init__(self, x: np.ndarray, links: list[np.ndarray], entry: int):
        self.x, self.links, self.entry = x, links, entry

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 5) -> Graph:
        """Insert all vectors (distinct rows), in a random order that depends on the seed alone."""
        r = np.random.default_rng(seed)
        n = len(vectors)
        order = r.permutation(n)
        x = _moved(vectors[order], _unit(vectors))
        levels = np.minimum((-np.log(1 - r.random(n)) / np.log(LINKS)).astype(int), 8)
        levels[0] = levels.max()  # the entry is the first node, on all layers
        layers = levels[0] + 1
        graph = cls(x, [np.full((n, LINKS * (2 if layer == 0 else 1)), -1) for layer in range(layers)], 0)
        first, size = 0, min(FIRST, n)
        while first < n:
            graph._insert(np.arange(first, first + size), levels)
            first += size
            size = min(BATCH, max(FIRST, first // 2), n - first)
        back = np.empty(n, np.int64)
        back[np.arange(n)] = order
        graph._renumber(back)
        graph.x = vectors
        return graph

    def _renumber(self, name: np.ndarray) -> None:
        """Nodes get the numbers of their vectors."""
        for layer, links in enumerate(self.links):
            out = np.full_like(links, -1)
            out[name] = np.where(links >= 0, name[links], -1)
            self.links[layer] = out
        self.entry = int(name[self.entry])

    def _insert(self, new: np.ndarray, levels: np.ndarray) -> None:
        q = self.x[new]
        own = np.concatenate([_dist(q[i : i + 16], q[None]) for i in range(0, len(q), 16)])  # distances among the new nodes
        np.fill_diagonal(own, np.inf)
        start = np.full((len(new), 1), self.entry)
        for layer in range(len(self.links) - 1, -1, -1):
            here = levels[new] >= layer
            if new[0] == 0:  # the first nodes find each other exactly
                ids, dist = np.zeros((len(new), 0), np.int64), np.zeros((len(new), 0))
            else:
                ids, dist = _walk(self.x, self.links[layer], q, start, BUILD_WIDTH)
                start = ids[:, :8]
            if not here.any():
                continue
            at = np.flatnonzero(here)
            peers = own[np.ix_(at, at)]
            k = min(len(at), LINKS * 2)
            near = np.argsort(peers, axis=1, kind="stable")[:, :k]
            near_dist = np.take_along_axis(peers, near, 1)
            near = np.where(np.isfinite(near_dist), new[at][near], -1)
            ids_here, dist_here = np.concatenate([ids[at], near], 1), np.concatenate([dist[at], near_dist], 1)
            dist_here = np.where(ids_here >= 0, dist_here, np.inf)
            by = np.argsort(dist_here, axis=1, kind="stable")[:, :BUILD_WIDTH]
            ids_here, dist_here = np.take_along_axis(ids_here, by, 1), np.take_along_axis(dist_here, by, 1)
            self._link(layer, new[at], _diverse(self.x, new[at], ids_here, dist_here, LINKS))

    def _link(self, layer: int, nodes: np.ndarray, chosen: np.ndarray) -> None:
        """Set the new nodes' neighbours and link back; a node with too many keeps a diverse choice."""
        links = self.links[layer]
        most = links.shape[1]
        links[nodes, : chosen.shape[1]] = chosen
        ok = chosen >= 0
        target, source = chosen[ok], np.repeat(nodes, ok.sum(axis=1))
        order = np.lexsort((source, target))
        target, source = target[order], source[order]
        which, starts, counts = np.unique(target, return_index=True, return_counts=True)
        wide = np.full((len(which), most + counts.max(initial=0)), -1)
        wide[:, :most] = links[which]
        slot = np.arange(len(target)) - np.repeat(starts, counts)
        wide[np.repeat(np.arange(len(which)), counts), most + slot] = source
        wide = np.sort(wide, axis=1)[:, ::-1]
        wide[:, 1:][wide[:, 1:] == wide[:, :-1]] = -1
        for first in range(0, len(which), 256):
            rows, ids = which[first : first + 256], wide[first : first + 256]
            dist = np.where(ids >= 0, _dist(self.x[rows], self.x[ids]), np.inf)
            by = np.argsort(dist, axis=1, kind="stable")
            ids, dist = np.take_along_axis(ids, by, 1), np.take_along_axis(dist, by, 1)
            used = int((ids >= 0).sum(axis=1).max())
            out = np.full((len(rows), most), -1)
            full = (ids >= 0).sum(axis=1) > most
            out[~full, : min(used, most)] = ids[~full, : min(used, most)]
            if full.any():
                out[full] = _diverse(self.x, rows[full], ids[full][:, :used], dist[full][:, :used], most)
            links[rows] = out

    def search(self, q: np.ndarray, width: int) -> np.ndarray:
        """Node numbers near each query, -1 where none; at most ``width``."""
        unit = _unit(self.x)
        x, q = _moved(self.x, unit), _moved(q, unit)
        start = np.full((len(q), 1), self.entry)
        for layer in range(len(self.links) - 1, 0, -1):
            start = _walk(x, self.links[layer], q, start, 8)[0]
        return _walk(x, self.links[0], q, start, width)[0]


def usable(vector: Column) -> Column:
    """Vectors that take part: of finite components, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _nodes(rows: DataFrame, keep: int, shards: int) -> DataFrame:
    """``dim, shard, vector, ids``: one row per distinct vector with its ``keep`` smallest ids."""
    place = F.dense_rank().over(W.partitionBy("vector").orderBy("id"))
    few = rows.withColumn("place", place).where(F.col("place") <= keep)
    nodes = few.groupBy("vector").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    return nodes.select(F.size("vector").alias("dim"), F.pmod(F.hash("vector"), F.lit(shards)).alias("shard"), "vector", "ids")


def _build_shard(table: pa.Table) -> pa.Table:
    dim, shard = table.column("dim")[0].as_py(), table.column("shard")[0].as_py()
    vectors = table.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, dim)
    order = np.lexsort(vectors.T[::-1])  # the same graph however the rows come
    ids = table.column("ids").combine_chunks().take(pa.array(order))
    vectors = np.ascontiguousarray(vectors[order])
    graph = Graph.build(vectors)
    ends = np.cumsum(np.asarray(ids.value_lengths()))
    values = {
        "dim": [dim], "shard": [shard], "n": [len(vectors)], "vectors": [vectors.astype("<f8").tobytes()],
        "id_ends": [ends.astype("<i8").tobytes()], "ids": [ids.flatten().to_numpy().astype("<i8").tobytes()],
        "layers": [len(graph.links)], "links": [b"".join(x.astype("<i4").tobytes() for x in graph.links)], "entry": [graph.entry],
    }
    kinds = {"dim": pa.int32(), "shard": pa.int32(), "n": pa.int32(), "layers": pa.int32(), "entry": pa.int32()}
    return pa.table({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in values.items()})


def build_index(vectors: DataFrame, k: int = 10, shard_rows: int = SHARD_ROWS, id_col: str = "vec_id",
                vector_col: str = "embedding") -> DataFrame:
    """The stored index: one row per shard (and vector length), for searches of up to ``k`` neighbours."""
    ship_code(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector")))
    # Zero and minus zero are equal.
    rows = rows.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    shards = max(1, -(-rows.count() // shard_rows))
    nodes = _nodes(rows, k + 1, shards)
    return write_scratch(nodes.groupBy("dim", "shard").applyInArrow(_build_shard, INDEX), "hnsw-index")


def search_index(index: DataFrame, queries: DataFrame, k: int = 10, width: int = SEARCH_WIDTH, block_rows: int = BLOCK_ROWS,
                 id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` nearest found, by Euclidean distance."""
    rows = queries.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector"))).distinct()
    blocks = max(1, -(-rows.count() // block_rows))
    keyed = rows.select(F.size("vector").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), "id", "vector")
    grouped = keyed.groupBy("dim", "block").agg(  # about block_rows queries each
        F.array_sort(F.collect_list(F.struct("id", "vector"))).alias("queries")
    )
    shards = index.select("dim", "shard").distinct()
    # Every block meets every shard of its length: an equi-join on the shard's key, blocks copied to the shards.
    pairs = write_scratch(grouped.join(shards, "dim"), "query-blocks").join(index, ["dim", "shard"])
    slim = pairs.select(
        F.col("queries.id").alias("query_ids"), F.flatten("queries.vector").alias("query_vectors"), *index.columns
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield from _search_rows(b.slice(i, 1), k, width)

    found = slim.mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    place = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    best = found.distinct().withColumn("rank", place).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def _candidates(x, ends, ids, nodes, vector, query_id) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the nodes, but for the query's own, and their distances."""
    counts = ends[nodes] - np.where(nodes > 0, ends[nodes - 1], 0)
    own = np.concatenate([ids[ends[v] - c : ends[v]] for v, c in zip(nodes, counts)]) if len(nodes) else ids[:0]
    other = own != query_id
    return own[other], np.repeat(_exact(x[nodes], vector), counts)[other]


def _search_rows(row: pa.RecordBatch, k: int, width: int) -> Iterator[pa.RecordBatch]:
    one = {c: row.column(c)[0] for c in row.schema.names}
    n, dim, layers = one["n"].as_py(), one["dim"].as_py(), one["layers"].as_py()
    x = np.frombuffer(one["vectors"].as_buffer(), "<f8").reshape(n, dim)
    ends, ids = np.frombuffer(one["id_ends"].as_buffer(), "<i8"), np.frombuffer(one["ids"].as_buffer(), "<i8")
    flat = np.frombuffer(one["links"].as_buffer(), "<i4").astype(np.int64)
    low = n * LINKS * 2
    links = [flat[:low].reshape(n, -1), *(flat[low + i * n * LINKS : low + (i + 1) * n * LINKS].reshape(n, -1) for i in range(layers - 1))]
    query_ids = one["query_ids"].values.to_numpy(zero_copy_only=False)
    queries = one["query_vectors"].values.to_numpy(zero_copy_only=False).reshape(-1, dim)
    graph = Graph(x, links, one["entry"].as_py())
    for first in range(0, len(queries), BATCH):
        q, q_ids = queries[first : first + BATCH], query_ids[first : first + BATCH]
        near = graph.search(q, max(width, 2 * k))
        out_q, out_v, out_d = [], [], []
        for qi, vector, nodes in zip(q_ids, q, near):
            nodes = nodes[nodes >= 0]
            own, d = _candidates(x, ends, ids, nodes, vector, qi)
            if len(own) < k and len(nodes) < n:
                own, d = _candidates(x, ends, ids, np.arange(n), vector, qi)
            by = np.lexsort((own, d))[:k]
            out_q.append(np.full(len(by), qi))
            out_v.append(own[by])
            out_d.append(d[by])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (out_q, out_v, out_d)], ["query_id", "vec_id", "score"])


@query("op7_nearest_neighbours")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search_index(build_index(vectors), vectors.where(F.col("vec_id") % 100 == 0))
