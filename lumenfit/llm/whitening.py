"""Whitening of vectors on their principal components, found by spectral divide and conquer.

Entries become whole numbers, so that sums are exact in any order. Spark sums them, then sums the products of centred
vectors; the covariance (one number for each pair of dimensions) is split recursively: the polar factor of the covariance
less a shift is the matrix sign, whose half sum with the identity projects on the eigenvectors above the shift. An orthonormal
basis of that subspace and of its complement turns the covariance into two smaller ones. The polar factor comes from the
QR-based dynamically weighted Halley iteration (QDWH), which needs six or seven steps whatever the condition. The mean of a
block's eigenvalues, its trace over its size, is a shift that always splits it unless they are all equal; blocks above the
shift are split first, and those below only while components are wanted. The components are broadcast and a last pass
projects the vectors.

Defined cases: vectors that are null, empty, or hold an entry that is null, not finite or too large for a whole number of 64
bits take no part; all others do, those without an id and repeated ones too; vectors of another length are whitened among
their like; components without variance (an eigenvalue under 1e-12 of the largest) are left out, so that a single vector, or
equal ones, give no rows; of equal eigenvalues any orthonormal basis is right, and the one that comes out depends on the
matrix alone; a component's largest loading is positive; a deviation beyond 64 bits is null; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfit.llm.common import ship_code
from lumenfit.llm.registry import query

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
MAX_DIM = 4_096  # a covariance of that size is 134 MB on the driver and in each task
EPS = float(np.finfo(float).eps)
ROWS = 4_096  # vectors worked on at a time
_LARGE = 2.0**63 - 2.0**20


# -- the eigenproblem -----------------------------------------------------------------------------------------------


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal factor of a symmetric matrix, its matrix sign, by QDWH iteration."""
    size = np.linalg.norm(a)  # at least the largest singular value
    x, low, n = a / size, EPS, len(a)
    eye = np.eye(n)
    for _ in range(30):
        if abs(low - 1) < 10 * EPS:
            break
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        root = np.sqrt(1 + d)
        wa = root + np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q = np.linalg.qr(np.concatenate([np.sqrt(wc) * x, eye]))[0]
        x = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        x = (x + x.T) / 2
        low = min(1.0, low * (wa + wb * square) / (1 + wc * square))
    return x


def _split(a: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Orthonormal bases of the invariant subspaces above and below the shift, and how much they still couple."""
    n = len(a)
    projector = (polar_factor(a - shift * np.eye(n)) + np.eye(n)) / 2
    above = int(round(np.trace(projector)))
    if not 0 < above < n:
        return None
    basis = np.random.default_rng(n).normal(size=(n, above))
    for _ in range(2):
        basis = np.linalg.qr(projector @ basis)[0]
    whole = np.linalg.qr(projector @ basis, mode="complete")[0]
    upper, lower = whole[:, :above], whole[:, above:]
    return upper, lower, float(np.linalg.norm(lower.T @ a @ upper))


def components(cov: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues in falling order, and their unit eigenvectors as columns."""
    scale = np.linalg.norm(cov)
    values: list[float] = []
    vectors: list[np.ndarray] = []
    todo = [((cov + cov.T) / 2, np.eye(len(cov)))]
    while todo and len(values) < most:
        a, basis = todo.pop()
        n = len(a)
        mean = np.trace(a) / n
        spread = np.linalg.norm(a - mean * np.eye(n))
        if n == 1 or spread <= 8 * EPS * scale:
            values += [mean] * n
            vectors.append(basis)
            continue
        best = None
        for nudge in (0.0, 0.05, -0.05, 0.1, -0.1, 0.2, -0.2):  # a shift at an eigenvalue does not split
            found = _split(a, mean + nudge * spread / np.sqrt(n))
            if found is not None and (best is None or found[2] < best[2]):
                best = found
            if best is not None and best[2] <= 8 * n * EPS * scale:
                break
        if best is None:  # equal but for rounding
            values += list(np.diag(a))
            vectors.append(basis)
            continue
        upper, lower, _ = best
        for part in (lower, upper):
            inner = part.T @ a @ part
            todo.append(((inner + inner.T) / 2, basis @ part))
    found = np.concatenate(vectors, axis=1) if vectors else np.zeros((len(cov), 0))
    order = np.argsort(-np.array(values), kind="stable")[:most]
    found = found[:, order]
    top = np.abs(found).argmax(axis=0)
    return np.array(values)[order], found * np.where(found[top, np.arange(found.shape[1])] < 0, -1.0, 1.0)


# -- passes over the vectors ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Whitening:
    """Of vectors of one length: their number, exact sums, projection, shares of variance."""

    n: int
    sums: tuple[int, ...]
    projection: np.ndarray  # dimensions, components
    explained: np.ndarray


def usable(vector: Column) -> Column:
    """Whether all entries are finite and scale to a whole number."""
    fits = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * SCALE < F.lit(_LARGE)))
    return F.coalesce(fits & (F.size(vector) > 0), F.lit(False))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and whole entries of a batch's vectors, a block of one length at a time."""
    column = batch.column("vector")
    sizes = np.asarray(column.value_lengths())
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        for first in range(0, len(rows), ROWS):
            some = rows[first : first + ROWS]
            flat = column.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False)
            yield some, np.floor(SCALE * flat.reshape(-1, size)).astype(np.int64) + OFFSET


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """``n * x - S``: whole numbers, of unbounded size where 64 bits may not do."""
    largest = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    if 2 * n * largest < 1 << 62:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def _summed(rows: DataFrame, work, cell: str) -> DataFrame:
    """Per-task partial sums that ``work`` yields as ``dim, i, j, v``, added up by Spark."""
    return rows.mapInArrow(work, f"dim int, i int, j int, v {cell}").groupBy("dim", "i", "j").agg(F.sum("v").alias("v"))


def _batch(dim: int, i: np.ndarray, j: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    cells = [np.full(len(v), dim, np.int32), i.astype(np.int32), j.astype(np.int32), v]
    return pa.RecordBatch.from_arrays(list(map(pa.array, cells)), ["dim", "i", "j", "v"])


def _sums(rows: DataFrame) -> dict[int, tuple[int, tuple[int, ...]]]:
    """Number and exact sums of the vectors of each length: halves of 32 bits are summed, which do not overflow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for _, x in _matrices(b):
                total = totals.setdefault(x.shape[1], np.zeros((3, x.shape[1]), np.int64))
                total += np.stack([np.full(x.shape[1], len(x)), (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)])
        for dim, total in totals.items():
            i, j = np.indices(total.shape, np.int32).reshape(2, -1)
            yield _batch(dim, i, j, total.ravel())

    found: dict[int, np.ndarray] = {}
    for dim, i, j, v in _summed(rows, run, "bigint").collect():
        found.setdefault(dim, np.zeros((3, dim), object))[i, j] = v
    return {dim: (int(t[0, 0]), tuple(int(a) * (1 << 32) + int(b) for a, b in t[1:].T)) for dim, t in found.items()}


def _products(rows: DataFrame, project) -> dict[int, np.ndarray]:
    """For each length the sum of the outer products of what ``project(dim, x)`` makes of its vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for _, x in _matrices(b):
                y = project(x.shape[1], x)
                if y is None or not y.shape[1]:
                    continue
                gram = y.T @ y
                totals[x.shape[1]] = totals[x.shape[1]] + gram if x.shape[1] in totals else gram
        for dim, total in totals.items():
            i, j = np.triu_indices(len(total))
            yield _batch(dim, i, j, total[i, j])

    found: dict[int, dict] = {}
    for dim, i, j, v in _summed(rows, run, "double").collect():
        found.setdefault(dim, {})[i, j] = v
    out = {}
    for dim, cells in found.items():
        size = max(i for i, _ in cells) + 1
        out[dim] = np.zeros((size, size))
        for (i, j), v in cells.items():
            out[dim][i, j] = out[dim][j, i] = v
    return out


def _vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    rows = table.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.where(usable(F.col("vector")))


def fit(table: DataFrame, most: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> dict[int, Whitening]:
    """The whitening of the vectors of each length; the driver receives sums and covariances, never vectors."""
    ship_code(table.sparkSession)
    rows = _vectors(table, id_col, vector_col).select("vector")
    sums = _sums(rows)
    if any(dim > MAX_DIM for dim in sums):
        raise ValueError(f"vectors of more than {MAX_DIM} entries: {max(sums)}")

    def centred(dim: int, x: np.ndarray) -> np.ndarray:
        n, total = sums[dim]
        return (_deviations(x, n, total) / n).astype(np.float64)

    out = {}
    for dim, gram in _products(rows, centred).items():
        n, total = sums[dim]
        cov = gram / n
        values, vectors = components(cov, min(most, dim))
        real = values > 1e-12 * max(values[0], 0.0)
        values, vectors = values[real], vectors[:, real]
        out[dim] = Whitening(n, total, vectors / np.sqrt(values), values / np.trace(cov))
    return out


def identity_error(table: DataFrame, found: dict[int, Whitening], id_col: str = "vec_id",
                   vector_col: str = "embedding") -> dict[int, float]:
    """For each length the largest entry of the whitened vectors' covariance less the identity.

    Whitened vectors are centred as they are: exact sums are taken off before projecting.
    """
    shared = table.sparkSession.sparkContext.broadcast(found)

    def whitened(dim: int, x: np.ndarray) -> np.ndarray | None:
        w = shared.value.get(dim)
        return None if w is None else (_deviations(x, w.n, w.sums) / w.n).astype(np.float64) @ w.projection

    grams = _products(_vectors(table, id_col, vector_col).select("vector"), whitened)
    return {dim: float(np.abs(g / found[dim].n - np.eye(len(g))).max()) for dim, g in grams.items()}


def whiten(table: DataFrame, found: dict[int, Whitening], id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, dim, deviation, whitened`` (an array) of every vector that takes part and has components."""
    rows = _vectors(table, id_col, vector_col)
    shared = rows.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in _matrices(b):
                w = shared.value.get(x.shape[1])
                if w is None or not len(w.explained):
                    continue
                d = _deviations(x, w.n, w.sums)
                y = (d / w.n).astype(np.float64) @ w.projection
                if d.dtype == object or float(np.abs(d).max(initial=0)) ** 2 * x.shape[1] >= 2.0**62:
                    square = (d.astype(object) ** 2).sum(axis=1)
                    deviation = pa.array([int(s) if s < 1 << 63 else None for s in square], pa.int64())
                else:
                    deviation = pa.array((d * d).sum(axis=1))
                ends = pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id").take(pa.array(at)), pa.array(np.full(len(y), x.shape[1], np.int32)), deviation,
                     pa.ListArray.from_arrays(ends, pa.array(y.ravel()))], ["vec_id", "dim", "deviation", "whitened"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, dim int, deviation bigint, whitened array<double>")


@query("op11_embedding_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = fit(table)
    errors = identity_error(table, found)
    facts = [(dim, w.n, [float(e) for e in w.explained], errors.get(dim)) for dim, w in found.items() if len(w.explained)]
    shape = "dim int, n bigint, explained array<double>, identity_error double"
    rows = whiten(table, found).join(F.broadcast(spark.createDataFrame(facts, shape)), "dim")  # a row for each length
    flat = rows.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    return flat.select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened",
        F.get("explained", F.col("at")).alias("explained"), "identity_error",
    )
