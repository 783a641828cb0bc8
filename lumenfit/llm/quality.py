"""Quality of a text: a byte-level convolutional network, written in numpy.

Learned filters slide over the UTF-8 bytes of a whole text. Their responses are max-pooled over overlapping chunks (two
neighbouring half-chunks each); every chunk's vector passes a small hidden layer, and the mean and the maximum of the hidden
units over all chunks are combined into one probability. A filter over one-hot bytes is a table lookup, so a filter bank is one
table per tap.

The network is trained on the driver on a bounded sample of labelled documents, with classes of equal size that are weighted
back to their shares. Sampled texts are learned from whole, a slice at a time; where they have more bytes than a bound, fewer
of them are drawn, whatever their length.

Defined cases: a null or empty text is one chunk of padding and has a score; texts of any length are scored whole, a slice at
a time; of a document labelled more than once the largest label counts; null labels are not used; without labels of both
classes every score is the share of label 1 (0 if there is none); repeated rows give repeated rows; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfit.llm.common import documents, held_out, ship_code
from lumenfit.llm.registry import query
from lumenfit.llm.toxicity import labelled_sample

TAPS, FILTERS, HIDDEN, HALF = 6, 24, 12, 64  # a chunk is two halves: 128 bytes
SAMPLE_ROWS = 1_200  # labelled documents of each class
SAMPLE_BYTES = 64 << 20  # about the most that their texts have in all
EPOCHS, RATE, BATCH = 14, 3e-3, 32
SLICE = 8_192  # halves of a text scored at a time: 512 kB


@dataclass
class Network:
    """``table`` (taps, 256, filters), hidden layer, output layer; ``constant`` replaces the network's score if set."""

    table: np.ndarray
    offset: np.ndarray
    hidden: np.ndarray
    hidden_offset: np.ndarray
    out: np.ndarray
    out_offset: np.ndarray
    constant: float | None = None

    def parts(self) -> list[np.ndarray]:
        return [self.table, self.offset, self.hidden, self.hidden_offset, self.out, self.out_offset]


def new_network(seed: int) -> Network:
    r = np.random.default_rng(seed)
    return Network(
        r.normal(0, 0.3, (TAPS, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32),
        r.normal(0, (2 / FILTERS) ** 0.5, (FILTERS, HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32),
        r.normal(0, 0.3, 2 * HIDDEN).astype(np.float32), np.zeros(1, np.float32),
    )


def _padded(raw: bytes) -> np.ndarray:
    """Bytes with zeros to a whole number of halves, two at least, and for the last taps."""
    halves = max(2, -(-len(raw) // HALF))
    out = np.zeros(halves * HALF + TAPS - 1, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out


def _half_maxima(net: Network, codes: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Largest response of each filter in each half, and its place if asked for."""
    n = len(codes) - TAPS + 1
    total = net.table[0][codes[:n]]
    for tap in range(1, TAPS):
        total += net.table[tap][codes[tap : tap + n]]
    total = total.reshape(-1, HALF, FILTERS)
    if not where:
        return total.max(axis=1), None
    at = total.argmax(axis=1)
    return np.take_along_axis(total, at[:, None, :], 1)[:, 0, :], at


def _chunks(net: Network, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled responses and hidden units of the overlapping chunks."""
    pooled = np.maximum(np.maximum(halves[:-1], halves[1:]) + net.offset, 0)
    return pooled, np.maximum(pooled @ net.hidden + net.hidden_offset, 0)


def score(net: Network, text: str) -> float:
    """Probability of label 1, over the whole text."""
    if net.constant is not None:
        return net.constant
    codes = _padded(text.encode())
    total, top, chunks, last = np.zeros(HIDDEN), np.zeros(HIDDEN, np.float32), 0, None
    for first in range(0, len(codes) - TAPS + 1, SLICE * HALF):
        halves, _ = _half_maxima(net, codes[first : first + SLICE * HALF + TAPS - 1])
        halves = halves if last is None else np.concatenate([last, halves])
        last = halves[-1:]
        _, hidden = _chunks(net, halves)
        if len(hidden):
            total += hidden.sum(axis=0)
            top, chunks = np.maximum(top, hidden.max(axis=0)), chunks + len(hidden)
    margin = float(np.r_[total / chunks, top] @ net.out + net.out_offset[0])
    return float(1 / (1 + np.exp(-np.clip(margin, -500, 500))))


def _gradient(net: Network, codes: np.ndarray, label: int, weight: float, grads: list[np.ndarray]) -> None:
    """Add one document's gradient of the weighted log loss."""
    parts = [_half_maxima(net, codes[first : first + SLICE * HALF + TAPS - 1], where=True)
             for first in range(0, len(codes) - TAPS + 1, SLICE * HALF)]
    halves, at = (np.concatenate(x) for x in zip(*parts))
    pooled, hidden = _chunks(net, halves)
    best = hidden.argmax(axis=0)
    features = np.r_[hidden.mean(axis=0), hidden[best, np.arange(HIDDEN)]]
    margin = features @ net.out + net.out_offset[0]
    slack = weight * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label)
    g_table, g_offset, g_hidden, g_hidden_offset, g_out, g_out_offset = grads
    g_out += slack * features
    g_out_offset += slack
    back = np.repeat(slack * net.out[None, :HIDDEN] / len(hidden), len(hidden), axis=0)
    back[best, np.arange(HIDDEN)] += slack * net.out[HIDDEN:]
    back = back * (hidden > 0)
    g_hidden += pooled.T @ back
    g_hidden_offset += back.sum(axis=0)
    to_filter = (back @ net.hidden.T) * (pooled > 0)
    g_offset += to_filter.sum(axis=0)
    # Each chunk's filter response came from one place: the better half's best position.
    second = halves[1:] > halves[:-1]
    half = np.arange(len(second))[:, None] + second
    f = np.broadcast_to(np.arange(FILTERS), half.shape)
    place = half * HALF + at[half, f]
    live = np.flatnonzero(to_filter.ravel())
    place, f, g = place.ravel()[live], f.ravel()[live], to_filter.ravel()[live]
    for tap in range(TAPS):
        cell = codes[place + tap].astype(np.int64) * FILTERS + f
        g_table[tap] += np.bincount(cell, g, 256 * FILTERS).reshape(256, FILTERS)


def train(texts: list[str], labels: np.ndarray, weights: np.ndarray, seed: int = 11) -> Network:
    """Minibatch training with adaptive rates; the same input gives the same network."""
    net, r = new_network(seed), np.random.default_rng(seed)
    codes = [_padded(t.encode()) for t in texts]
    params = net.parts()
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, steps = 0, EPOCHS * -(-len(texts) // BATCH)
    for _ in range(EPOCHS):
        order = r.permutation(len(texts))
        for first in range(0, len(order), BATCH):
            grads = [np.zeros_like(p) for p in params]
            for i in order[first : first + BATCH]:
                _gradient(net, codes[i], int(labels[i]), float(weights[i]) / BATCH, grads)
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            for p, g, a, b in zip(params, grads, m, v):
                a *= 0.9
                a += 0.1 * g
                b *= 0.99
                b += 0.01 * g * g
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return net


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", id_col: str = "doc_id", text_col: str = "text",
        sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Network:
    """Train on ``labels`` (``doc_id`` and the target, 0 or 1) of documents.

    About ``sample_rows`` documents of each class come to the driver, or fewer where they have over ``sample_bytes`` in all.
    """
    ship_code(docs.sparkSession)
    totals = dict(labels.where(F.col(target).isin(0, 1)).groupBy(F.col(target).cast("int")).count().collect())
    sample = labelled_sample(docs, labels, target, sample_rows, id_col, text_col)
    place = W.partitionBy("label").orderBy(F.xxhash64(F.lit(1), "text"), "text").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.octet_length("text")).over(place), F.lit(0))  # over a bounded table
    sample = sample.withColumn("before", before).where(F.col("before") < max(1, sample_bytes // 2)).select("label", "text")
    sample = sample.orderBy("label", "text").toArrow()
    label = sample.column("label").to_numpy()
    sizes = np.bincount(label, minlength=2)
    if not sizes.all():
        net = new_network(0)
        net.constant = float(sizes[1] > 0)
        return net
    weight = np.array([totals[0] / sizes[0], totals[1] / sizes[1]])[label]
    return train(sample.column("text").to_pylist(), label, weight / weight.mean())


def predict(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every row, in one pass without a shuffle."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = slim.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [score(shared.value, t.as_py() or "") for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, score double")


@query("op9_quality")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = documents(spark, sf_dir), held_out(F.col("doc_id"), 5, 0)
    net = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~fold))
    found = predict(docs, net)
    return found.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
