"""Toxicity of a text: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Texts are lower-cased, white space runs become one space, and the distinct character n-grams of a whole text are hashed into
buckets. Spark counts the labelled documents of each class that hold a bucket; the smoothed log-ratio of the two rates is the
bucket's scale. A logistic regression over the scaled presence of the most telling buckets is fitted in numpy on a bounded
sample; a document's score is the sigmoid of the sum of its buckets' weights, which are broadcast.

Defined cases: a null or empty text has no n-grams and gets the score of the bias; texts of any length are scored whole; of a
document labelled more than once the largest label counts; null labels are not used; without labels of both classes every
score is the share of label 1 (0 if there is none); repeated rows give repeated rows; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfit.llm.common import documents, hash_sample, held_out, ship_code, write_scratch
from lumenfit.llm.registry import query

BITS = 20  # buckets of n-grams: 2^20 weights, 4 MB
ORDERS = (3, 4, 5)
SAMPLE_ROWS = 4_000  # labelled documents of each class used for fitting
FEATURES = 30_000  # buckets that get a weight, fewer than 2^16
LEAST_DOCS = 4  # sampled documents that hold such a bucket
ROUNDS, PENALTY = 150, 3e-4

_SPACE = re.compile(r"\s+")


@dataclass(frozen=True)
class LinearModel:
    """Weight of each bucket's presence (scale included) and the bias."""

    weights: np.ndarray
    bias: float


class _Grams:
    """Distinct n-gram buckets of a text."""

    def __init__(self):
        self.seen = np.zeros(1 << BITS, dtype=bool)

    def __call__(self, text: str) -> np.ndarray:
        text = _SPACE.sub(" ", f" {text.lower()} ")
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        rolled, out = np.zeros(len(codes), np.uint32), []
        for n in range(1, max(ORDERS) + 1):
            if len(codes) < n:
                break
            rolled = rolled[: len(codes) - n + 1] * np.uint32(0x01000193) ^ codes[n - 1 :]
            if n in ORDERS:
                mixed = (rolled ^ (rolled >> np.uint32(15))) + np.uint32(n * 0x3C6EF372 & 0xFFFFFFFF)
                out.append((mixed * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS))
        if not out:
            return np.zeros(0, np.int64)
        every = np.concatenate(out)
        if len(every) < 20_000:
            return np.unique(every).astype(np.int64)
        self.seen[every] = True
        found = np.flatnonzero(self.seen)
        self.seen[found] = False
        return found


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, rows: int, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``label, text`` of about ``rows`` labelled documents of each class at most; the labels are broadcast to the texts."""
    known = labels.where(F.col(target).isin(0, 1)).groupBy("doc_id").agg(F.max(target).cast("int").alias("label"))
    chosen = hash_sample(known.where("doc_id is not null"), "doc_id", rows, by="label").withColumnRenamed("doc_id", "__id")
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.join(F.broadcast(chosen), F.col("id") == F.col("__id")).select("label", F.coalesce("text", F.lit("")).alias("text"))


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
        sample_rows: int = SAMPLE_ROWS, features: int = FEATURES) -> LinearModel:
    """Fit on ``labels`` (``doc_id`` and the target, 0 or 1) of documents; the driver gets a bounded sample's features."""
    ship_code(docs.sparkSession)
    totals = dict(labels.where(F.col(target).isin(0, 1)).groupBy(F.col(target).cast("int")).count().collect())
    sample = write_scratch(labelled_sample(docs, labels, target, sample_rows, id_col, text_col), "toxicity-sample")
    sizes = dict(sample.groupBy("label").count().collect())
    if set(sizes) != {0, 1}:
        share = float(sizes.get(1, 0) > 0)
        return LinearModel(np.zeros(1 << BITS, np.float32), 50.0 * (2 * share - 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, held = _Grams(), np.zeros((2, 1 << BITS), np.int64)
        for b in batches:
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held[label, grams(text)] += 1
        at = np.flatnonzero(held.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[0, at]), pa.array(held[1, at])], ["bucket", "clean", "toxic"])

    spread = sample.repartition(8)  # a bounded table
    counts = spread.mapInArrow(count, "bucket bigint, clean bigint, toxic bigint").groupBy("bucket")
    counts = counts.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("clean") + F.col("toxic") >= LEAST_DOCS)
    rate1, rate0 = (F.col("toxic") + 1) / F.lit(sizes[1] + 2.0), (F.col("clean") + 1) / F.lit(sizes[0] + 2.0)
    ratio = F.log(rate1 / rate0)
    noise = F.sqrt(1 / (F.col("toxic") + 1) + 1 / (F.col("clean") + 1))  # deviation of the log-ratio by counting
    top = counts.select("bucket", ratio.alias("ratio"), F.abs(ratio / noise).alias("telling")).orderBy(F.desc("telling"), "bucket")
    chosen = top.limit(features).select("bucket", "ratio").toArrow()
    bucket, scale = chosen.column("bucket").to_numpy(), chosen.column("ratio").to_numpy()
    place = np.full(1 << BITS, -1, np.int32)
    place[bucket] = np.arange(len(bucket))
    shared = sample.sparkSession.sparkContext.broadcast(place)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = _Grams()
        for b in batches:
            own = [shared.value[grams(t)] for t in b.column(1).to_pylist()]
            packed = [x[x >= 0].astype("<u2").tobytes() for x in own]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], ["label", "features"])

    rows = spread.mapInArrow(describe, "label int, features binary").orderBy("label", "features").toArrow()
    label = rows.column("label").to_numpy().astype(np.float64)
    packed = rows.column("features").combine_chunks()  # two bytes a feature: some tens of MB
    # Classes weigh as in all labels, not as in the sample.
    weight = np.where(label == 1, totals[1] / sizes[1], totals[0] / sizes[0])
    coef, bias = _logistic(packed, scale, label, weight / weight.sum())
    weights = np.zeros(1 << BITS, np.float32)
    weights[bucket] = coef * scale
    return LinearModel(weights, bias)


CHUNK = 256  # documents whose features are expanded at a time


def _logistic(packed: pa.BinaryArray, scale: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Penalised logistic regression over scaled presences, by full-gradient steps with adaptive rates.

    The features stay packed as two-byte numbers; a few hundred documents are worked on at a time.
    """
    ends = np.r_[0, np.cumsum(np.fromiter((len(x.as_buffer()) // 2 for x in packed), np.int64, len(packed)))]
    at = np.concatenate([np.frombuffer(x.as_buffer(), "<u2") for x in packed])
    parts = [(i, min(i + CHUNK, len(label))) for i in range(0, len(label), CHUNK)]
    coef, bias = np.zeros(len(scale)), float(np.log((weight @ label) / (weight @ (1 - label))))
    m, v = np.zeros(len(scale) + 1), np.zeros(len(scale) + 1)
    for step in range(1, ROUNDS + 1):
        g = np.r_[PENALTY * coef, 0.0]
        effect = coef * scale
        for first, last in parts:
            own = at[ends[first] : ends[last]]
            owner = np.repeat(np.arange(last - first), np.diff(ends[first : last + 1]))
            margin = np.bincount(owner, weights=effect[own], minlength=last - first) + bias
            slack = weight[first:last] * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label[first:last])
            g[:-1] += np.bincount(own, weights=slack[owner], minlength=len(scale)) * scale
            g[-1] += slack.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9) * (1 - step / (ROUNDS + 1))
        coef, bias = coef - move[:-1], bias - float(move[-1])
    return coef, bias


def predict(docs: DataFrame, model: LinearModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every row, in one pass without a shuffle."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = slim.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = _Grams()
        weights, bias = shared.value.weights, shared.value.bias
        for b in batches:
            margin = np.fromiter((weights[grams(t.as_py() or "")].sum(dtype=np.float64) for t in b.column("text")), float, b.num_rows)
            score = 1 / (1 + np.exp(-np.clip(margin + bias, -500, 500)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, score double")


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = documents(spark, sf_dir), held_out(F.col("doc_id"), 5, 0)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~fold))
    found = predict(docs, model)
    return found.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
