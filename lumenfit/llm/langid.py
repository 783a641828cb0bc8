"""Language of a text: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and everything but letters becomes a single space. Counts per language and bucket are summed by Spark
over a bounded sample of labelled documents of every language; the matrix of log-probabilities is broadcast, and a batch is
scored in numpy by gathering the matrix rows of its n-grams and adding them up per document.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; texts of any length are scored whole; equal
scores go to the language that sorts first; without labelled documents everything is ``und``; repeated rows give repeated
rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfit.llm.common import documents, hash_sample, held_out, ship_code
from lumenfit.llm.registry import query

UNKNOWN = "und"
BITS = 16  # buckets of n-grams: 2^16 rows of the matrix
ORDERS = (1, 2, 3)
SMOOTHING = 0.1
SAMPLE_ROWS = 5_000  # labelled documents of each language that are counted
BLOCK = 1 << 18  # bytes of text, or characters, worked on at a time: some 25 MB in four languages


@dataclass(frozen=True)
class LanguageModel:
    """Languages in order, and the log-probability of each bucket (rows) in each language (columns)."""

    langs: tuple[str, ...]
    prior: np.ndarray
    log_prob: np.ndarray


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


def _blocks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about BLOCK characters, with the number of the first."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > BLOCK:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, texts[first:]


def _parts(batches: Iterator[pa.RecordBatch], column: int | str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Consecutive rows whose texts come to about BLOCK bytes, with these texts, so that a worker holds few beside its batch."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        first = 0
        while first < b.num_rows:
            before = ends[first - 1] if first else 0
            end = max(first + 1, int(np.searchsorted(ends, before + BLOCK, side="right")))
            part = b.slice(first, end - first)
            yield part, [t or "" for t in part.column(column).to_pylist()]
            first = end


def _grams(texts: list[str]) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Whether each text has a letter, and for each order the n-grams' buckets with the text that each is from, in order."""
    lowered = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, lowered), np.int64, len(texts)))
    letter = _letters()[codes]
    has = np.bincount(owner[letter], minlength=len(texts)) > 0
    keep = letter | np.r_[True, letter[:-1]] | np.r_[True, owner[1:] != owner[:-1]]
    codes, owner = np.where(letter, codes, np.uint32(32))[keep].astype(np.uint32), owner[keep]

    def orders() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        rolled = np.zeros(len(codes), np.uint32)
        for n in range(1, max(ORDERS) + 1):
            rolled = rolled[: len(codes) - n + 1] * np.uint32(0x01000193) ^ codes[n - 1 :]
            if n in ORDERS:
                own = owner[: len(rolled)]
                inside = own == owner[n - 1 :]
                mixed = (rolled ^ (rolled >> np.uint32(15))) + np.uint32(n * 0x3C6EF372 & 0xFFFFFFFF)
                yield ((mixed * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS))[inside], own[inside]

    return has, orders()


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Counts of n-grams from at most about ``sample_rows`` labelled documents of each language, the prior from all of them.

    The driver receives at most one number for each bucket and language.
    """
    ship_code(docs.sparkSession)
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    labelled = labelled.where("lang is not null and text is not null")
    shares = dict(labelled.groupBy("lang").count().collect())
    sample = hash_sample(labelled, "id", sample_rows, by="lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b, texts in _parts(batches, "text"):
            by_lang: dict[str, list[str]] = {}
            for t, lang in zip(texts, b.column("lang").to_pylist()):
                by_lang.setdefault(lang, []).append(t)
            for lang, texts in by_lang.items():
                total = sums.setdefault(lang, np.zeros(1 << BITS, np.int64))
                for _, part in _blocks(texts):
                    for bucket, _ in _grams(part)[1]:
                        total += np.bincount(bucket, minlength=1 << BITS)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], ["lang", "bucket", "n"])

    counted = sample.select("text", "lang").mapInArrow(run, "lang string, bucket int, n bigint")
    sums = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = tuple(sorted(shares))
    if not langs:
        return LanguageModel((), np.zeros(0), np.zeros((1 << BITS, 0)))
    counts = np.zeros((1 << BITS, len(langs)))
    lang = np.searchsorted(np.array(langs), np.array(sums.column("lang").to_pylist(), dtype=np.array(langs).dtype))
    counts[sums.column("bucket").to_numpy(), lang] = sums.column("n").to_numpy()
    prior = np.array([shares[x] for x in langs], dtype=float)
    log_prob = np.log(counts + SMOOTHING) - np.log(counts.sum(axis=0) + SMOOTHING * (1 << BITS))
    return LanguageModel(langs, np.log(prior / prior.sum()), log_prob)


def _predict(model: LanguageModel, texts: list[str]) -> tuple[list[str], np.ndarray]:
    langs, scores = [], []
    for _, part in _blocks(texts):
        has, orders = _grams(part)
        if not model.langs:
            langs += [UNKNOWN] * len(part)
            scores.append(np.zeros(len(part)))
            continue
        total = np.tile(model.prior, (len(part), 1))
        for bucket, owner in orders:
            if len(owner):
                starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                total[owner[starts]] += np.add.reduceat(model.log_prob[bucket], starts, axis=0)
        best = total.argmax(axis=1)
        score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        langs += [model.langs[i] if ok else UNKNOWN for i, ok in zip(best, has)]
        scores.append(np.where(has, score, 0.0))
    return langs, np.concatenate(scores) if scores else np.zeros(0)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every row, in one pass; the score is the language's posterior probability."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = slim.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in _parts(batches, "text"):
            langs, scores = _predict(shared.value, texts)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores)],
                                             ["doc_id", "lang_pred", "score"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def known_language(docs: DataFrame, model: LanguageModel, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows whose text has a known language with a score of at least ``least``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in _parts(batches, at):
            langs, scores = _predict(shared.value, texts)
            known = np.array([lang != UNKNOWN for lang in langs], dtype=bool)
            yield b.filter(pa.array(known & (scores >= least)))

    return docs.mapInArrow(run, docs.schema)


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    fold = held_out(F.col("doc_id"), 4, 2)
    found = predict(docs, fit(docs.where(~fold)))
    return found.select("doc_id", fold.alias("held_out"), "lang_pred", "score")
