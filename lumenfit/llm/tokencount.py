"""Token counts of a byte-level BPE vocabulary, by looking up the length of each pre-token.

Two tiers, both on the map side, so no pre-token is shuffled: lengths of frequent pre-tokens are broadcast as one string and
one byte array, and pre-tokens that miss are encoded by the vocabulary's library and remembered by the worker, which
forgets the oldest half of its memory when it is full. The broadcast table only saves time; counts do not depend on it.

Defined cases: a null or empty text has no bytes and no tokens; texts of any length are cut into pre-tokens whole; an
added token's string inside a text is one token, as is the library's default; repeated rows give repeated rows; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumenfit.llm.common import documents, hash_sample
from lumenfit.llm.registry import query

SAMPLE_ROWS = 2_000  # documents the frequent pre-tokens are taken from
FREQUENT = 50_000  # pre-tokens in the broadcast table: under 1 MB
LONGEST = 64  # characters of a pre-token in the table
REMEMBERED = 1_000_000  # pre-tokens a worker remembers: some 100 MB
SLICE = 1 << 20  # characters of a text cut into pre-tokens at a time


class _Splitter:
    """Cuts text into pre-tokens as the vocabulary file describes; added tokens' strings are taken out first."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        step = spec["pre_tokenizer"]
        if step["type"] != "ByteLevel" or step["add_prefix_space"] or not step["use_regex"] or spec["normalizer"]:
            raise ValueError(f"{path}: not a byte-level vocabulary that splits raw text by the usual pattern")
        self.words = regex.compile(pattern)
        added = [t["content"] for t in spec["added_tokens"]]
        self.added = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None

    def __call__(self, text: str) -> Iterator[tuple[int, list[str]]]:
        """The number of added tokens and a list of pre-tokens, piece by piece."""
        parts = self.added.split(text) if self.added else [text]
        yield len(parts) - 1, []
        for part in parts:
            if len(part) <= SLICE:
                yield 0, self.words.findall(part)
                continue
            found = (m.group() for m in self.words.finditer(part))
            while chunk := list(islice(found, SLICE // 4)):
                yield 0, chunk


class _Lengths(dict):
    """Token count of each pre-token; a miss is encoded and remembered, up to a limit."""

    def __init__(self, tokenizer: Tokenizer, frequent: dict[str, int]):
        super().__init__(frequent)
        self.tokenizer, self.first = tokenizer, len(frequent)

    def __missing__(self, token: str) -> int:
        n = len(self.tokenizer.encode(token, add_special_tokens=False).ids)
        if len(token) <= LONGEST:
            if len(self) >= self.first + REMEMBERED:
                for old in list(islice(self, self.first, self.first + REMEMBERED // 2)):
                    del self[old]
            self[token] = n
        return n


@lru_cache(maxsize=2)
def _worker(path: str, pattern: str, frequent: tuple[str, bytes]) -> tuple[_Splitter, _Lengths]:
    """A worker's tables, kept between its tasks."""
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokens, lengths = frequent
    return _Splitter(path, pattern), _Lengths(tokenizer, dict(zip(tokens.split("\0"), lengths)))


def frequent_lengths(docs: DataFrame, path: str, pattern: str, sample_rows: int = SAMPLE_ROWS,
                     size: int = FREQUENT) -> tuple[str, bytes]:
    """Pre-tokens frequent in about ``sample_rows`` documents, zero-separated, and the token count of each as a byte."""
    sample = hash_sample(docs.select("doc_id", "text"), "doc_id", sample_rows).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = _Splitter(path, pattern), Counter()
        for b in batches:
            for t in b.column(0):
                for _, tokens in split(t.as_py() or ""):
                    seen.update(t for t in tokens if len(t) <= LONGEST and "\0" not in t)
        top = seen.most_common(size)
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())],
                                         ["token", "n"])

    counts = sample.mapInArrow(run, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    tokens = [r.token for r in counts.orderBy(F.desc("n"), "token").limit(size).select("token").collect()]
    if not tokens:
        return "", b"\0"
    tokenizer = Tokenizer.from_file(path)
    counted = zip(tokens, tokenizer.encode_batch(tokens, add_special_tokens=False))
    pairs = [(t, len(e.ids)) for t, e in counted if len(e.ids) < 256]
    return "\0".join(t for t, _ in pairs), bytes(n for _, n in pairs)


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = 512, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row, in one pass without a shuffle."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    table = slim.sparkSession.sparkContext.broadcast(frequent_lengths(slim, path, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, lengths = _worker(path, pattern, table.value)
        for b in batches:
            n_bytes, n_tokens = [], []
            for t in b.column("text"):
                text, n = t.as_py() or "", 0
                for added, tokens in split(text):
                    n += added + sum(map(lengths.__getitem__, tokens))
                n_bytes.append(len(text.encode()))
                n_tokens.append(n)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()),
                 pa.array([n > limit for n in n_tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


@query("op8_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
