"""A training corpus from raw documents: language, repeated lines, near copies, mixture, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfit.llm import langid, linededup, mixing, overlap, pieces, simhash
from lumenfit.llm.common import documents, few, write_scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with some confidence; the model is fitted on the documents' own labels."""
    return langid.known_language(docs, langid.fit(docs))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of 40 characters or more that five documents share, but for the last document's."""
    return linededup.without_repeats(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: texts with four fifths or more of their five-word shingles in common.

    Fingerprints that differ in at most three bits propose pairs, as do rare shingles, which reach the near copies that
    fingerprints miss; every pair is checked on the whole texts.
    """
    return overlap.one_of_each(docs, words=5, propose=simhash.candidates)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order in which their sources come up under the target weights."""
    return mixing.in_mixed_order(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, as counts and digests, with the digest of the decoded text and its place in the mixture.

    The stages before return the columns of documents only, so the place (a function of ids and sources) is found again.
    """
    key = F.struct(F.col("doc_id").alias("id"), F.col("source").cast("string").alias("source"))
    found = pieces.encoded_digests(docs.select(key.alias("key"), "text"), id_col="key")
    places = write_scratch(mixing.mixed(docs).selectExpr("struct(doc_id as id, source) as key", "position", "on_target"), "places")
    placed = found.join(few(places), F.col("doc_id").eqNullSafe(F.col("key")))
    digests = ("n_tokens", "ids_sha256", "decoded_sha256", "position", "on_target")
    return placed.select(F.col("doc_id.id").alias("doc_id"), *digests)


STAGES = [
    ("language", language), ("repeated_lines", repeated_lines), ("near_copies", near_copies), ("mixture", mixture),
    ("tokens", tokens),
]
ORACLE_SQL = None  # language and tokens are not expressible in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = write_scratch(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
