"""The registered queries against SQL, against brute force, against the tokenizers' libraries, or on held-out labels."""

import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

import __spark_entry__ as entry
from lumenfit.llm.queries import ORACLES, QUERIES
from llm_reference import classes, simhash64

NAMES = {
    "op1_simhash_dedup", "op2_line_dedup", "op3_source_mixing", "op4_toxicity", "op5_language_id", "op6_exact_dedup",
    "op7_nearest_neighbours", "op8_token_counts", "op9_quality", "op10_sentencepiece",
    "op11_embedding_whitening", "op12_merkle_manifest", "op13_secret_scans",
}


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_registered():
    assert set(QUERIES) == NAMES and set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))


def test_simhash(spark, sf_dir, docs):
    got = {r.doc_id: r for r in QUERIES["op1_simhash_dedup"](spark, sf_dir).collect()}
    prints = {i: simhash64(r.text, 3) for i, r in docs.items()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r.component_id for i, r in got.items()} == classes(prints, 3)


def test_token_counts(spark, sf_dir, docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in QUERIES["op8_token_counts"](spark, sf_dir).collect():
        text = docs[r.doc_id].text or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 512)


def test_sentencepiece(spark, sf_dir, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in QUERIES["op10_sentencepiece"](spark, sf_dir).collect():
        ids = library.encode(docs[r.doc_id].text or "", add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_nearest_neighbours(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    found = {}
    for r in QUERIES["op7_nearest_neighbours"](spark, sf_dir).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r)
    assert set(found) == {i for i in ids if i % 100 == 0}
    hits = 0
    for q, got in found.items():
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        assert [r.rank for r in got] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in got] == sorted((r.score, r.vec_id) for r in got)
        assert all(r.score == pytest.approx(d[ids == r.vec_id][0], abs=1e-12) for r in got)
        hits += len({r.vec_id for r in got} & set(ids[want]))
    assert hits >= 0.9 * 10 * len(found)


def test_language(spark, sf_dir, docs):
    got = QUERIES["op5_language_id"](spark, sf_dir).collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) >= 0.98


@pytest.mark.parametrize("name, target, least", [("op4_toxicity", "toxic", 0.5), ("op9_quality", "quality", 0.3)])
def test_classifiers(name, target, least, spark):
    sf_dir = "/root/testdata/sf0.01"  # enough labels to learn from
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    got = QUERIES[name](spark, sf_dir).collect()
    assert len(got) == len(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= least) for r in got)
    held = [(r.score, labels[r.doc_id][target]) for r in got if r.held_out and r.doc_id in labels and langs[r.doc_id] == "en"]
    ones, zeros = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    ranked = np.mean([a > b for a in ones for b in zeros])  # area under the curve
    assert ranked >= 0.9


def test_hash_of_shingles():
    assert simhash64("a", 3) == xxhash.xxh64_intdigest(b"a", 42)
