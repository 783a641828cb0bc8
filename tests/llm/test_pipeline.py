"""The pipeline against brute force, stage by stage on each stage's own input, and over odd documents."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from llm_reference import clean_lines
from test_overlap import copies as near_classes

import corpus_pipeline
from lumenfit.llm import langid


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Each stage's output, written and read again."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def _texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages(spark, sf_dir, stages):
    first = spark.read.parquet(f"{sf_dir}/documents.parquet")
    language, lines, copies, mixture, tokens = stages
    assert all(s.columns == first.columns for s in stages[:-1])
    # Language: what the model knows stays.
    texts = _texts(first)
    langs, scores = langid._predict(langid.fit(first), [t or "" for t in texts.values()])
    assert _texts(language) == {i: t for (i, t), lang, s in zip(texts.items(), langs, scores) if lang != "und" and s >= 0.5}
    # Repeated lines.
    want = {i: "\n".join(kept) for i, kept in clean_lines(_texts(language)).items()}
    assert _texts(lines) == want and want != _texts(language)
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    # Near copies: the smallest id of each class.
    texts = _texts(lines)
    of = near_classes(texts)
    assert _texts(copies) == {i: t for i, t in texts.items() if of[i] == i} and len(set(of.values())) < len(of)
    # Mixture: all rows, sources interleaved.
    assert sorted(map(tuple, mixture.collect())) == sorted(map(tuple, copies.collect()))
    # Tokens.
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = _texts(mixture)
    got = {r.doc_id: r for r in tokens.collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        ids = library.encode(t, add_bos=True, add_eos=True)
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_run_is_the_stages(spark, sf_dir, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, stages[-1].collect()))


def test_mixture_interleaves(stages):
    """Rows read file by file follow the schedule: no long run of one source while others have rows."""
    rows = stages[3].collect()
    first = [r.source for r in rows[: len(rows) // 2]]
    assert len(set(first)) > len({r.source for r in rows}) // 2


def test_odd_documents(spark, sf_dir, odd_docs, no_docs, tmp_path):
    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        for stage, f in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{name}-{stage}")
            f(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
        assert {r.doc_id for r in docs.collect()} == ({1, 5, 6, None, 9} if name == "odd" else set())
