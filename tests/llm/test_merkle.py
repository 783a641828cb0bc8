"""The manifest against a plain tree, on odd documents, and on sources of many sizes."""

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lumenfit.llm import merkle
from lumenfit.llm.queries import QUERIES


def H(*parts):  # noqa: N802
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(values):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def _tree(digests):
    """The last node, and for each one the siblings (before, after) level by level."""
    paths, level, owners = [[] for _ in digests], list(digests), [[k] for k in range(len(digests))]
    while len(level) > 1:
        up, up_owners = [], []
        for first in range(0, len(level), 16):
            run = level[first : first + 16]
            for s in range(len(run)):
                for k in owners[first + s]:
                    paths[k].append((run[:s], run[s + 1 :]))
            up.append(H(*run))
            up_owners.append([k for own in owners[first : first + 16] for k in own])
        level, owners = up, up_owners
    return level[0], paths


def plain(docs):
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)`` of rows of id, source, lang, n_chars, text."""
    rows = []
    for r in docs:
        other = r
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
            other = (*r[:4], re.sub("[A-Z]", lambda m: m.group().lower(), r[4]))
        rows.append((r[1], r[0], _leaf(r), _leaf(other)))
    order = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)
    rows.sort(key=lambda t: (order(t[0]), order(t[1]), t[2]))
    sources = sorted({t[0] for t in rows}, key=order)
    trees = {s: _tree([t[2] for t in rows if t[0] == s]) for s in sources}
    root, tops = _tree([trees[s][0] for s in sources])
    out, seen = [], {s: 0 for s in sources}
    for source, doc_id, leaf, other in rows:
        path = trees[source][1][seen[source]] + tops[sources.index(source)]
        seen[source] += 1
        at = other
        for before, after in path:
            at = H(*before, at, *after)
        proof = H(*(d for before, after in path for d in (*before, *after)))
        out.append((doc_id, leaf, trees[source][0], root, proof, at, at == root))
    return out


def _run(spark, tmp_path, docs):
    path = str(tmp_path / "sf")
    docs.write.parquet(f"{path}/documents.parquet")
    return QUERIES["op12_merkle_manifest"](spark, path)


def _same(got, docs):
    want = plain([(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs])
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = QUERIES["op12_merkle_manifest"](spark, sf_dir)
    _same(got, docs)
    assert 0 < got.where("not verified").count() < len(docs) // 4


def test_odd_documents(spark, odd_docs, no_docs, tmp_path):
    _same(_run(spark, tmp_path / "odd", odd_docs), odd_docs.collect())
    assert _run(spark, tmp_path / "none", no_docs).collect() == []


@pytest.mark.parametrize("sizes", [[1], [16], [17], [1, 1], [257, 16, 15, 1, 33], [1] * 300, [4_097]])
def test_sizes(spark, tmp_path, sizes):
    """Lone leaves and sources, full and broken runs, a source on four levels, more sources than two levels hold."""
    rows = [(i * 1_000 + k if k % 7 else None, f"Text {k}", "en", f"s{i}" if i else None, k) for i, n in enumerate(sizes) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(6)
    _same(_run(spark, tmp_path, docs), docs.collect())


def test_other_columns_and_changes(spark):
    """The operator's own interface: any columns, any change; only changed rows miss the root."""
    docs = spark.range(100).select(F.col("id"), F.concat(F.lit("k"), F.col("id") % 3).alias("site"), (F.col("id") * 2).alias("v"))
    found = merkle.manifest(docs, ["id", "v"], {"v": F.when(F.col("id") == 7, 0).otherwise(F.col("v"))}, "id", "site")
    broken = found.where(merkle.fold(F.col("candidate"), F.col("path")) != F.col("root"))
    assert [r.doc_id for r in broken.collect()] == [7]
    assert found.where(merkle.fold(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0
