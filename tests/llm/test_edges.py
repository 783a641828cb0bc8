"""Nulls, empty and long texts, repeated rows, ties, empty tables and clashing columns; skewed groups and other paths."""

import hashlib
import random
import tracemalloc

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from llm_reference import classes, clean_lines, edf, simhash64
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumenfit.llm import common, exactdedup, hnsw, langid, linededup, mixing, pieces, quality, simhash, tokencount, toxicity
from lumenfit.llm.components import components
from lumenfit.llm.queries import ORACLES, QUERIES
from lumenfit.session import scratch_path

JSON = public_tokenizers.path("byte_bpe_50k.json")


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")


# -- one ------------------------------------------------------------------------------------------------------------


def test_simhash_odd(spark, odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs, words=3).collect()
    texts = odd_docs.select("doc_id", "text").collect()
    prints = {(r.doc_id, r.fp & (1 << 64) - 1) for r in got}
    assert prints == {(r.doc_id, simhash64(r.text, 3)) for r in texts} and len(got) == len(texts)
    of = {r.doc_id: r.component_id for r in got}
    assert of[2] == of[3] == of[4] == 2  # no words: fingerprint zero
    assert of[1] == of[7] == 1 and of[None] is None
    kept = simhash.one_of_each(odd_docs, words=3)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 5, 6, 8, 9]
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.one_of_each(no_docs).count() == 0


def _prints(n, seed):
    """Fingerprints with dense balls, shared prefixes and zero."""
    r = random.Random(seed)
    out = [0, (1 << 64) - 1]
    while len(out) < n:
        base = r.getrandbits(64) if r.random() < 0.4 else r.choice(out)
        for _ in range(r.randint(0, 5)):
            base ^= 1 << r.randrange(64)
        out.append(base)
    return out


@pytest.mark.parametrize("node_rows, budget", [(simhash.NODE_ROWS, 3), (5, 3), (4, 1), (1, 3), (20, 2)])
def test_trie_walk(spark, node_rows, budget):
    """Same classes as brute force, also when almost every node is too full for a task."""
    prints = dict(enumerate(sorted(set(_prints(500, budget)))))
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in prints.items()]
    fps = spark.createDataFrame(rows, "id bigint, fp bigint")
    links = common.write_scratch(simhash.links(fps, budget, node_rows), "test-links")
    found = {r.a: r.b for r in links.collect()}
    assert all((prints[a] ^ prints[b]).bit_count() <= 64 for a, b in found.items())
    got = {r.node: r.component for r in components(links).collect()}
    assert {i: got.get(i, i) for i in prints} == classes(prints, budget)


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 99), (99, 98)] + [(200, 201 + i) for i in range(50)] + [(5, 5), (98, 99)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(61)} | {98: 98, 99: 98, 100: 98} | {200 + i: 200 for i in range(51)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_hot_group(spark):
    """A key that holds most rows, keys of few rows, and a null key, which matches nothing."""
    rows = spark.range(6_000).select(F.when(F.col("id") < 4_000, 0).when(F.col("id") < 5_990, F.col("id")).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    got = common.with_group(rows, groups, "k", "n", 6_000)
    assert got.count() == 5_990 and got.where("k = 0").agg(F.count("*"), F.max("top")).first()[:] == (4_000, 3_999)
    assert got.where("k <> 0 and top <> id").count() == 0


# -- two ------------------------------------------------------------------------------------------------------------

SHARED = ["a line that many documents share, long enough to count", "Ein zweiter Satz, den viele Texte haben – lang genug dafür",
          "short but shared"]


def _line_docs():
    r, out = random.Random(3), {}
    for i in range(60):
        lines = [f"line {i} {j} " + "x" * r.randint(0, 60) for j in range(r.randint(0, 4))]
        for s in SHARED:
            if r.random() < 0.3:
                lines.insert(r.randrange(len(lines) + 1), r.choice([s, s.upper(), f"\t {s}  \r", s.replace("–", "—")]))
                lines += [s] * r.randint(0, 1)
        out[i] = "\n".join(lines)
    return out


@pytest.mark.parametrize("batches", [1, 4, 9])
def test_lines(spark, batches, monkeypatch):
    texts = _line_docs()
    docs = frame(spark, [texts[i] for i in range(len(texts))])
    want = {i: "\n".join(x) for i, x in clean_lines(texts).items()}
    if batches == 9:  # the path of tables too large to broadcast
        monkeypatch.setattr(linededup, "few", lambda rows: rows)
    got = {r.doc_id: r for r in linededup.line_report(docs, batches=batches).collect()}
    assert {i: r.kept_text for i, r in got.items()} == want and want != texts
    assert all(r.n_lines - r.n_dropped == len(clean_lines(texts)[i]) for i, r in got.items())


def test_lines_odd(spark, odd_docs, no_docs):
    got = linededup.line_report(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r.doc_id: r for r in got}
    assert (by[2].n_lines, by[2].n_dropped, by[2].kept_text) == (1, 0, "") and by[6].n_lines == 5_001
    out = linededup.without_repeats(odd_docs)
    assert out.columns == odd_docs.columns and sorted(map(repr, out.collect())) == sorted(map(repr, odd_docs.collect()))
    assert linededup.line_report(no_docs).count() == 0 and linededup.without_repeats(no_docs).count() == 0


def test_lines_of_rows_without_id(spark):
    line = "the same long line of text in every single document"
    rows = [(None, line), (None, line), (3, line), (3, line), (5, f"{line}\n{line}"), (6, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.n_dropped) for r in linededup.line_report(docs).collect())
    assert got == [(0, 0), (0, 0), (3, 0), (3, 0), (5, 0), (6, 0)]  # three documents hold the line
    docs = docs.unionByName(spark.createDataFrame([(7, line), (8, line)], docs.schema))
    got = sorted((r.doc_id or 0, r.n_dropped) for r in linededup.line_report(docs).collect())
    assert got == [(0, 1), (0, 1), (3, 1), (3, 1), (5, 2), (6, 0), (7, 1), (8, 0)]
    docs = spark.createDataFrame([(None, line)] * 6, "doc_id bigint, text string")
    assert [r.n_dropped for r in linededup.line_report(docs).collect()] == [0] * 6


def _against_sql(query_name, docs, spark, path):
    docs.write.parquet(f"{path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}/documents.parquet/*.parquet'")
    want = con.execute(ORACLES[query_name])
    names = [d[0] for d in want.description]
    got = QUERIES[query_name](spark, str(path)).select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("name", ["op2_line_dedup", "op6_exact_dedup"])
def test_repeated_null_and_wide_ids(spark, name, tmp_path):
    """Code and SQL agree where ids repeat, are missing, or span more than a long holds."""
    line, other = "the same long line of text in every single document", "Another line, also long enough to be counted here"
    texts = [line, f"{line}\n{other}", f"x\n{other}\n{line}", other.upper(), None, "", line]
    ids = [3, 3, 3, None, None, 9 * 10**18, -9 * 10**18, 5, 6, 7, 8, 8, 0, None]
    r = random.Random(7)
    rows = [(r.choice(ids), r.choice(texts)) for _ in range(60)]
    _against_sql(name, spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), spark, tmp_path)


def test_lines_without_any_id(spark):
    rows = [(None, f"{SHARED[0]}\nown line {i}") for i in range(500)]
    got = linededup.line_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == 500 and all(r.n_dropped == 0 for r in got)


# -- three ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("weights", [[1], [1, 1, 1], [5, 3, 2], [97, 1, 1, 1], [7, 11, 13, 400]])
def test_schedule(spark, weights):
    target = spark.createDataFrame([(f"s{i}", w) for i, w in enumerate(weights)], "source string, weight bigint")
    slots = mixing.source_slots(target, 100)
    units = [r.slots for r in slots.orderBy("number").collect()]
    assert sum(units) == 100 and min(units) >= 1
    got = [(r.number, r.turn) for r in mixing.schedule(slots).orderBy("slot").collect()]
    assert got == edf(units, 100)
    done = np.zeros(len(units))
    for t, (s, turn) in enumerate(got, 1):
        assert turn * 100 // units[s] <= t - 1 < -(-(turn + 1) * 100 // units[s])  # between release and deadline
        done[s] += 1
        assert np.abs(done - np.array(units) * t / 100).max() < 1


def test_mixture(spark, monkeypatch):
    monkeypatch.setattr(mixing.source_ranks, "__defaults__", (16,))  # many ranges of a source
    rows = [(i, "hot" if i % 3 else "ab"[i % 2]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string")
    got = mixing.mixed(docs, block_rows=4).orderBy("position").collect()
    assert len(got) == len({r.position for r in got}) == len({r.doc_id for r in got}) == 600
    for s in ("hot", "a", "b"):
        ranks = [r.rank for r in got if r.source == s]
        assert ranks == list(range(len(ranks)))
    units = {r.source: r.slots / r.period for r in mixing.source_slots(mixing.tempered(docs)).collect()}
    seen = dict.fromkeys(units, 0)
    for n, r in enumerate((r for r in got if r.on_target), 1):
        seen[r.source] += 1
        assert n % 4 or all(abs(seen[s] - units[s] * n) < 4 for s in units)  # less than one block
    assert sum(seen.values()) > 100
    out = mixing.in_mixed_order(docs)
    assert sorted(map(tuple, out.collect())) == sorted(rows)


def test_mixture_odd(spark, odd_docs, no_docs):
    got = mixing.mixed(odd_docs).collect()
    assert len(got) == odd_docs.select("doc_id", "source").distinct().count() and None in {r.source for r in got}
    out = mixing.in_mixed_order(odd_docs)
    assert out.columns == odd_docs.columns and sorted(map(repr, out.collect())) == sorted(map(repr, odd_docs.collect()))
    part = mixing.mixed(odd_docs, {"a": 3, "unknown": 1}).collect()
    assert {r.source for r in part if r.position is None} == {"b", None}
    assert mixing.in_mixed_order(odd_docs, {"a": 1}).count() == odd_docs.count()
    assert mixing.mixed(no_docs).count() == 0 and mixing.in_mixed_order(no_docs).count() == 0


# -- four, five, nine -----------------------------------------------------------------------------------------------


def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("operator", [toxicity, quality])
def test_classifier_odd(spark, odd_docs, no_docs, operator):
    labels = _labels(spark, [(1, 1, 0), (1, 0, 1), (2, 0, 1), (5, 1, 0), (6, None, None), (99, 1, 1), (None, 1, 1), (8, 1, 0)])
    model = operator.fit(odd_docs, labels)
    got = operator.predict(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[2] == by[3]
    again = {r.doc_id: r.score for r in operator.predict(odd_docs, operator.fit(odd_docs, labels)).collect()}
    assert by == again
    assert operator.predict(no_docs, operator.fit(no_docs, labels)).count() == 0
    for value in (0, 1):
        one = operator.fit(odd_docs, _labels(spark, [(1, value, value)]))
        assert {round(r.score, 9) for r in operator.predict(odd_docs, one).collect()} == {value}
    none = operator.fit(odd_docs, _labels(spark, []))
    assert {round(r.score, 9) for r in operator.predict(odd_docs, none).collect()} == {0}


def test_network_slices(monkeypatch):
    """A text scored slice by slice has the score of the text scored at once."""
    net, text = quality.new_network(1), "Ein Text, der über viele Stücke geht. " * 100
    whole = quality.score(net, text)
    for slice_ in (1, 2, 3, 7):
        monkeypatch.setattr(quality, "SLICE", slice_)
        assert quality.score(net, text) == pytest.approx(whole, abs=1e-6)


def test_network_gradient():
    """Backward pass against differences."""
    net = quality.new_network(2)
    for p in net.parts():
        p[...] = p.astype(np.float32)
    codes, grads = quality._padded(("some text of a few chunks, " * 12).encode()), [np.zeros(p.shape) for p in net.parts()]
    quality._gradient(net, codes, 1, 1.0, grads)

    def loss():
        halves, _ = quality._half_maxima(net, codes)
        _, hidden = quality._chunks(net, halves)
        margin = np.r_[hidden.mean(axis=0), hidden.max(axis=0)].astype(np.float64) @ net.out + net.out_offset[0]
        return np.log1p(np.exp(-margin))

    r, wrong = np.random.default_rng(0), 0
    for p, g in zip(net.parts(), grads):
        live = np.argwhere(np.abs(g) > np.abs(g).max() * 0.2)
        for at in map(tuple, live[r.permutation(len(live))[:5]]):
            old = p[at]
            p[at] = old + 1e-2
            up = loss()
            p[at] = old - 1e-2
            down = loss()
            p[at] = old
            wrong += abs((up - down) / 2e-2 - g[at]) > 0.05 * abs(g).max() + 1e-3
    assert wrong <= 2  # a maximum may change places


def test_language_odd(spark, odd_docs, no_docs):
    model = langid.fit(odd_docs)
    assert set(model.langs) == {"de", "en", "fr"}
    got = langid.predict(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {2, 3, 4, 8}
    kept = langid.known_language(odd_docs, model)
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()} == {1, 5, 6, 7, None, 9}
    empty = langid.fit(no_docs)
    assert {r.lang_pred for r in langid.predict(odd_docs, empty).collect()} == {"und"}
    assert langid.predict(no_docs, model).count() == 0 and langid.known_language(no_docs, empty).count() == 0


def test_language_blocks(spark, odd_docs, monkeypatch):
    """Scores do not depend on how a batch is cut."""
    model = langid.fit(odd_docs)
    texts = [r.text or "" for r in odd_docs.select("text").collect()]
    langs, scores = langid._predict(model, texts)
    monkeypatch.setattr(langid, "BLOCK", 1)
    again, same = langid._predict(model, texts)
    assert langs == again and np.allclose(scores, same)


def test_language_memory():
    """A worker holds the texts and n-grams of a small part of its batch, whatever the batch."""
    texts = ["ein kurzes wort " * 100, "", None, "é" * 1_000] * 600 + ["lang " * 60_000, None, "ende"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    model = langid.LanguageModel(("de", "en", "es", "fr"), np.zeros(4), np.zeros((1 << langid.BITS, 4)))
    langid._letters()
    tracemalloc.start()
    ids, langs = [], []
    for part, own in langid._parts(iter([batch.slice(0, 0), batch]), 1):
        assert part.num_rows == 1 or sum(len(t.encode()) for t in own) <= langid.BLOCK
        ids += part.column("doc_id").to_pylist()
        langs += langid._predict(model, own)[0]
    assert tracemalloc.get_traced_memory()[1] < 40 << 20  # mostly the one long text's
    tracemalloc.stop()
    assert ids == list(range(len(texts))) and [x == "und" for x in langs] == [not t for t in texts]


def test_prior_is_of_all_rows(spark):
    rows = [(i, "ein wort" if i % 10 else "a word", "de" if i % 10 else "en") for i in range(3_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    for bound in (5_000, 100):
        assert np.exp(langid.fit(docs, sample_rows=bound).prior) == pytest.approx([0.9, 0.1])


def test_quality_learns_from_long_texts(spark):
    r = random.Random(1)
    text = lambda w: " ".join(r.choice(w) for _ in range(6_000))
    rows = [(i, text(["aaa", "bbb"] if i % 2 else ["xyz", "qqq"])) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id bigint, quality int")
    for bound in (quality.SAMPLE_BYTES, 100_000, 1):
        net = quality.fit(docs, labels, sample_bytes=bound)
        assert net.constant is None  # at least one text of each class is learned from
    net = quality.fit(docs, labels)
    assert net.parts()[0].std() > 0


def test_sample_is_bounded(spark):
    rows = spark.range(20_000).select("id", (F.col("id") % 10 == 0).alias("rare"))
    sizes = {r.rare: r["count"] for r in common.hash_sample(rows, "id", 3_000, by="rare").groupBy("rare").count().collect()}
    assert sizes[True] == 2_000 and 2_700 < sizes[False] < 3_300
    first = set(common.hash_sample(rows, "id", 500).collect())
    assert first == set(common.hash_sample(rows.repartition(7), "id", 500).collect()) and 400 < len(first) < 600


# -- six ------------------------------------------------------------------------------------------------------------


def test_exact_odd(spark, odd_docs, no_docs):
    def run(docs, index):
        out = exactdedup.exact_groups(docs, index).collect()
        return {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in out}, len(out)

    index = exactdedup.DigestIndex(spark, scratch_path(spark, "test-index"), buckets=3)
    got, n = run(odd_docs, index)
    assert n == odd_docs.count()
    assert {(1, 7, 3, False), (7, 7, 3, True), (2, 3, 2, False), (3, 3, 2, True), (None, None, 1, True)} <= got
    # A second batch meets the index; another object opens the same folder.
    index.close()
    index = exactdedup.DigestIndex(spark, index.path, buckets=3)
    held = index.rows().count()
    got, _ = run(frame(spark, ["No ID here", "new", "NEW", None], first=50), index)
    assert got == {(50, None, 1, False), (51, 52, 2, False), (52, 52, 2, True), (53, 3, 1, False)}
    assert index.rows().count() == held + 1
    assert run(no_docs, index) == (set(), 0)
    index.close()


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_exact_in_batches(spark, batches):
    """The same rows in any number of batches; later batches find their groups in the index."""
    r = random.Random(batches)
    rows = [(r.choice([None, *range(40)]), f"Text {r.randrange(25)}") for _ in range(200)]
    index = exactdedup.DigestIndex(spark, scratch_path(spark, "test-index"), buckets=2)
    out = exactdedup.exact_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), index, batches=batches).collect()
    assert len(out) == 200 and index.rows().count() == len({t for _, t in rows})
    index.close()
    for t in {t for _, t in rows}:
        mine = [r for r in out if bytes(r.digest) == hashlib.sha256(t.lower().encode()).digest()]
        ids = [i for i, u in rows if u == t]
        top = max((i for i in ids if i is not None), default=None)
        assert {(r.group_size, r.keep_id) for r in mine} == {(len(ids), top)} and sum(r.kept for r in mine) == 1
        assert [r.doc_id for r in mine if r.kept] == [top]


def test_exact_batches_meet_the_index(spark, monkeypatch):
    """Without what earlier batches stored, a group would be kept once in every batch."""
    rows = [(i, "same") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    seen = []
    fresh = exactdedup.DigestIndex.fresh
    monkeypatch.setattr(exactdedup.DigestIndex, "fresh", lambda self, keys: seen.append(self.rows().count()) or fresh(self, keys))
    index = exactdedup.DigestIndex(spark, scratch_path(spark, "test-index"), buckets=2)
    out = exactdedup.exact_groups(docs, index, batches=3).collect()
    index.close()
    assert seen == [0, 1, 1] and [r.doc_id for r in out if r.kept] == [89] and {r.group_size for r in out} == {90}


def test_exact_normalises_ascii_only(spark):
    docs = frame(spark, ["É", "é", "A", "a", "ÀB", "Àb"])
    index = exactdedup.DigestIndex(spark, scratch_path(spark, "test-index"))
    out = {r.doc_id: r for r in exactdedup.exact_groups(docs, index).collect()}
    index.close()
    assert [out[i].group_size for i in range(6)] == [1, 1, 2, 2, 2, 2]
    assert bytes(out[4].digest) == hashlib.sha256("Àb".encode()).digest()


# -- seven ----------------------------------------------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, score int, rank int, dim int"


def test_neighbours_odd(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [0.0, 1.0]), (1, [0.0, 1.0]), (100, [-0.0, 1.0]), (2, [3.0, 1.0]), (2, [3.0, 1.0]), (3, None), (4, []),
               (200, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (300, [1.0, None]), (None, [1.0, 1.0]), (7, [1.0, 2.0, 3.0]),
               (400, [1.0, 2.0, 4.0]), (8, [0.0, 5.0])]
    rows = spark.createDataFrame([(i, v, 0, 0, 0) for i, v in vectors], VECTORS)
    got = hnsw.search_index(hnsw.build_index(rows, k=3), rows.where("vec_id % 100 = 0"), k=3)
    by = {}
    for r in got.orderBy("query_id", "rank").collect():
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert by == {0: [(1, 0.0), (100, 0.0), (2, 3.0)], 100: [(0, 0.0), (1, 0.0), (2, 3.0)], 400: [(7, 1.0)]}
    none = rows.limit(0)
    assert hnsw.search_index(hnsw.build_index(none), none).count() == 0


@pytest.mark.parametrize("scale, offset", [(1e25, 0), (1e-30, 0), (1, 1e7), (1e-3, 1e9), (1e200, 0)])
def test_neighbours_of_any_size(spark, scale, offset):
    r = np.random.default_rng(6)
    x = r.normal(size=(700, 12)) * scale + offset
    x[350:] -= 3 * offset  # two far clusters
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = hnsw.search_index(hnsw.build_index(rows), rows.where("vec_id % 20 = 0")).collect()
    assert len(got) == 35 * 10
    hits = 0
    for q in range(0, 700, 20):
        d = np.sqrt((((x - x[q]) / scale) ** 2).sum(axis=1)) * scale
        want = [i for i in np.lexsort((np.arange(700), d)) if i != q][:10]
        mine = [v for v in got if v.query_id == q]
        hits += len({v.vec_id for v in mine} & set(want))
        assert all(v.score == pytest.approx(d[v.vec_id], rel=1e-12) for v in mine)
    assert hits >= 0.95 * 350


def test_neighbours_in_many_shards(spark):
    """Clusters, a very common vector, several shards and query blocks: recall and ties against brute force."""
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(c, 1, (400, 16)) for c in (0, 3, 8)] + [np.ones((600, 16))]).astype(np.float32)
    ids = r.permutation(len(x)).tolist()
    rows = spark.createDataFrame([(i, v.tolist(), 0, 0, 0) for i, v in zip(ids, x)], VECTORS)
    found = hnsw.search_index(hnsw.build_index(rows, shard_rows=300), rows.where("vec_id % 20 = 0"), block_rows=20).collect()
    by, hits = {}, 0
    for f in found:
        by.setdefault(f.query_id, []).append((f.rank, f.vec_id))
    ids, x = np.array(ids), x.astype(np.float64)
    for q, got in by.items():
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        want = [int(i) for i in ids[np.lexsort((ids, d))] if i != q][:10]
        got = [v for _, v in sorted(got)]
        hits += len(set(got) & set(want))
        if d[ids != q].min() == 0 and len(set(x[ids == q][0])) == 1:
            assert got == want  # the common vector: the smallest ids
    assert len(by) == (ids % 20 == 0).sum() and hits >= 0.95 * 10 * len(by)


# -- eight ----------------------------------------------------------------------------------------------------------


def test_tokens_odd(spark, odd_docs, no_docs, monkeypatch):
    library = Tokenizer.from_file(JSON)
    got = tokencount.token_counts(odd_docs, JSON, public_tokenizers.PATTERN).collect()
    want = [(r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids))
            for r in odd_docs.select("doc_id", "text").collect()]
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == sorted((i or 0, b, n) for i, b, n in want)
    assert tokencount.token_counts(no_docs, JSON, public_tokenizers.PATTERN).count() == 0


def test_tokens_random(monkeypatch):
    """Random text, with a tiny memory, and long texts cut into pieces."""
    library, r = Tokenizer.from_file(JSON), random.Random(5)
    monkeypatch.setattr(tokencount, "REMEMBERED", 10)
    monkeypatch.setattr(tokencount, "SLICE", 40)
    split = tokencount._Splitter(JSON, public_tokenizers.PATTERN)
    lengths = tokencount._Lengths(library, {"the": 1})
    bits = ["the", " ", "  ", "\n", "'s", "'LL", "é", "中", "　", "12", "²", "<|endoftext|>", "!", "_", "\x1c", "\x85", "\0", "x" * 70]
    for _ in range(2_000):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 60)))
        got = sum(added + sum(map(lengths.__getitem__, tokens)) for added, tokens in split(text))
        assert got == len(library.encode(text, add_special_tokens=False).ids), text


# -- ten ------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces_random(library, monkeypatch):
    vocabulary, r = pieces.Vocabulary(public_tokenizers.path("piece_bpe_32k.model")), random.Random(6)
    bits = ["the", "in", "ing", "er", " ", "  ", "▁", "\n", "a", "e", "中", "é", "==", "//", ".", ",", "²", "0", "00", "\U0001F600", "\xa0", "\0", "<s>"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 60))) for _ in range(5_000)]
    texts += ["a" * 5_000, " " * 300, "thethein" * 500, "".join(r.choice("abcdefgh+/0123") for _ in range(20_000))]
    for limit in (pieces.REMEMBERED, 50):
        monkeypatch.setattr(pieces, "REMEMBERED", limit)
        encoder, got = pieces.Encoder(vocabulary), []
        for block in pieces.blocks(iter(texts), 10_000):
            got += encoder.encode(block)
        want = library.encode(texts, add_bos=True, add_eos=True)
        assert [x.tolist() for x in got] == want
    assert [vocabulary.decode(x) for x in got] == library.decode(want)


def test_decoding_of_any_ids(library):
    """Also ids that no text encodes to: halves of characters, control pieces, marks in front."""
    vocabulary, r = pieces.Vocabulary(public_tokenizers.path("piece_bpe_32k.model")), random.Random(7)
    for _ in range(3_000):
        ids = [r.choice([r.randrange(3, 260), r.randrange(260, 32_000)]) for _ in range(r.randint(0, 8))]
        assert vocabulary.decode(np.array(ids, np.uint32)) == library.decode(ids), ids


def test_pieces_odd(spark, odd_docs, no_docs, library):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = pieces.encoded(odd_docs, path).collect()
    texts = [(r.doc_id, r.text or "") for r in odd_docs.select("doc_id", "text").collect()]
    want = [(i or 0, library.encode(t, add_bos=True, add_eos=True), library.decode(library.encode(t))) for i, t in texts]
    assert sorted((r.doc_id or 0, r.ids, r.decoded) for r in got) == sorted(want)
    assert pieces.encoded_digests(no_docs).count() == 0


def test_long_unbroken_words_are_encoded_whole_and_not_remembered(library):
    """Letters, digits and signs without a gap: as the library, in a few rounds, and no memory kept of them."""
    r = random.Random(11)
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    texts = ["".join(r.choice(signs) for _ in range(200_000)), "".join(r.choice(signs[26:52]) for _ in range(100_000)), "ab" * 70_000]
    encoder = pieces.Encoder(pieces.Vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True)
    assert max(map(len, encoder.known), default=0) <= pieces.LONG_WORD


def test_words_are_cut_only_where_no_piece_crosses():
    vocabulary = pieces.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    inside = [t.decode().replace(" ", pieces.MARK) for t in vocabulary.bytes if t.isascii() and len(t) > 1]
    codes = np.array([ord(c) for t in inside for c in t])
    ends = np.cumsum([len(t) for t in inside]) - 1
    within = np.delete(np.arange(len(codes) - 1), ends[:-1])
    assert len(inside) > 10_000 and vocabulary._side_by_side(codes)[within].all()
