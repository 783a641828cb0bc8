"""Near copies by overlap of shingles, against brute force."""

import random
import re
from fractions import Fraction

import corpus_pipeline
from llm_reference import simhash64
from lumenfit.llm import overlap, simhash


def shingles(text, words=5):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall("[^\x20\x09-\x0d]+", lowered)
    return {" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}


def copies(texts, least=Fraction(4, 5)):
    """Smallest key of each class of ``{id: text}``."""
    sets, of = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            same = len(sets[a] & sets[b])
            if a < b and of[a] != of[b] and same >= least * (len(sets[a]) + len(sets[b]) - same):
                low, high = sorted((of[a], of[b]))
                of = {i: low if c == high else c for i, c in of.items()}
    return of


def _texts(n=260):
    """Originals, copies around the limit, a chain, a family on a template below the limit, repeated and blank texts."""
    r = random.Random(5)
    word = lambda: f"w{r.randrange(4_000)}"
    out = ["", None, " \t", "One two", "one TWO", "one two three"]
    template = [word() for _ in range(70)]
    while len(out) < n:
        kind = r.random()
        if kind < 0.3 or len(out) < 20:
            out.append(" ".join(word() for _ in range(r.choice([3, 8, 60, 200]))))
        elif kind < 0.5:  # seven tenths in common with the others of the family, and more
            out.append(" ".join(template + [word() for _ in range(r.randint(12, 30))]))
        else:
            words = (r.choice(out) or "").split()
            for _ in range(min(len(words), r.choice([0, 1, 2, 4, 8]))):
                words[r.randrange(len(words))] = word()
            out.append(" ".join(words))
    return dict(enumerate(out))


def test_near_copies_are_all_found_and_only_they(spark):
    texts = _texts()
    of = copies(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(5)
    got = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
    assert got == {i for i in texts if of[i] == i} and 20 < len(got) < len(texts) - 20
    # Some are further apart than 6 bits, and some that are nearer are none.
    bits = {i: (simhash64(texts[i], 5) ^ simhash64(texts[of[i]], 5)).bit_count() for i in texts}
    assert max(bits.values()) > 6


def test_near_copies_of_the_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    of = copies(texts)
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, sf_dir).collect()} == {i for i in texts if of[i] == i}


def test_rows_without_id_join_nothing(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(None, a + " x"), (None, b + " x"), (None, c), (5, a), (9, b), (7, a + " y"), (7, c + " y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(corpus_pipeline.near_copies(spark, docs, "").collect(), key=repr)
    # The class of c has id 7, which holds it; so both rows of 7 stay and the row without an id goes.
    assert got == sorted(docs.where("doc_id is not null").collect(), key=repr)


def test_frequent_shingles_dealt_to_several_tasks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(overlap, "HOT_ROWS", 3)
    monkeypatch.setattr(overlap, "HOT_PARTS", 1 << 20)
    texts = _texts()
    of = copies(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(5)
    keyed = docs.selectExpr("xxhash64(coalesce(text, '')) as node", "coalesce(text, '') as text")
    prefixes = overlap._prefixes(keyed, 5)
    assert prefixes.selectExpr("explode(part) as part").where("part > 1").count() > 50
    got = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
    assert got == {i for i in texts if of[i] == i}


def test_a_family_below_the_limit_is_not_compared_pair_by_pair(spark, monkeypatch):
    """Six hundred texts on a template, most of them outside the sample that orders shingles."""
    monkeypatch.setattr(overlap, "SAMPLE_ROWS", 20)
    seen = []
    verified = overlap._verified
    monkeypatch.setattr(overlap, "_verified", lambda pairs, *rest: seen.append(pairs.distinct().count()) or verified(pairs, *rest))
    r = random.Random(3)
    template = [f"t{i}" for i in range(70)]
    texts = [" ".join(template + [f"w{r.randrange(10**9)}" for _ in range(r.randint(12, 30))]) for _ in range(600)]
    texts[7] = texts[3] + " more"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
    assert got == set(range(600)) - {7}
    assert sum(seen) < 20 * len(texts)


def test_fingerprints_propose_pairs(spark, monkeypatch):
    """The pipeline's near copies meet through the fingerprints' self-join too; what it proposes is checked like the rest."""
    texts, seen, propose = _texts(120), [], simhash.candidates

    def watched(*args):
        seen.append(propose(*args))
        return seen[-1]

    monkeypatch.setattr(simhash, "candidates", watched)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    got = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
    of = copies(texts)
    assert got == {i for i in texts if of[i] == i} and len(seen) == 1
    # The pairs connect exactly the texts whose fingerprints are connected by links of three bits.
    node = {r.node: simhash64(r.t, 5) for r in docs.selectExpr("coalesce(text, '') as t", "xxhash64(coalesce(text, '')) as node").collect()}

    def classes(pairs):
        low = {n: n for n in node}
        for a, b in pairs:
            if low[a] != low[b]:
                one, two = sorted((low[a], low[b]))
                low = {n: one if c == two else c for n, c in low.items()}
        return low

    near = [(a, b) for a in node for b in node if a < b and (node[a] ^ node[b]).bit_count() <= 3]
    pairs = [(r.a, r.b) for r in seen[0].collect()]
    assert classes(pairs) == classes(near) and near and len(pairs) <= 2 * len(node)
