"""Rows without an id, and rows that share one, link no texts."""

from lumenfit.llm import simhash

A, B, C = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")


def test_null_ids_do_not_bridge(spark):
    rows = [(None, A), (None, B), (None, C), (5, A), (9, B)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    near = docs.unionByName(docs.where("doc_id is null").selectExpr("doc_id", "concat(text, ' ') as text"))
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(near).collect()}
    assert got == {(5, 5), (9, 9), (None, 5), (None, 9), (None, None)}
    # What an id holds stays; rows without an id go if their class has one.
    kept = sorted(map(repr, simhash.one_of_each(near).collect()))
    assert kept == sorted(map(repr, near.where(f"doc_id is not null or trim(text) = '{C}'").collect()))


def test_null_ids_that_only_link(spark):
    """Fingerprints that only rows without an id hold, near to others' fingerprints."""
    prints = {0: 5, 1: None, 0xFF00FF: 9, 0xFF00FE: None, 0x0F0F << 40: None}
    rows = spark.createDataFrame([(i, fp) for fp, i in prints.items()], "doc_id bigint, fp bigint")
    got = {r.fp: r.component_id for r in simhash._classes(rows, 3).collect()}
    assert got == {0: 5, 1: 5, 0xFF00FF: 9, 0xFF00FE: 9, 0x0F0F << 40: None}


def test_shared_ids_do_not_bridge(spark):
    rows = [(1, A), (1, B), (5, A), (9, B), (7, C)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    by = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert len(by) == 5 and {i: c for (i, _), c in by.items()} == {1: 1, 5: 1, 9: 1, 7: 7}
    prints = spark.createDataFrame([(1, 0), (1, 0xFF00FF), (0, 0xFF00FE), (5, 1)], "doc_id bigint, fp bigint")
    got = {r.fp: r.component_id for r in simhash._classes(prints, 3).collect()}
    assert got == {0: 1, 1: 1, 0xFF00FF: 0, 0xFF00FE: 0}
