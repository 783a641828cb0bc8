"""The mixture decides something in the pipeline's result."""

import corpus_pipeline
from lumenfit.llm import mixing


def test_result_has_the_order_of_the_mixture(spark):
    """Every row has the place that the schedule gives it."""
    rows = [(i, f"text number {i}", "en", "hot" if i < 1_600 else "ab"[i % 2], 9) for i in range(2_000)] + [(None, "x", "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    mixed = corpus_pipeline.mixture(spark, docs, "")
    got = corpus_pipeline.tokens(spark, mixed, "").collect()
    assert len(got) == len(rows) and {r.doc_id for r in got} == {r[0] for r in rows}
    want = {(r.doc_id, r.position) for r in mixing.mixed(docs).collect()}
    assert {(r.doc_id, r.position) for r in got} == want and len({r.position for r in got}) == len(got)


def test_target_shares_in_the_result(spark):
    """Of a skewed table the rows on target hold the target shares, not the raw ones."""
    rows = [(i, f"text number {i}", "en", "hot" if i < 1_600 else "ab"[i % 2], 9) for i in range(2_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = corpus_pipeline.tokens(spark, corpus_pipeline.mixture(spark, docs, ""), "").collect()
    on = [rows[r.doc_id][3] for r in got if r.on_target]
    share = {r.source: r.slots / r.period for r in mixing.source_slots(mixing.tempered(docs)).collect()}
    assert len(on) > 400 and all(abs(on.count(s) - share[s] * len(on)) < 2 * mixing.BLOCK_ROWS for s in share)
    assert abs(on.count("hot") / len(on) - 0.8) > 0.1  # the raw share
