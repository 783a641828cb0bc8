"""Ordered operators, medians and splits: brute force on small data, forced through the large-table paths."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfit.operators import common, index, median, splits


def scrambled(df, parts):
    return df.repartition(parts, F.xxhash64(F.col("idx"), F.lit(parts)))


@pytest.mark.parametrize("parts", [1, 4, 13])
@pytest.mark.parametrize("rows", [37, 10_000])
def test_dense_index_any_partitioning(spark, parts, rows):
    df = scrambled(spark.range(500).selectExpr("id as idx", "cast(pmod(id * 7919, 503) as double) as t"), parts)
    out = index.with_dense_index(df, ["t"], rows_per_bucket=rows).toPandas().sort_values("t")
    assert out["rn"].tolist() == list(range(500))


def test_dense_index_hot_value(spark):
    """Nine tenths of the rows tie on the leading column, with nulls before and NaN after."""
    df = spark.range(1000).selectExpr(
        "id as idx",
        "case when id % 50 = 0 then null when id % 50 = 1 then double('NaN') when id % 20 < 18 then 5e0 else id end as t",
    )
    got = index.with_dense_index(scrambled(df, 5), ["t", "idx"], rows_per_bucket=60).toPandas()
    expect = df.orderBy("t", "idx").toPandas()
    assert got.sort_values("rn")["idx"].tolist() == expect["idx"].tolist()
    assert sorted(got["rn"]) == list(range(1000))


HOT = {
    "value": "if(id % 10 < 9, 1e0, id)", "nulls": "if(id % 10 < 6, null, cast(id as double))", "large": "9007199254740993e0",
    "many": "cast(id % 100 as double)",
}


@pytest.mark.parametrize("name", HOT)
@pytest.mark.parametrize("ties", [1, 3000])
def test_hot_values_are_cut_by_the_next_columns(spark, name, ties):
    """Rows that tie on one or two leading columns, or are null there, still end in buckets of bounded size."""
    df = spark.range(3000).selectExpr("id as idx", f"{HOT[name]} as t", f"id div {ties} as u")
    keyed, buckets = index.with_order_buckets(scrambled(df, 5), ["t", "u", "idx"], 100)
    sizes = [r["count"] for r in keyed.groupBy(*buckets).count().collect()]
    assert max(sizes) <= 200 and len(sizes) <= 2 * 3000 / 100
    got = index.with_dense_index(df, ["t", "u", "idx"], rows_per_bucket=100).orderBy("rn").toPandas()
    assert got["idx"].tolist() == df.orderBy("t", "u", "idx").toPandas()["idx"].tolist()


@pytest.mark.parametrize("rows", [23, 10_000])
def test_lag_diff(spark, rows):
    t = np.cumsum(np.random.default_rng(3).random(300))
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(t)], "idx bigint, t double")
    got = index.lag_diff(scrambled(df, 6), "t", "idx", rows_per_bucket=rows).toPandas().sort_values("idx")
    assert np.isnan(got["t_diff"].iloc[0])
    np.testing.assert_array_equal(got["t_diff"].to_numpy()[1:], np.diff(t))


def test_running_best(spark):
    h = spark.createDataFrame([(i, v) for i, v in enumerate([-0.2, 0.1, 0.05, 0.1, 0.3])], "epoch int, r2 double")
    for chunk in (1, 2, 100):
        rows = index.running_best(h, "r2", chunk=chunk).orderBy("epoch").collect()
        assert [r["epoch"] for r in rows if r["is_record"]] == [0, 1, 3, 4]
        from_zero = index.running_best(h, "r2", start=0.0, chunk=chunk).where("is_record").orderBy("epoch")
        assert [r["epoch"] for r in from_zero.collect()] == [1, 3, 4]


VALUES = {
    "even": list(np.random.default_rng(1).normal(size=1000)),
    "odd": list(np.random.default_rng(2).normal(size=1001)),
    "ties": [1.0] * 600 + list(np.random.default_rng(3).random(401)),
    "two_values": [1.0] * 500 + [2.0] * 500,
    "one_value": [7.0] * 1000,
    "infinite": [float("inf")] * 30 + [float("-inf")] * 30 + [0.0, 1.0] * 470,
}


@pytest.mark.parametrize("name", VALUES)
@pytest.mark.parametrize("small", [10, 100_000])
def test_median_value(spark, name, small):
    df = spark.createDataFrame([(float(v),) for v in VALUES[name]], "x double").repartition(5)
    assert median.median_value(df, "x", small) == pytest.approx(np.median(VALUES[name]), rel=1e-15)


@pytest.mark.parametrize("p", [0.0, 0.1, 0.9, 1.0])
def test_quantile_value(spark, p):
    x = VALUES["odd"]
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    for small in (20, 100_000):
        assert median.exact_quantile_value(df, "x", p, small) == pytest.approx(np.quantile(x, p), rel=1e-12)


@pytest.mark.parametrize("p", [0.0, 0.13, 0.9, 1.0])
def test_grouped_quantiles(spark, p):
    """Groups of one, two and many rows, ties and infinities."""
    rows = [(g, float(v)) for g, vs in VALUES.items() for v in vs] + [("one", 3.0), ("pair", 1.0), ("pair", 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    for small in (50, 100_000):
        got = {r["g"]: r["quantile"] for r in median.exact_quantile(df, "x", p, "g", small=small).collect()}
        assert got.pop("none", None) is None
        for g, vs in [*VALUES.items(), ("one", [3.0]), ("pair", [1.0, 2.0])]:
            at = sorted(vs)[int(np.floor(p * (len(vs) - 1))):][:2]
            share = p * (len(vs) - 1) % 1
            want = at[0] if share == 0 or at[0] == at[1] else at[0] + (at[1] - at[0]) * share
            assert got[g] == pytest.approx(want, rel=1e-12), (g, small)


@pytest.mark.parametrize("limit", [0, 500_000])
@pytest.mark.parametrize("small", [50, 100_000])
def test_grouped_median_hot_group(spark, monkeypatch, limit, small):
    """One group holds most rows and is full of ties; null keys and NaN values are kept apart."""
    monkeypatch.setattr(median, "BROADCAST_ROWS", limit)
    df = spark.range(3000).selectExpr(
        "if(id % 3 < 2, 'hot', if(id % 7 = 0, null, concat('g', id % 5))) as g",
        "case when id % 11 = 0 then double('NaN') when id % 3 < 2 and id % 2 = 0 then 4e0 "
        "else pmod(id * 7919, 997) * 1e-1 end as x",
    )
    got = {r["g"]: r["median"] for r in median.exact_median(df, "x", "g", small=small).collect()}
    pdf = df.toPandas()
    pdf["g"] = pdf["g"].where(pdf["g"].notna(), None)
    expect = {
        (None if g != g or g is None else g): grp["x"].median() for g, grp in pdf.groupby("g", dropna=False)
    }
    assert got.keys() == expect.keys()
    for g in got:
        assert got[g] == pytest.approx(expect[g], rel=1e-15)


def test_empty_column(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert np.isnan(median.median_value(df, "x"))


@pytest.mark.parametrize("limit", [0, 500_000])
def test_join_stats_matches_null_keys(spark, monkeypatch, limit):
    monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
    left = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "k string, v int")
    stats = left.groupBy("k").agg(F.max("v").alias("m"))
    assert {r["k"]: r["m"] for r in common.join_stats(left, stats, ["k"]).collect()} == {"a": 1, None: 2, "b": 3}


def test_split_sizes_and_order(spark):
    df = spark.range(10).withColumnRenamed("id", "idx")
    out = {r["idx"]: r["split"] for r in splits.hash_split(df, test_size=0.75, seed=42).collect()}
    ranked = sorted(range(10), key=lambda i: hashlib.md5(f"{i}:42".encode()).hexdigest())
    assert [i for i in ranked if out[i] == "test"] == ranked[:8]


@pytest.mark.parametrize("n", [7, 11, 5000])
def test_split3_sizes(spark, n, monkeypatch):
    monkeypatch.setattr(splits, "SELECT_AT_MOST", 3)
    df = spark.range(n).withColumnRenamed("id", "idx")
    out = splits.hash_split3(df, fracs={"val": 0.2, "test": 0.4, "train": 0.4})
    sizes = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    val = int(np.ceil(0.2 * n))
    test = int(np.ceil(0.5 * (n - val)))
    assert sizes == {"val": val, "test": test, "train": n - val - test}


def test_split_is_the_same_for_any_partitioning(spark):
    df = spark.range(400).withColumnRenamed("id", "idx")
    runs = [
        sorted((r["idx"], r["split"]) for r in splits.hash_split(scrambled(df, p), test_size=0.25).collect())
        for p in (1, 4, 13)
    ]
    assert runs[0] == runs[1] == runs[2]


@pytest.mark.parametrize("n,kept", [(70, 64), (64, 64), (31, 0)])
def test_batches_drop_the_partial_one(spark, n, kept):
    df = spark.range(n).withColumnRenamed("id", "idx")
    out = splits.assign_batches(df, 32)
    assert out.count() == kept
    assert all(r["count"] == 32 for r in out.groupBy("batch").count().collect())


def test_bootstrap_counts_do_not_depend_on_partitions(spark):
    df = spark.range(300).withColumnRenamed("id", "idx")
    a, b = (
        {r["idx"]: r["w"] for r in splits.bootstrap_weights(scrambled(df, p), n_trees=5).collect()} for p in (1, 7)
    )
    assert a == b
    flat = np.array(list(a.values()))
    assert abs(flat.mean() - 1) < 0.1 and abs((flat == 0).mean() - np.exp(-1)) < 0.05
    assert len({tuple(col) for col in flat.T}) == 5


def test_every_bootstrap_count_from_its_own_digest(spark):
    """The query's counts are Poisson quantiles at 52 bits of a digest of (seed, row, tree)."""
    cdf = np.cumsum([np.exp(-1.0) / math.factorial(k) for k in range(16)])
    df = splits.bootstrap_weights(spark.range(40).withColumnRenamed("id", "idx"), n_trees=6, own_digests=True)
    for r in df.collect():
        u = [(int(hashlib.md5(f"42:{r.idx}:{t}".encode()).hexdigest()[:13], 16) + 0.5) * 2.0**-52 for t in range(6)]
        assert list(r.w) == list(np.searchsorted(cdf, u, side="right"))


@pytest.mark.parametrize("p", [0.25, 0.5, 0.9])
def test_grouped_quantiles_deal_to_few_buckets(spark, monkeypatch, p):
    """However small a bucket may be, the number of buckets does not grow with the rows, and quantiles stay exact."""
    parts, deal = [], median.with_order_buckets

    def watched(*args, **kwargs):
        cut, names = deal(*args, **kwargs)
        parts.append(cut.rdd.getNumPartitions())
        return cut, names

    monkeypatch.setattr(median, "with_order_buckets", watched)
    df = spark.range(6000).selectExpr("id % 3 as g", "cast(pmod(id * 7919, 6007) as double) as x")
    got = {r["g"]: r["quantile"] for r in median.exact_quantile(df, "x", p, "g", small=2).collect()}
    for g in range(3):
        assert got[g] == pytest.approx(np.quantile([i * 7919 % 6007 for i in range(g, 6000, 3)], p), rel=1e-12)
    assert parts and max(parts) <= 400
