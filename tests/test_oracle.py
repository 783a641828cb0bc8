"""Every catalogued query: against SQL where there is one, else it must run and give rows."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from lumenfit.plans import catalog

QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
SLOW = {"rf_ica", "rf_rfi_ica"}  # many iterations; exercised by test_scale on small data


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    return repr(float(v)) if isinstance(v, (int, float)) else str(v)


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_matches_sql(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    got = duck.execute(ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    assert _rows(df.collect(), df.columns) == _rows(got.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_runs(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() == 1
