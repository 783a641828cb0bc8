"""Collects the catalogue's queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfit.plans.cal import cal_sql

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a ``(spark, sf_dir) -> DataFrame`` function, with the SQL that must give the same rows."""

    def add(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def on_cal(select: str, *ctes: str, extra: dict[str, str] | None = None) -> str:
    """Oracle text: the ``cal`` CTE, further CTEs, and a final select."""
    return f"with {', '.join([cal_sql(extra), *ctes])} {select}"


def rnd(c: Column | str, digits: int = 6) -> Column:
    """Rounded, with negative zero made zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def sql_rnd(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0e0)"


def rounded(df: DataFrame, cols: list[str], digits: int = 6, keep=("idx",)) -> DataFrame:
    return df.select(*keep, *[rnd(c, digits).alias(c) for c in cols])


def sql_rounded(cols: dict[str, str] | list[str], digits: int = 6) -> str:
    """``round(expr) as name`` for each column."""
    items = cols.items() if isinstance(cols, dict) else [(c, c) for c in cols]
    return ", ".join(f"{sql_rnd(e, digits)} as {n}" for n, e in items)
