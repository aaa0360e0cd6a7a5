"""Every registered query against its SQL on DuckDB, and the driver's contract."""

from datetime import date, datetime
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from quillon import plans
from tests import inline_cases

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float, Decimal)):
        return round(float(v), 9)
    return v.isoformat() if isinstance(v, (date, datetime)) else v


def same(df, duck, sql):
    cols = sorted(df.columns)
    want = duck.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_its_sql(spark, sf, duck, name):
    same(plans.queries()[name](spark, sf), duck, plans.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(inline_cases.QUERIES))
def test_inline_case(spark, sf, duck, name):
    same(inline_cases.QUERIES[name](spark, sf), duck, inline_cases.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_query_runs(spark, sf, name):
    df = plans.queries()[name](spark, sf)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) >= set(plans.queries())
