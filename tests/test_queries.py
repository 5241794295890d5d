"""Every registered query against its DuckDB SQL on the sf0.01 tables."""

import datetime as dt
import decimal

import duckdb
import pytest

import __spark_entry__ as entry_module
from tests.conftest import SF_CHECK
from tidemark.plans.catalog import ORACLE_SQL, QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_CHECK}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return str(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def test_entry_smoke(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["id", "name", "count"]
    assert df.count() > 0


def test_every_query_has_sql():
    assert set(ORACLE_SQL) == set(QUERIES)
    assert set(QUERIES) <= set(entry_module.queries()) and set(ORACLE_SQL) <= set(entry_module.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_CHECK)
    rows = df.collect()
    rel = duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    got = sorted(tuple(_norm(r[c]) for c in cols) for r in rows)
    idx = [rel.columns.index(c) for c in cols]
    want = sorted(tuple(_norm(r[i]) for i in idx) for r in rel.fetchall())
    assert len(got) == len(want)
    assert got == want
