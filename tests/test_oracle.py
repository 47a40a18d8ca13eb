"""Every query with SQL, against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from filelens.plans.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def duck(smoke_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{smoke_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, smoke_dir, duck, name):
    df = QUERIES[name](spark, smoke_dir)
    expected = duck.sql(ORACLE_SQL[name])
    order = sorted(df.columns)
    assert order == sorted(expected.columns)
    place = [expected.columns.index(c) for c in order]
    want = sorted((tuple(plain(r[i]) for i in place) for r in expected.fetchall()), key=str)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=str)
    assert got == want
