"""The operators with SQL, against DuckDB on the smallest tables."""

import duckdb
import pytest

from filelens.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_operator_equals_sql(spark, smoke_dir, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{smoke_dir}/{t}.parquet'")
    df, expected = QUERIES[name](spark, smoke_dir), duck.sql(ORACLE_SQL[name])
    order = sorted(df.columns)
    assert order == sorted(expected.columns)
    want = sorted((tuple(r[expected.columns.index(c)] for c in order) for r in expected.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in order) for r in df.collect()), key=str) == want
