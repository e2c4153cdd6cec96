"""Queries with SQL against DuckDB."""

import duckdb
import pytest

from wakeline.llm import registry

DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = c.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, DIR)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
