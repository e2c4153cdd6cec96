"""Each registered query against its SQL in DuckDB, at the smallest scale."""

import math

import duckdb
import pytest

from wakeline.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    v = v.item() if hasattr(v, "item") else v
    return str(v) if isinstance(v, bool) else round(float(v), 5) + 0.0 if isinstance(v, int | float) else str(v)


def canonical(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(value(v) for v in r) for r in df[cols].itertuples(index=False)), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DIR).toPandas()
    if name in registry.ORACLE:
        assert canonical(got) == canonical(duck.sql(registry.ORACLE[name]).df())
    else:
        assert len(got)
