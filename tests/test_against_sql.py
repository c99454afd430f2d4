"""Each query with SQL gives the rows that DuckDB gives."""

import duckdb
import pandas as pd
import pytest

from aeolith.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(frame):
    columns = sorted(frame.columns)
    clean = lambda v: None if pd.isna(v) else v
    return columns, sorted(zip(*[[clean(v) for v in frame[c].tolist()] for c in columns]), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, sf, duck, name):
    got = rows(registry.QUERIES[name](spark, sf).toPandas())
    want = rows(duck.sql(registry.SQL[name]).df())
    assert got == want
    assert got[1]


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_rows_without_sql(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0
