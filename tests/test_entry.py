"""The entry points, and queries with SQL on the smallest tables."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry
from seqweave import registry

SMALL = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    value = lambda v: None if v is None or v != v else round(v, 4) if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(value(x) for x in r) for r in frame[sorted(frame.columns)].astype(object).values.tolist()), key=repr)


def test_contract():
    assert set(registry.SQL) <= set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not SMALL.exists(), reason="the test tables aren't here")
def test_entry_runs(spark):
    assert entry.entry(spark).limit(5).count() == 5


@pytest.mark.skipif(not SMALL.exists(), reason="the test tables aren't here")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    assert rows(registry.QUERIES[name](spark, str(SMALL)).toPandas()) == rows(con.execute(registry.SQL[name]).df())
