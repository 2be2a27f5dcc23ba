import duckdb
import pytest

import __spark_entry__ as entry
from canlake.plans import analytics, catalogue  # noqa: F401

TABLES = ["events"]


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, sf, oracle, name):
    df = catalogue.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    want = oracle.sql(catalogue.ORACLES[name])
    assert columns == sorted(want.columns)
    places = [want.columns.index(c) for c in columns]
    assert got == sorted(tuple(str(r[i]) for i in places) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
