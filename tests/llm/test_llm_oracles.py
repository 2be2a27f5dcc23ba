import duckdb
import pytest

from canlake.llm import queries

TABLES = ["documents", "labels", "conversations"]
#: Queries added after the tests of the other operators; each equals its SQL on the smallest tables.
NAMES = ["op11_conversation_repair", "op13_filter_audit"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    want = con.sql(queries.ORACLES[name])
    assert columns == sorted(want.columns)
    places = [want.columns.index(c) for c in columns]
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(str(r[i]) for i in places) for r in want.fetchall())
