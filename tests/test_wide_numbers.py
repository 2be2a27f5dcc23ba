"""Users beyond 255 fill a place of the payload with more than a byte; the SQL counts the whole number."""

import duckdb
import pytest

from canlake.plans import analytics, catalogue  # noqa: F401

QUERIES = ["bit_flips", "bit_flips_window", "baseline_flips", "capture_flips", "change_activity", "changed_mask", "checksum_share", "byte_histogram", "byte_lanes", "bit_history"]
DECODED = ["decode_signal", "decode_motorola", "decode_all", "as_of_join"]


@pytest.fixture(scope="module")
def wide(sf, tmp_path_factory):
    folder = tmp_path_factory.mktemp("wide")
    # users of one ID that differ by 256 and more, as larger tables have them
    duckdb.sql(f"COPY (SELECT * REPLACE (user_id + 32 * (event_id * 7 % 60) AS user_id, value + 650 * (event_id % 5 // 2) AS value) FROM '{sf}/events.parquet') TO '{folder}/events.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", [*QUERIES, *DECODED])
def test_query_equals_sql_beyond_a_byte(spark, wide, name):
    df = catalogue.QUERIES[name](spark, wide)
    columns = sorted(df.columns)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{wide}/events.parquet'")
    want = con.sql(catalogue.ORACLES[name])
    places = [want.columns.index(c) for c in columns]
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(str(r[i]) for i in places) for r in want.fetchall())
