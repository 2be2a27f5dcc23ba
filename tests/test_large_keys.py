"""Keys and codes beyond 32 bits, as a table has them whose keys are shifted far; the SQL keeps them whole in a place of the payload."""

import duckdb
import pytest

from canlake.plans import analytics, catalogue  # noqa: F401

QUERIES = ["bit_flips_window", "bit_history", "byte_histogram", "byte_lanes", "capture_flips", "change_activity"]
SAME_STEP = ["changed_mask", "checksum_share", "row_bytes", "filter_changes", "new_values", "decode_signal", "decode_motorola", "decode_all"]


@pytest.fixture(scope="module")
def far(sf, tmp_path_factory):
    folder = tmp_path_factory.mktemp("far")
    # shifts by whole multiples of 32 leave an event's ID and channel as they are; a value stays exact as cents
    duckdb.sql(f"""COPY (SELECT * REPLACE (user_id + (event_id % 5) * 32 * 3000000000 AS user_id, value + (event_id % 3) * 100000000000 AS value,
        '{{"k": ' || (event_id % 7) * 1000000007 || '}}' AS props) FROM '{sf}/events.parquet') TO '{folder}/events.parquet' (FORMAT parquet)""")
    return str(folder)


@pytest.mark.parametrize("name", [*QUERIES, *SAME_STEP])
def test_query_equals_sql_beyond_32_bits(spark, far, name):
    df = catalogue.QUERIES[name](spark, far)
    columns = sorted(df.columns)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{far}/events.parquet'")
    want = con.sql(catalogue.ORACLES[name])
    places = [want.columns.index(c) for c in columns]
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(str(r[i]) for i in places) for r in want.fetchall())
