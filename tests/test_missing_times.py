"""Events without a time come last in their ID's order, as in the SQL, and with them the counter in the payload."""

import duckdb
import pytest

from canlake.operators import history
from canlake.plans import analytics, catalogue  # noqa: F401


def differing(spark, folder, name):
    """Rows of a query that its SQL doesn't have, and the other way round."""
    df = catalogue.QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    want = con.sql(catalogue.ORACLES[name])
    places = [want.columns.index(c) for c in columns]
    got, wanted = (sorted(rows) for rows in ([tuple(str(r[c]) for c in columns) for r in df.collect()], [tuple(str(r[i]) for i in places) for r in want.fetchall()]))
    return [r for r in got if r not in wanted], [r for r in wanted if r not in got], len(got) - len(wanted)


@pytest.fixture(scope="module")
def timeless(sf, tmp_path_factory):
    folder = tmp_path_factory.mktemp("timeless")
    duckdb.sql(f"COPY (SELECT * REPLACE (CASE WHEN event_id % 7 <> 3 THEN ts END AS ts) FROM '{sf}/events.parquet') TO '{folder}/events.parquet' (FORMAT parquet)")
    return str(folder)


# one span, a few, and more than 32
@pytest.mark.parametrize("name, rows", [("bit_history", None), ("bit_history", 100), ("bit_history", 20), ("bit_flips", 20)])
def test_rows_without_a_time_come_last(spark, timeless, monkeypatch, name, rows):
    if rows:
        monkeypatch.setattr(history, "SMALL", 0)
        monkeypatch.setattr(history, "ROWS", rows)
    assert differing(spark, timeless, name) == ([], [], 0)


def test_states_of_spans_have_rows_without_a_time_last(spark, timeless):
    assert differing(spark, timeless, "capture_flips") == ([], [], 0)
