"""Events without a value, user or props leave places of the payload without a number; the SQL counts those nowhere."""

import duckdb
import pytest
from test_missing_times import differing


@pytest.fixture(scope="module")
def gaps(sf, tmp_path_factory):
    folder = tmp_path_factory.mktemp("gaps")
    some = ", ".join(f"CASE WHEN event_id % {n} <> 3 THEN {c} END AS {c}" for c, n in [("value", 5), ("user_id", 7), ("props", 11)])
    duckdb.sql(f"COPY (SELECT * REPLACE ({some}) FROM '{sf}/events.parquet') TO '{folder}/events.parquet' (FORMAT parquet)")
    return str(folder)


def test_histograms_leave_out_missing_numbers(spark, gaps):
    assert differing(spark, gaps, "byte_histogram") == ([], [], 0)


def test_lanes_have_no_points_without_a_number(spark, gaps):
    assert differing(spark, gaps, "byte_lanes") == ([], [], 0)


@pytest.mark.parametrize("name", ["capture_flips", "bit_flips_window", "change_activity"])
def test_flips_leave_out_missing_numbers(spark, gaps, name):
    assert differing(spark, gaps, name) == ([], [], 0)
