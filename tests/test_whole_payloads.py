"""Queries that read other places or parts of a place: the SQL adds what passes a byte to the next place, or keeps the number whole."""

import pytest
from pyspark.sql import functions as F
from test_large_keys import far  # noqa: F401
from test_missing_numbers import gaps  # noqa: F401
from test_missing_times import differing, timeless  # noqa: F401
from test_wide_numbers import wide  # noqa: F401

from canlake.functions import bits
from canlake.functions import frames as ff
from canlake.operators import history, trace
from canlake.sources import events

TABLES = ["wide", "far", "gaps", "timeless"]


@pytest.mark.parametrize("table", TABLES)
def test_find_signal_reads_whole_numbers(spark, request, table):
    assert differing(spark, request.getfixturevalue(table), "find_signal") == ([], [], 0)


def test_find_signal_whole_reads_whole_numbers(spark, wide):  # noqa: F811
    assert differing(spark, wide, "find_signal_whole") == ([], [], 0)


@pytest.mark.parametrize("table", TABLES)
def test_reference_fits_read_whole_numbers(spark, request, table):
    assert differing(spark, request.getfixturevalue(table), "reference_fits") == ([], [], 0)


# one span, and many
@pytest.mark.parametrize("rows", [None, 20])
def test_points_and_references_without_a_time_do_not_meet(spark, timeless, monkeypatch, rows):  # noqa: F811
    if rows:
        monkeypatch.setattr(history, "SMALL", 0)
        monkeypatch.setattr(history, "ROWS", rows)
    assert differing(spark, timeless, "as_of_join") == ([], [], 0)


# one span, a few, and more than 32
@pytest.mark.parametrize("rows", [None, 200, 20])
@pytest.mark.parametrize("table", TABLES)
def test_trace_page_compares_whole_numbers(spark, request, monkeypatch, table, rows):
    if rows:
        monkeypatch.setattr(history, "SMALL", 0)
        monkeypatch.setattr(history, "ROWS", rows)
    assert differing(spark, request.getfixturevalue(table), "trace_page") == ([], [], 0)


def test_trace_page_has_rows_without_a_time_last(spark, timeless):  # noqa: F811
    frames = events.frames(spark, timeless, numbers=True)
    got = trace.page(frames, 990, 20).collect()
    assert sorted(r["index"] for r in got) == list(range(990, 1000)) and {r.t for r in got} == {None}


@pytest.mark.parametrize("name", ["encode_decode", "encode_signals"])
@pytest.mark.parametrize("table", TABLES)
def test_fields_are_written_into_whole_numbers(spark, request, table, name):
    assert differing(spark, request.getfixturevalue(table), name) == ([], [], 0)


def test_a_field_in_numbers_leaves_the_other_places_whole(spark):
    df = spark.createDataFrame([([300, 0x1F0F, None, 70000],), ([1],)], "data array<long>")
    some = bits.insert(ff.payload(df), 12, 12, "little", F.lit(0xABC))
    past = bits.insert(ff.payload(df), 24, 8, "little", F.lit(0xAB))
    assert [tuple(r) for r in df.select(some, past).collect()] == [([300, 0xCF, 0xAB, 70000], [300, 0x1F0F, None, 0xAB]), (None, None)]
