import random

import pytest
from pyspark.sql import functions as F
from test_operators import log

from canlake.operators import history, series, trace
from canlake.operators.history import spans_of, with_index, with_previous, with_running_sum


@pytest.fixture
def fine_spans(monkeypatch):
    monkeypatch.setattr(history, "SMALL", 0)
    monkeypatch.setattr(history, "ROWS", 100)


def dense_rows():
    """Bursts within a microsecond, a nanosecond with 700 frames, and long pauses."""
    dice = random.Random(5)
    times = [dice.randrange(1000) for _ in range(900)] + [1500] * 700 + [10**9 * dice.randrange(2, 9000) for _ in range(600)]
    seqs = list(range(len(times)))
    dice.shuffle(seqs)
    return [(s, t, 100 + dice.randrange(3), 0, bytearray([dice.randrange(256), t % 256])) for s, t in zip(seqs, times)]


def test_spans_hold_about_equal_numbers_of_rows(spark, fine_spans):
    frames = log(spark, dense_rows())
    spans = spans_of(frames)
    sizes = frames.groupBy(spans.of().alias("span")).count().collect()
    assert len(sizes) >= 18 and max(r["count"] for r in sizes) <= 200
    ordered = sorted((t, s) for s, t, *_ in dense_rows())
    got = {r.seq: r.span for r in frames.select("seq", spans.of().alias("span")).collect()}
    assert [got[s] for _, s in ordered] == sorted(got.values())
    assert frames.where(spans.before(3)).count() == sum(v < 3 for v in got.values())


def test_a_million_frames_of_an_hour(spark, monkeypatch):
    monkeypatch.setattr(history, "SMALL", 0)
    monkeypatch.setattr(history, "ROWS", 50_000)
    rows = spark.range(1_000_000).select(F.col("id").alias("seq"), (F.col("id") * 3_600_000).alias("ts_ns"))
    sizes = [r["count"] for r in rows.groupBy(spans_of(rows).of()).count().collect()]
    assert len(sizes) == 20 and max(sizes) <= 60_000


def test_order_does_not_depend_on_cuts(spark, fine_spans):
    rows = dense_rows()
    frames = log(spark, rows)
    assert spans_of(frames).cuts
    got = with_running_sum(with_index(with_previous(frames, ["id"], {"seq": "before"}), ["id"], "n"), [], F.lit(1), "upto", by_time=True).collect()
    ordered = sorted((t, s, i) for s, t, i, *_ in rows)
    for k in range(100, 103):
        mine = [s for _, s, i in ordered if i == k]
        found = {r.seq: (r.before, r.n) for r in got if r.id == k}
        assert [found[s] for s in mine] == [(mine[n - 1] if n else None, n) for n in range(len(mine))]
    assert {r.seq: r.upto for r in got} == {s: n + 1 for n, (_, s, _) in enumerate(ordered)}


def test_pages_sparklines_and_references_over_spans(spark, fine_spans):
    rows = dense_rows()
    frames = log(spark, rows)
    ordered = sorted((t, s) for s, t, *_ in rows)
    for start in (0, 895, 1590, 2190):
        assert [(r["index"], r.seq) for r in trace.page(frames, start, 10).orderBy("index").collect()] == [(start + i, s) for i, (_, s) in enumerate(ordered[start : start + 10])]
    key = frames.select("key").where("id = 101").first().key
    mine = sorted((t, s) for s, t, i, *_ in rows if i == 101)
    assert [r.seq for r in series.sparkline(frames, key, 9).orderBy("k").collect()] == [mine[k * (len(mine) - 1) // 8][1] for k in range(9)]
    values = frames.select("ts_ns", "seq", F.lit(0.0).alias("value"))
    known = frames.where("id = 102").select("ts_ns", "seq", F.col("seq").cast("double").alias("value"))
    last = {}
    reference = sorted((t, s) for s, t, i, *_ in rows if i == 102)
    for t, s in ordered:
        upto = [r for r in reference if r[0] <= t]
        last[s] = float(upto[-1][1]) if upto else None
    assert {r.seq: r.reference for r in series.as_of(values, known).collect()} == last


def test_a_small_table_is_one_span(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id seq", "unix_micros(cast(ts as timestamp)) * 1000 ts_ns")
    assert spans_of(events) == history.Spans()
    plan = with_previous(events, [], {"seq": "before"})._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
