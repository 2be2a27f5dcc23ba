import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from test_operators import log

from canlake import schema
from canlake.operators import stats, trace
from canlake.operators.trace import BitIs, ByteEquals, Changes, FrameFilter
from canlake.streaming import follow
from canlake.streaming.capture_log import CaptureLog

MS = 1_000_000
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def frames_of(spark, n=900, seed=3):
    dice, rows = random.Random(seed), []
    for i in range(n):
        size = dice.choice((0, 2, 8, 8, 8))
        flags = dice.choice((0, 0, 0, schema.TX, schema.REMOTE))
        rows.append((i, dice.randrange(n // 3) * 7 * MS, 256 + dice.randrange(4), flags, bytearray(dice.choice((0, 1, 255)) for _ in range(size))))
    df = log(spark, rows).withColumn("channel", F.col("channel").cast("int")).withColumn("remote_dlc", F.lit(None).cast("int")).withColumn("len", F.length("data"))
    return df.select(*[c.split()[0] for c in schema.FRAME_DDL.split(", ")])


@pytest.fixture
def rocks(spark):
    spark.conf.set(*ROCKS)
    yield
    spark.conf.unset(ROCKS[0])


FILTERS = [
    FrameFilter(rules=[Changes()]),
    FrameFilter(rules=[Changes(), ByteEquals(0, 255)], match_all=False, kinds=["data"]),
    FrameFilter(rules=[Changes(), BitIs(1, 0, True), ByteEquals(0, 1)], t0_ns=200 * MS, t1_ns=1500 * MS),
]


def batches(frames, n, shuffled):
    """The frames in n parts, by time or in any order."""
    place = F.xxhash64("seq") if shuffled else F.col("ts_ns")
    cut = frames.withColumn("part", F.ntile(n).over(Window.orderBy(place, "seq")))
    return [cut.where(F.col("part") == i + 1).drop("part") for i in range(n)]


@pytest.mark.parametrize("which", range(len(FILTERS)))
def test_a_stream_settles_to_the_filtered_record(spark, rocks, tmp_path, which):
    frames, spec = frames_of(spark), FILTERS[which]
    want = {r.seq for r in trace.filtered(frames, spec).collect()}
    for part in batches(frames, 4, shuffled=True):
        part.repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(schema.FRAME_DDL).parquet(f"{tmp_path}/in")
        follow.follow(source, spec).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(120)
    verdicts = spark.read.parquet(f"{tmp_path}/out")
    assert {r.seq for r in follow.settled(verdicts).collect()} == want and 0 < len(want) < 900
    assert verdicts.where("revision > 0").count() > 0 and verdicts.where("matches is null").count() == 0


def test_frames_behind_the_horizon_are_undecided(spark, rocks, tmp_path):
    rows = [(0, 0, 9, 0, bytearray([1])), (1, 100 * MS, 9, 0, bytearray([2])), (2, 200 * MS, 9, 0, bytearray([2])), (3, 50 * MS, 9, 0, bytearray([7])), (4, 150 * MS, 9, 0, bytearray([5]))]
    frames = frames_of(spark, 3).limit(0).unionByName(log(spark, rows).withColumn("remote_dlc", F.lit(None).cast("int")))
    for seqs in ([0, 1], [2], [3, 4]):
        frames.where(F.col("seq").isin(seqs)).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(schema.FRAME_DDL).parquet(f"{tmp_path}/in")
        follow.follow(source, FILTERS[0], late_ns=60 * MS).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(120)
    got = sorted((r.seq, r.revision, r.matches) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(0, 0, False), (1, 0, True), (2, 0, False), (2, 1, True), (3, 0, None), (4, 0, True)]


def test_rules_on_a_frame_alone_need_no_state(spark):
    frames = frames_of(spark)
    spec = FrameFilter(rules=[ByteEquals(0, 255)], keys=[256, 258], t1_ns=1000 * MS)
    got = {r.seq for r in follow.settled(follow.follow(frames, spec)).collect()}
    assert got == {r.seq for r in trace.filtered(frames, spec).collect()}
    assert follow.follow(frames, FrameFilter()).count() == 900


def same(got, want):
    key = lambda r: (r.key, r.channel, r.id)
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a.asDict() == {**b.asDict(), "period_ms": pytest.approx(b.period_ms), "jitter_ms": pytest.approx(b.jitter_ms, abs=1e-5)}


@pytest.mark.parametrize("shuffled", [False, True])
def test_statistics_of_a_capture_equal_a_rescan_after_every_batch(spark, tmp_path, shuffled):
    frames = frames_of(spark, 600)
    kept = CaptureLog(f"{tmp_path}/log", 300 * MS)
    seen = frames.limit(0)
    for part in batches(frames, 3, shuffled):
        part.write.mode("append").parquet(f"{tmp_path}/in")
        seen = seen.unionByName(part)
        kept.record(spark.readStream.schema(schema.FRAME_DDL).parquet(f"{tmp_path}/in"), f"{tmp_path}/c").awaitTermination(120)
        same(kept.id_summary(spark).collect(), stats.id_summary(seen).collect())
        assert sorted(map(tuple, kept.bit_flips(spark).collect())) == sorted(map(tuple, stats.bit_flips(seen).collect()))


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    frames, kept = frames_of(spark, 300), CaptureLog(f"{tmp_path}/log", 300 * MS)
    kept._write(frames, 0)
    kept._write(frames, 0)
    assert kept.frames(spark).count() == 300
    same(kept.id_summary(spark).collect(), stats.id_summary(frames).collect())


def test_trim_bounds_the_log_and_loses_no_frame_of_the_window(spark, tmp_path):
    kept = CaptureLog(f"{tmp_path}/log", 10 * MS)
    rows = [(i, i * MS, 9, 0, bytearray([i % 256])) for i in range(300)]
    frames = log(spark, rows).withColumn("remote_dlc", F.lit(None).cast("int")).cache()
    dropped = 0
    for batch in range(10):
        kept._write(frames.where(f"seq between {30 * batch} and {30 * batch + 29}"), batch)
        dropped += kept.trim(spark, 35 * MS)
        seqs = {r.seq for r in kept.frames(spark).collect()}
        newest = 30 * batch + 29
        assert {i for i in range(newest - 35, newest + 1) if i >= 0} <= seqs and len(seqs) <= 46
        assert {r.seq for r in kept.recent(spark, 35 * MS).collect()} == {i for i in range(max(newest - 35, 0), newest + 1)}
    left = kept.frames(spark)
    same(kept.id_summary(spark).collect(), stats.id_summary(left).collect())
    assert dropped == 26
