import random

import pytest

from canlake.streaming import clock
from canlake.streaming.clock import AHEAD, OFF_FOR, Clock


def rising(times):
    return all(a < b for a, b in zip(times, times[1:]))


def anchored(device=0, host=0, wrap=60e9):
    c = Clock(wrap)
    c.anchor(device, host)
    return c


def across_sleep(slept_s, wrap=60e9, glitches=None):
    """A frame every 10 ms, 1 ms on its way; the host sleeps at 100 s while the adapter counts on."""
    c, out, jumps = anchored(wrap=wrap), [], []
    for ms in range(10, 110_001, 10):
        device = (ms * 1e6 + (slept_s * 1e9 if ms > 100_000 else 0) + (glitches or {}).get(ms, 0) * 1e9) % wrap
        host = ms * 1e6 + 1e6
        t, jumped = c.time(device, host)
        out.append((host, t))
        if jumped is not None:
            jumps.append(round(jumped / 1e9, 1))
    return out, jumps


def furthest(out, since):
    return max(abs(t - h) for h, t in out if h >= since)


def test_times_before_arrival_stay_as_stamped():
    c = anchored(10e9)
    assert c.time(10.5e9, 0.7e9)[0] == 0.5e9 and c.time(11.2e9, 1.5e9)[0] == 1.2e9


def test_a_fast_clock_is_pulled_back():
    c, times, ahead = anchored(), [], []
    for s in range(1, 3 * 3600 + 1):
        t, jumped = c.time((s * 1.0005e9) % 60e9, s * 1e9 + 1e6)
        times.append(t)
        ahead.append(t - s * 1e9 - 1e6)
        assert jumped is None
    assert max(ahead) <= 0 and rising(times)


@pytest.mark.parametrize("ppm,hours,most", [(500, 6, 12e6), (100, 12, 5e6)])
def test_a_slow_clock_is_followed(ppm, hours, most):
    c, times = anchored(), []
    for s in range(1, hours * 3600 + 1):
        t, jumped = c.time((s * (1e9 - ppm * 1e3)) % 60e9, s * 1e9 + 1e6)
        times.append(t)
        assert jumped is None and s * 1e9 + 1e6 - t < most
    assert rising(times)


@pytest.mark.parametrize("share,most", [(0.2, 500e6), (0.99, 300e6)])
def test_late_frames_don_t_hide_a_slow_clock(share, most):
    c, dice, behind = anchored(), random.Random(1), 0
    for ms in range(10, 1_200_001, 10):
        sent = ms * 1e6
        t, jumped = c.time((sent * (1 - 100e-6)) % 60e9, sent + 1e6 + (dice.random() * most if dice.random() < share else 0))
        assert jumped is None
        behind = max(behind, sent - t)
    assert behind < 5e6


def test_an_anchor_taken_late_is_pulled_back():
    c = Clock(60e9)
    assert c.time(0, 50e6)[0] == 50e6 and c.time(10e6, 11e6)[0] == 60e6 - 10e3
    times = [c.time((ms * 1e6) % 60e9, ms * 1e6 + 1e6)[0] for ms in range(20, 60_001, 10)]
    assert abs(times[-1] - 60_001e6) < 1 and rising(times)


def test_a_stamp_in_the_past_keeps_the_next_in_order():
    c = anchored(0, 0.5e9)
    before = c.time(10e9, 10e9)[0]
    c.time(5e9, 10.1e9)
    assert c.time(10.001e9, 10.2e9)[0] > before


def test_a_glitch_is_held_and_changes_nothing():
    odd, plain = anchored(), anchored()
    assert odd.time(1e9, 1e9 - 0.5e6) == plain.time(1e9, 1e9 - 0.5e6)
    assert odd.time(31e9, 1.5e9)[0] == 1.5e9 + AHEAD
    for s, late in ((2, 1e6), (3, 2e6), (10, 1e6)):
        assert odd.time(s * 1e9, s * 1e9 - late) == plain.time(s * 1e9, s * 1e9 - late)
    quiet = anchored()
    assert [quiet.time(*x) for x in ((1e9, 1e9), (25e9, 5e9), (28e9, 8e9), (11e9, 11e9))] == [(1e9, None), (5e9 + AHEAD, None), (8e9 + AHEAD, None), (11e9, None)]


def test_a_sleep_anchors_anew():
    out, jumps = across_sleep(10)
    assert jumps == [10.0] and rising([t for _, t in out])
    assert all(t == h + AHEAD for h, t in out if 100.001e9 < h < 100.001e9 + OFF_FOR)
    assert furthest(out, 100.001e9 + OFF_FOR + AHEAD + 0.1e9) <= 1e6
    out, jumps = across_sleep(10, 2**32 * 1e3, {101_000: 25})
    assert jumps == [10.0] and rising([t for _, t in out])
    out, jumps = across_sleep(40)  # folds into the wrap of 60 s
    assert jumps == [-20.0]
    at = next(i for i, (h, _) in enumerate(out) if h >= 100.011e9 + OFF_FOR)
    assert abs(out[at - 1][0] - out[at - 1][1] - 20e9) < 1e7 and out[at][1] > max(t for _, t in out[:at])
    assert rising([t for _, t in out[at:]]) and furthest(out[at:], 0) <= 1e6


def test_saved_clocks_go_on():
    whole, parts = anchored(), anchored()
    for ms in range(10, 105_000, 10):
        device, host = (ms * 1e6 + (10e9 if ms > 100_000 else 0)) % 60e9, ms * 1e6 + 1e6
        assert whole.time(device, host) == parts.time(device, host)
        if ms % 1000 == 0:
            parts = Clock.load(parts.save())


def test_a_stream_equals_the_fold_of_its_record(spark, tmp_path):
    dice, rows = random.Random(4), []
    for name, ppm, slept in (("a", 300, 0), ("b", -200, 10e9), (None, 0, 40e9)):
        for i in range(1500):
            sent = i * 0.1e9
            device = int((sent * (1 + ppm * 1e-6) + (slept if sent > 100e9 else 0)) % 60e9)
            rows.append((name, i, device if i % 400 != 3 else None, int(sent + 1e6 + dice.random() * 2e6), i % 7))
    frames = spark.createDataFrame(rows, "adapter string, arrival long, device_ns long, host_ns long, ts_ns int")
    want = {(r.adapter, r.arrival): (r.ts_ns, r.jumped_ns) for r in clock.stamped(frames, clock.SLCAN_WRAP).collect()}
    for name in ("a", "b", None):
        c = Clock(clock.SLCAN_WRAP)
        for n, i, device, host, _ in rows:
            if n == name and device is not None:
                t, jumped = c.time(device, host)
                assert abs(want[n, i][0] - t) <= 0.5 and want[n, i][1] == (None if jumped is None else round(jumped))
    assert want["a", 3] == (None, None) and clock.messages(clock.stamped(frames, clock.SLCAN_WRAP)).count() == 2
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in range(5):  # each batch continues from the checkpoint, as after a restart
            frames.where(f"arrival between {300 * part} and {300 * part + 299}").repartition(3).write.mode("append").parquet(f"{tmp_path}/seen")
            source = spark.readStream.schema(frames.schema).parquet(f"{tmp_path}/seen")
            out = clock.stamp_stream(source, clock.SLCAN_WRAP)
            out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert len(got) == len(rows) and {(r.adapter, r.arrival): (r.ts_ns, r.jumped_ns) for r in got} == want
