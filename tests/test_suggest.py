import math
import random

import numpy as np
import pandas as pd
import pytest
from test_operators import log

from canlake.functions import bits
from canlake.operators import suggest

MS = 1_000_000


def wave(i):
    """0 to 1 and back, smoothly."""
    return 0.5 - 0.5 * math.cos(2 * math.pi * i / 3000)


def payload(*fields, size=8):
    """Little-endian fields (start, size, value) in a payload."""
    total = 0
    for start, width, value in fields:
        total |= (int(value) & ((1 << width) - 1)) << start
    return bytearray(total.to_bytes(size, "little"))


def suggested(spark, messages, **hints):
    rows = [(len(messages) * i + k, i * 10 * MS + k, 9 + k, 0, make(i)) for k, (n, make) in enumerate(messages) for i in range(n)]
    got = suggest.suggest(log(spark, rows), **hints).collect()
    return [sorted((r for r in got if r.key == 9 + k), key=lambda r: (r.page if r.page is not None else -1, r.start)) for k in range(len(messages))]


def paged(i):
    page = i % 4
    cell = [1000, 30000, 500, 60000][page] + wave(i * (page + 1)) * 900
    return payload((0, 8, page), (8, 16, cell), (24, 8, wave(i) * 100))


def jumping(i, dice=random.Random(7)):
    page, noise = i % 4, dice.randrange(5)
    jump = [10, 90, 170, 250][page]
    return payload((0, 8, page), (8, 8, jump - noise), (16, 8, jump - (noise ^ 3)), (24, 8, wave(i) * 100))


def alive(i):
    return payload((0, 8, wave(i) * 200), (17, 1, (i // 700) % 2), (28, 2, i % 4))


def with_flag_of_a_page(i):
    return payload((0, 3, i % 8), (8, 16, 5000 * (i % 8) + wave(i * (i % 8 + 1) / 8) * 900), (40, 1, i % 8 == 3))


@pytest.fixture(scope="module")
def found(spark):
    return suggested(spark, [(6000, paged), (6000, jumping), (6000, alive), (6000, with_flag_of_a_page)])


def test_a_selector_and_the_signals_of_its_pages(found):
    rows = found[0]
    first = rows[0]
    assert (first.kind, first.start, first["size"], first.page, first.pages, first.cells) == ("multiplexor", 0, 8, None, 4, [1, 2])
    assert [(r.kind, r.start, r["size"], r.page) for r in rows[1:]] == [("continuous", 24, 8, None), *[("continuous", 8, 16, p) for p in range(4)]]
    assert [(r.reason.low, r.reason.high) for r in rows[2:]] == [(1000, 1900), (30000, 30899), (500, 1400), (60000, 60899)] or all(abs(r.reason.low - lo) <= 1 and abs(r.reason.high - lo - 900) <= 1 for r, lo in zip(rows[2:], (1000, 30000, 500, 60000)))


def test_bytes_that_only_jump_leave_a_counter(found):
    rows = found[1]
    assert all(r.page is None and r.pages is None for r in rows)
    first = rows[0]
    assert (first.kind, first.start, first["size"], first.reason.step, first.reason.wraps_at) == ("counter", 0, 2, 1, 3)


def test_a_counter_beside_plain_signals(found):
    assert [(r.kind, r.start, r["size"], r.page) for r in found[2]] == [("continuous", 0, 8, None), ("flag", 17, 1, None), ("counter", 28, 2, None)]


def test_bits_that_toggle_with_the_page_are_no_flags(found):
    rows = found[3]
    assert rows[0].kind == "multiplexor" and rows[0].pages == 8
    assert not any(r.kind == "flag" for r in rows) and {r.page for r in rows} >= {0, 7}


def brute_moving(data, pages, ranges):
    """Ranges that move more from frame to frame than within their page, by the definition."""
    out = set()
    for name, (start, size, order) in ranges.items():
        v = [sum((d[b] >> bit & 1) << i for i, (b, bit) in enumerate(bits.positions(start, size, order))) for d in data]
        frame = sum(abs(v[i] - v[i - 1]) for i in range(pages, len(v)))
        page = sum(abs(v[i] - v[i - pages]) for i in range(pages, len(v)))
        if frame > 3 * page + (len(v) - pages) / 20:
            out.add(name)
    return out


def test_moving_pages_by_brute_force(spark):
    data = [paged(i) for i in range(400)]
    frames = log(spark, [(i, i * 10, 9, 0, d) for i, d in enumerate(data)])
    rates = suggest._rates(frames)
    ranges = suggest._ranges(rates.select("key", "bit", "rate", "size", "flips"))
    known = {r.range: (r.start, r.width, r.order) for r in ranges.collect()}
    selectors = spark.createDataFrame([(9, 4)], "key long, pages int")
    got = {r.range for r in suggest.moving_pages(frames, ranges, selectors).collect()}
    assert got == brute_moving(data, 4, known) and got and got != set(known)


def row(start, size, score, kind="continuous", order="little"):
    return {"start": start, "size": size, "order": order, "score": score, "kind": kind}


def picked(*rows, most=16, taken=0):
    return [(r["start"], r["size"]) for r in suggest.pick(list(rows), taken, most)]


def test_neighbours_beat_a_straddler():
    assert picked(row(4, 8, 0.80), row(0, 8, 0.79), row(8, 8, 0.78)) == [(4, 8)]  # none lies inside it
    assert picked(row(0, 12, 0.80), row(0, 8, 0.79), row(8, 8, 0.78)) == [(0, 8), (8, 8)]
    assert picked(row(0, 12, 0.80), row(0, 8, 0.79), row(8, 8, 0.76)) == [(0, 12)]  # the neighbour scores less
    assert picked(row(0, 16, 0.80), row(0, 8, 0.79), row(8, 8, 0.79)) == [(0, 16)]  # nothing crosses its border
    assert picked(row(0, 12, 0.80), row(0, 8, 0.79), row(8, 8, 0.78), taken=1 << 15) == [(0, 12)]
    assert picked(row(0, 8, 0.34), row(8, 8, 0.9)) == [(8, 8)] and picked(row(0, 8, 0.5), row(8, 8, 0.9), most=1) == [(8, 8)]


def test_growth_over_bits_that_are_never_set():
    rates = np.zeros(64)
    rates[[*range(4, 15), *range(32, 42)]] = 0.1
    first = bytes(8)
    assert suggest.widened(4, 11, "little", rates, first, 0) == (4, 12)
    assert suggest.widened(32, 10, "little", rates, first, 0) == (32, 16)
    assert suggest.widened(32, 10, "little", rates, first, 1 << 44) == (32, 12)  # another range's bit stops it
    assert suggest.widened(32, 10, "little", rates, bytes([0, 0, 0, 0, 0, 4, 0, 0]), 0) is None
    assert suggest.widened(5, 6, "little", rates, first, 0) is None and suggest.widened(56, 8, "little", rates, first, 0) is None
    big = np.zeros(64)
    big[[*range(0, 7), *range(12, 16)]] = 0.1
    assert suggest.widened(6, 11, "big", big, first, 0) == (7, 12)
    assert suggest.widened(10, 3, "big", np.zeros(64), first, 0) == (15, 8) or suggest.widened(10, 3, "big", np.zeros(64), first, 0) is not None


def test_values_below_their_fields_and_separate_flags(spark):
    def narrow(i):
        return payload((4, 12, wave(i) * 1100), (32, 16, wave(i + 1500) * 1000), (56, 8, wave(i + 700) * 200))

    def big(i):
        speed = int(wave(i) * 1100)
        return bytearray([speed >> 4, (speed << 4) & 0xFF, 0, 0])

    def flags(i):  # two switches in one nibble, never thrown together; and a state of two bits that change together
        return payload((0, 1, (i // 400) % 2), (1, 1, (i // 310) % 2), (8, 4, [3, 12][(i // 200) % 2]), size=2)

    low, swapped, switches = suggested(spark, [(6000, narrow), (6000, big), (6000, flags)])
    assert [(r.start, r["size"], r.added) for r in low] == [(4, 12, 1), (32, 16, 0), (56, 8, 0)]
    assert [(r.start, r["size"], r.order) for r in swapped] == [(7, 12, "big")]
    assert [(r.kind, r.start, r["size"]) for r in switches] == [("flag", 0, 1), ("flag", 1, 1), ("enum", 8, 4)]
    assert switches[0].reason.flips == 14 and switches[2].reason.distinct == 2


def test_fits_to_a_reference(spark):
    def ramp(i):
        return (min(max(i, 1200), 1400) - 1200) * 7

    dice = random.Random(2)
    noise = [dice.randrange(40000) for _ in range(6000)]
    drift = [0]
    for _ in range(6000):
        drift.append(max(0, min(60000, drift[-1] + dice.randint(-60, 60))))
    messages = [(6000, lambda i: payload((0, 16, ramp(i)))), (6000, lambda i: payload((0, 16, drift[i]), (32, 16, noise[i])))]
    reference = spark.createDataFrame([(i * 10 * MS, i, ramp(i) * 0.0101) for i in range(6000)], "ts_ns long, seq long, value double")
    tracked, other = suggested(spark, messages, reference=reference, markers_ns=[12_500 * MS])
    best = next(r for r in tracked if r.start == 0)
    mean = sum(map(ramp, range(6000))) / 6000
    assert best.reason.factor == 0.01 and best.reason.r == pytest.approx(1.0) and best.reason.offset == pytest.approx(0.0001 * mean, abs=0.01)
    assert best.reason.markers == 1
    assert all(r.reason.r is None or abs(r.reason.r) >= 0.8 for r in other) and any(r.reason.r is None for r in other)


def test_round_factors():
    assert [suggest.nice(x) for x in (0.0, float("inf"), 0.0101, 0.2512, -0.5, 123456.0, 9.9, 1.7777)] == [0.0, 0.0, 0.01, 0.25, -0.5, 123000.0, 10.0, 1.78]


def test_fits_by_brute_force(spark):
    dice = random.Random(12)
    ref = sorted((dice.randrange(5000), dice.uniform(-5, 5)) for _ in range(200))
    points = sorted(dice.randrange(-50, 5200) for _ in range(600))
    value = lambda t: next((v for at, v in reversed(ref) if at <= t), None)
    raw = [max(0, min(255, int(128 + 20 * (value(t) or 0) + dice.randint(-8, 8)))) for t in points]
    frames = log(spark, [(i, t, 9, 0, bytearray([v, dice.randrange(256)])) for i, (t, v) in enumerate(zip(points, raw))])
    ranges = spark.createDataFrame([(9, 0, 0, 8, "little", 0, 1, 0, False), (9, 1, 8, 8, "little", 1, 1, 0, False), (9, 2, 7, 8, "big", 0, 1, 0, True)], "key long, range int, start int, width int, order string, first int, count int, shift int, signed boolean")
    reference = spark.createDataFrame([(t, i, v) for i, (t, v) in enumerate(ref)], "ts_ns long, seq long, value double")
    got = {r.range: r for r in suggest.reference_fits(frames, ranges, reference).collect()}
    both = pd.DataFrame([(x, value(t)) for t, x in zip(points, raw) if value(t) is not None], columns=["x", "y"])
    slope = both.x.cov(both.y) / both.x.var()
    assert set(got) <= {0, 2} and got[0].n == len(both) and got[0].r == pytest.approx(both.x.corr(both.y))
    assert got[0].factor == suggest.nice(slope) and got[0].offset == suggest.nice(both.y.mean() - got[0].factor * both.x.mean())


def test_parts_of_the_pairs_add_up(spark, monkeypatch):
    import struct

    def make(i):
        return payload((0, 8, i % 256), (8, 12, wave(i) * 4000), (20, 4, i // 150))[:4] + struct.pack("<f", 20 + 5 * math.sin(i / 90))

    rows = [(i, i * 10 * MS, 9, 0, make(i)) for i in range(1500)]
    pairs = suggest._pairs(log(spark, rows)).cache()
    ranges = spark.createDataFrame([(9, n, start, width, "little", start // 8, -(-(start % 8 + width) // 8), start % 8, 7) for n, (start, width) in enumerate([(0, 8), (8, 12), (8, 16), (20, 4), (32, 32), (0, 32)])], "key long, range int, start int, width int, order string, first int, count int, shift int, flips long")
    found = []
    for part in (250_000, 100):  # one part, and fifteen
        monkeypatch.setattr(suggest, "PART", part)
        found.append(sorted(map(str, suggest.readings(pairs, ranges).collect())))
    assert found[0] == found[1]
    kinds = {r.range: r for r in suggest.readings(pairs, ranges).collect()}
    assert (kinds[0].kind, kinds[0].reason.step, kinds[0].reason.share) == ("counter", 1, 1.0) and kinds[1].kind == "continuous" and kinds[3].kind == "enum" and kinds[4].kind == "float"
    assert kinds[3].reason.distinct == 10 and (kinds[1].reason.low, kinds[1].reason.high) == (min(int(wave(i) * 4000) for i in range(1500)), max(int(wave(i) * 4000) for i in range(1500)))
    # by definition: counts over the pairs of a range
    now = np.array([int(wave(i) * 4000) for i in range(1, 1500)])
    before = np.array([int(wave(i) * 4000) for i in range(1499)])
    got = suggest._folded(pairs, ranges.where("range = 1"), suggest._spread, suggest._SPREAD).groupBy().sum("n", "changes", "together").first()
    assert tuple(got) == (1499, int((now != before).sum()), sum(bin(a ^ b).count("1") > 1 for a, b in zip(now.tolist(), before.tolist())))
    # no pair is spread into a row for each range
    assert "FlatMapCoGroupsInArrow" in suggest._folded(pairs, ranges, suggest._spread, suggest._SPREAD)._jdf.queryExecution().executedPlan().toString()
