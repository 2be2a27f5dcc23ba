import math

import pytest
from pyspark.sql import functions as F

from canlake.operators import compare, judging


def periodic(id_, hz, seconds, payload, bus="can0"):
    return [(i / hz, bus, id_, bytes(payload(i, i / hz))) for i in range(int(hz * seconds))]


def log(spark, rows):
    rows = sorted(rows, key=lambda r: r[0])
    out = [(i, int(t * 1e9) + 10**11, bus, 0, id_, 0, "data", len(d), bytearray(d)) for i, (t, bus, id_, d) in enumerate(rows)]
    df = spark.createDataFrame(out, "seq long, ts_ns long, bus string, channel int, id long, flags int, kind string, len int, data binary")
    return df.withColumn("key", F.col("id")).withColumn("remote_dlc", F.lit(None).cast("int"))


def quiet(*_):
    return [0x10, 0x20, 0, 0, 0, 0, 0, 0]


def changed(base, k, value):
    out = list(base)
    out[k] = value
    return out


def counted(i, state, still=False):
    p = [0x11, 0x20 + i // 7 % 3, state, 0, 0, 0, i % 16, 0]
    x = 0x5A
    for v in p[:7]:
        x ^= v
    return [0x11, 0x22, 0, 0, 0, 0, 3, 0] if still else [*p[:7], x]


def noise(i, seed):
    x = (i * 2654435761 + seed * 40503) % 2**32
    x ^= x >> 15
    x = x * 2246822519 % 2**32
    return 0x60 + (x >> 13) % 16


def drift(offset):
    return lambda _, t: [0, offset + int(t / 10), 0, 0, 0]


def rising(start):
    return lambda _, t: [0, 0, 0x40 + int((start + t) / 6), 0]


#: id: (frames of A, frames of B), over logs of 60 seconds each
CASES = {
    0x450: (periodic(0x450, 10, 60, quiet), periodic(0x450, 10, 60, lambda i, t: changed(quiet(), 3, t >= 24))),
    0x451: (periodic(0x451, 10, 60, quiet), periodic(0x451, 10, 60, lambda i, t: changed(quiet(), 5, 0x80 if 12 <= t < 12.5 else 0))),
    0x0C9: (periodic(0x0C9, 20, 60, quiet), periodic(0x0C9, 40, 60, quiet)),
    0x0CA: (periodic(0x0CA, 40, 60, quiet), periodic(0x0CA, 10, 60, quiet)),
    0x200: (periodic(0x200, 10, 60, quiet), periodic(0x200, 10, 60, lambda i, t: quiet()[:6])),
    0x3E9: (periodic(0x3E9, 10, 60, lambda i, t: counted(i, 0)), periodic(0x3E9, 10, 60, lambda i, t: counted(i + 5, 4 if i >= 300 else 0))),
    0x3EA: (periodic(0x3EA, 10, 60, lambda i, t: counted(i, 0)), periodic(0x3EA, 10, 60, lambda i, t: counted(i, 0, True))),
    0x5A0: (periodic(0x5A0, 10, 60, drift(10)), periodic(0x5A0, 10, 60, lambda i, t: changed(drift(30)(i, t), 4, t > 15))),
    0x5A1: (periodic(0x5A1, 20, 60, rising(0)), periodic(0x5A1, 20, 60, rising(60))),
    0x300: (periodic(0x300, 1, 60, lambda i, t: [50 + i % 10]), periodic(0x300, 1, 3, lambda i, t: [99])),
    0x210: (periodic(0x210, 40, 60, lambda i, t: [0x10, noise(i, 1)]), periodic(0x210, 40, 60, lambda i, t: [0x10, noise(i, 2)])),
    0x211: (periodic(0x211, 10, 60, lambda i, t: [i % 16, int(t * 3) & 255, i * 37 % 251, 0]),) * 2,
    0x456: ([(5.0, "can0", 0x456, b"\1")], []),
    0x123: ([], periodic(0x123, 5, 60, quiet)),
}


@pytest.fixture(scope="module")
def found(spark):
    a, b = (log(spark, [r for case in CASES.values() for r in case[side]] + [(0.0, "can0", 1, b"\0"), (60.0, "can0", 1, b"\0")]) for side in (0, 1))
    return {rules: {r.id: r for r in compare.different_bytes(compare.compare_logs(a, b, *rules)).collect()} for rules in ((False, False), (True, False), (True, True))}


def test_known_cases(found):
    plain, counters, within = found.values()
    assert (plain[0x450].reason, plain[0x450].bytes) == ("Byte 3 takes new values", [3]) and plain[0x450].score >= 85
    assert plain[0x451].reason == "Byte 5 takes new values" and plain[0x451].score >= 60
    assert (plain[0x0C9].reason, plain[0x0C9].score, plain[0x0C9].bytes) == ("Rate doubled", 80, [])
    assert (plain[0x0CA].reason, plain[0x0CA].score) == ("Rate down 4.0x", 80)
    assert (plain[0x200].reason, plain[0x200].score) == ("Length changes from 8 to 6 bytes", 90)
    assert (plain[0x456].presence, plain[0x456].score, plain[0x456].reason) == ("onlyA", 100, "Appears only in A")
    assert (plain[0x123].presence, plain[0x123].score, plain[0x123].frames_a) == ("onlyB", 100, 0)
    assert (plain[0x300].reason, plain[0x300].score, plain[0x300].too_few, plain[0x300].payloads_differ) == ("Too few frames to compare; payloads differ", 0, True, True)
    assert (counters[0x3E9].bytes, counters[0x3E9].reason) == ([2], "Byte 2 takes new values") and 6 in counters[0x3EA].bytes
    assert {1, 4} <= set(plain[0x5A0].bytes) and within[0x5A0].bytes == [4]
    assert plain[0x5A1].reason == "Byte 2 takes new values"
    assert (within[0x5A1].reason, within[0x5A1].within_a) == ("Also changes within A", True) and within[0x5A1].score < 10
    for rules in found.values():
        assert rules[0x210].score < 10 and rules[0x211].score == 0 and rules[1].too_few


def test_bytes_and_buses(spark):
    a = log(spark, CASES[0x450][0] + CASES[0x3E9][0])
    b = log(spark, [(t, "vcan7", i, d) for t, _, i, d in CASES[0x450][1] + CASES[0x3E9][1]])
    rows = {r.id: r for r in compare.compare_logs(a, b, ignore_counters=True).collect()}
    assert [(r.bus, r.bus_b, r.presence) for r in rows.values()] == [("can0", "vcan7", "both")] * 2
    body = {x.byte: x for x in rows[0x450].bytes}
    assert body[3].new_values == [1] and body[3].bits[0] >= 0.5 and body[3].bits[1] == 0 and body[0].score == 0 and body[3].reason == "Byte 3 takes new values"
    assert [(x.byte, x.counter, x.checksum) for x in rows[0x3E9].bytes if x.counter or x.checksum] == [(6, 0x0F, 0), (7, 0, 0xFF)]
    two = [log(spark, [(0.0, x, 1, b"\0"), (1.0, y, 1, b"\0")]) for x, y in (("can0", "can1"), ("vcan0", "vcan1"), ("can1", "vcan0"))]
    assert {r.bus_b: r.bus for r in compare.matched_buses(two[0], two[1]).collect()} == {"vcan0": "can0", "vcan1": "can1"}
    assert {r.bus_b: r.bus for r in compare.matched_buses(two[0], two[2]).collect()} == {"can1": "can1", "vcan0": "vcan0"}
    assert {r.group for r in compare.grouped(compare.compare_logs(two[0], two[1])).collect()} == {"tooFew"}
    assert compare.compare_csv(compare.compare_logs(a, b)).count() == 2


def test_scores_by_hand():
    assert judging.rate_score(2.0, 10**9) == pytest.approx(0.8) and judging.rate_score(1.05, 100) == 0 and judging.rate_score(1.5, 10**9) == pytest.approx(0.8 * 0.4 / 0.9)
    import numpy as np

    reference, other = np.zeros(256, np.int64), np.zeros(256, np.int64)
    reference[[10, 11, 12, 13, 14, 15, 16, 20]] = 50
    other[[18, 21, 40]] = 5
    explained = judging.reach(reference, other, 1)
    assert explained[[17, 18, 19, 21, 9]].all() and not explained[[22, 40, 8]].any()  # holes and a step past the ends
    stretches = np.zeros(256, np.uint64)
    stretches[40] = 0b1011
    score, new = judging.novelty(reference, other, stretches, 1, 1.0, np.zeros(256, bool))
    share = 5 / 15
    expected = min(3.0, share * 400)
    assert new.tolist() == [40] and score == pytest.approx((1 - math.exp(-expected)) * (0.75 + 0.25))
    wrapped = np.zeros(256, np.int64)
    wrapped[[253, 254, 255, 0, 1, 2, 3, 4]] = 9
    assert judging.reach(wrapped, other, 1)[[252, 5]].all()


def test_cells_are_counted_in_their_tasks(spark, monkeypatch):
    import collections

    import numpy as np
    import pyarrow as pa

    random = np.random.default_rng(5)
    payload = lambda: bytes(random.integers(0, 7, random.integers(0, 5)).tolist())
    frames = [("a", "can0", 7 + i % 2, 4, i // 30, i % 5 == 0, payload() if i % 9 else None, payload() if i % 4 else None) for i in range(200)]
    want = collections.Counter()
    for part, bus, id_, size, stretch, fd, data, before in frames:
        own, v, u = (part, bus, id_), data or b"", before or b""
        for i, x in enumerate(v):
            want[*own, "value", i, x, stretch] += 1
            for hist, y in (("xor", x ^ u[i]), ("step", (x - u[i]) % 256), ("high", ((x >> 4) - (u[i] >> 4)) % 16)) if i < len(u) else ():
                want[*own, hist, i, y, 0] += 1
        if len(v) == size:
            for hist, y in (("first sum", 2 * v[0] - sum(v)), ("last sum", 2 * v[-1] - sum(v)), ("all xor", v[0] ^ v[1] ^ v[2] ^ v[3])):
                want[*own, hist, 0, y % 256, 0] += 1
        if fd:
            want[*own, "fd", 0, 0, 0] += 1
        want[*own, "length", 0, 127 if data is None else len(v), 0] += 1
    names = ["part", "bus", "id", "size", "stretch", "fd", "data", "before"]
    types = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
    whole = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*frames), types)], names)
    for gathered, kept in ((1 << 21, 1 << 20), (100, 40)):  # all at once, and given away in between
        monkeypatch.setattr(compare, "_GATHERED", gathered)
        monkeypatch.setattr(compare, "_KEPT", kept)
        got = collections.Counter()
        for b in compare._counted(iter([whole.slice(0, 70), whole.slice(70, 0), whole.slice(70)])):
            for r in b.to_pylist():
                got[r["part"], r["bus"], r["id"], r["hist"], r["byte"], r["x"], r["mask"].bit_length() - 1 if r["hist"] == "value" else 0] += r["n"]
        assert got == want
    # a frame is not spread into a row for each cell
    a = log(spark, CASES[0x450][0]).withColumns({"part": F.lit("a"), "size": F.lit(8)})
    plan = compare.cells(a)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "flatten" not in plan
