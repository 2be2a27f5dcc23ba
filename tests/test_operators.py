import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from canlake import schema
from canlake.functions import bits, dbc
from canlake.functions import frames as ff
from canlake.operators import decode, find, series, stats, suggest, trace
from canlake.operators.history import with_index, with_previous
from canlake.plans import catalogue
from canlake.sources import events


def log(spark, rows):
    """rows: (seq, ts_ns, id, flags, data)"""
    df = spark.createDataFrame(rows, "seq long, ts_ns long, id long, flags int, data binary").withColumn("channel", F.lit(0))
    return df.withColumn("key", ff.key(F.col("channel"), F.col("id"))).withColumn("kind", ff.kind(F.col("flags"))).withColumn("len", F.length("data"))


def raw_bits(data, start, size, order):
    value = 0
    for i, (b, bit) in enumerate(bits.positions(start, size, order)):
        value |= (data[b] >> bit & 1) << i
    return value


def test_extract_any_field(spark):
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(12))
    df = spark.createDataFrame([(bytearray(data),)], "data binary")
    fields = [(rng.randrange(30), rng.randint(1, 64), bits.LITTLE) for _ in range(30)] + [(rng.randrange(30), rng.randint(1, 60), bits.BIG) for _ in range(30)]
    fields = [f for f in fields if max(b for b, _ in bits.positions(*f)) < len(data)]
    got = df.select(*[bits.extract(F.col("data"), *f).alias(str(i)) for i, f in enumerate(fields)]).first()
    for value, f in zip(got, fields):
        assert value % 2**64 == raw_bits(data, *f), f
    short = df.select(bits.extract(F.col("data"), 90, 10).alias("x")).first()
    assert short.x is None and bits.positions(7, 16, bits.BIG)[-1] == (0, 7)


def test_floats_and_unsigned(spark):
    values = [0.0, 1.5, -2.25, 3.4e38, 1e-40, float("inf")]
    df = spark.createDataFrame([(struct.unpack("<q", struct.pack("<d", v))[0], struct.unpack("<I", struct.pack("<f", v))[0], v) for v in values], "d long, f long, v double")
    for r in df.select(bits.float64(F.col("d")).alias("d"), bits.float32(F.col("f")).alias("f"), "v").collect():
        assert r.d == r.v and r.f == struct.unpack("<f", struct.pack("<f", r.v))[0]
    top = spark.sql("select -1L as x").select(bits.unsigned_double(F.col("x")).alias("u"), bits.sign_extend(F.lit(0x80).cast("long"), 8).alias("s")).first()
    assert top.u == 2.0**64 and top.s == -128


@pytest.mark.parametrize("span", [1, 7, 10**9])
def test_previous_and_index_do_not_depend_on_spans(spark, span):
    rng = random.Random(4)
    rows = [(i, rng.randrange(60), rng.randrange(3), 0, bytearray([i % 256])) for i in range(200)]
    got = with_index(with_previous(log(spark, rows), ["id"], {"seq": "before"}, span), ["id"], "n", span).collect()
    for k in range(3):
        mine = sorted((r.ts_ns, r.seq, r.before, r.n) for r in got if r.id == k)
        assert [m[3] for m in mine] == list(range(len(mine)))
        assert [m[2] for m in mine] == [None] + [m[1] for m in mine[:-1]]


def test_flips_follow_kind_and_common_length(spark):
    rows = [(0, 0, 1, 0, bytearray([0, 0])), (1, 1, 1, schema.REMOTE, bytearray()), (2, 2, 1, 0, bytearray([1])), (3, 3, 1, 0, bytearray([3, 9]))]
    got = {(r.byte, r.bit): (r.flips, r.pairs) for r in stats.bit_flips(log(spark, rows)).collect()}
    assert got[0, 0] == (1, 2) and got[0, 1] == (1, 2) and got[1, 0] == (0, 0) and len(got) == 16


def test_filters(spark):
    rows = [(0, 0, 1, 0, bytearray([5])), (1, 10, 1, 0, bytearray([5])), (2, 20, 1, 0, bytearray([6])), (3, 30, 2, schema.ERROR, bytearray())]
    df = log(spark, rows)
    seqs = lambda spec: [r.seq for r in trace.filtered(df, spec).orderBy("seq").collect()]
    assert seqs(trace.FrameFilter()) == [0, 1, 2, 3] and seqs(trace.FrameFilter(keys=[])) == []
    assert seqs(trace.FrameFilter(rules=[trace.BitIs(3, 0, False)])) == []
    assert seqs(trace.FrameFilter(rules=[trace.Changes()], t0_ns=20)) == [2]
    assert seqs(trace.FrameFilter(t0_ns=20, t1_ns=10)) == []
    assert seqs(trace.FrameFilter(rules=[trace.ByteEquals(0, 6), trace.ByteEquals(0, 5)], match_all=False, t0_ns=10)) == [1, 2]


def test_multiplexing_and_precedence(spark):
    text = """BO_ 100 A: 8 X
 SG_ Mux M : 0|8@1+ (1,0) [0|0] "" X
 SG_ One m1 : 8|8@1+ (2,1) [0|0] "" X
 SG_ Deep m3 : 16|8@1+ (1,0) [0|0] "" X
 SG_ F : 32|32@1- (1,0) [0|0] "" X
SG_MUL_VAL_ 100 Deep One 3-5,9-9;
SIG_VALTYPE_ 100 F : 1;
CM_ SG_ 100 One "two
lines";
"""
    base = dbc.read(text)
    assert dbc.read(dbc.write(base)) == base
    message = base.messages[0]
    rows = [(i, i, 100, 0, bytearray(d)) for i, d in enumerate([[1, 4, 7, 0, 0, 0, 0x80, 0x3F], [1, 6, 7, 0, 0, 0, 0, 0], [2, 4, 7, 0, 0, 0, 0, 0], [1, 9]])]
    got = {(r.seq, r.signal): r.value for r in decode.decode_all(log(spark, rows), base).collect()}
    assert got[0, "One"] == 9.0 and got[0, "Deep"] == 7.0 and got[0, "F"] == 1.0 and (1, "Deep") not in got and (2, "One") not in got and (2, "Deep") not in got
    assert got[3, "One"] == 19.0 and (3, "Deep") not in got and message.signals[1].comment == "two\nlines"

    ext = schema.EXTENDED_ID
    j = dbc.Database((dbc.Message(ext | 0x18FEF1AA, "ANY", 8, j1939=True), dbc.Message(ext | 0x0CFEF100, "SAME", 8, j1939=True)))
    exact = dbc.Database((dbc.Message(ext | 0x18FEF100, "EXACT", 8),))
    ids = spark.createDataFrame([(0, ext | 0x18FEF100), (1, ext | 0x18FEF100), (0, schema.ERROR_ID), (0, ext | 0x18FEF155)], "channel int, id long")
    named = {(r.channel, r.id): r.message for r in decode.resolve(ids, [dbc.Scope(j), dbc.Scope(exact, 1)]).collect()}
    assert named == {(0, ext | 0x18FEF100): "SAME", (1, ext | 0x18FEF100): "EXACT", (0, schema.ERROR_ID): None, (0, ext | 0x18FEF155): "ANY"}


def test_view_keeps_spikes_and_nan(spark):
    rows = [(i * 10, i, float(v)) for i, v in enumerate([1, 2, "nan", 9, 9, 1, 0, 4, 4, 4, 4, 5])]
    df = spark.createDataFrame(rows, "ts_ns long, seq long, value double")
    got = sorted((r.ts_ns, str(r.value)) for r in series.view(df, 0, 110, 2).collect())
    assert got == [(0, "1.0"), (20, "nan"), (30, "9.0"), (60, "0.0"), (70, "4.0"), (110, "5.0")]
    assert series.view(df, 30, 50, 3).count() == 5
    info = series.info(df).first()
    assert (info["count"], info["min"], info["max"]) == (12, 0.0, 9.0)


def test_candidates_and_search(spark):
    assert len(find.candidates(8)) == 204
    rows = [(i, i, 7, 0, bytearray([i, 200 - i, i % 2, 0, 0, 0, 0, 0])) for i in range(50)]
    best = find.find_signal(log(spark, rows), [find.Rule(0, 100, find.INCREASES)], 8).first()
    assert best.score > 0.9 and best["size"] == 8


def brute_found(rows, rules):
    """rows: (key, ts_ns, seq, data) of data frames"""
    out = set()
    for k in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == k)
        for c in find.candidates(min(len(d) for *_, d in own)):
            score = 1.0
            for rule in rules:
                values = [raw_bits(d, *c) for t, _, d in own if rule.t0_ns <= t <= rule.t1_ns]
                up, down = sum(b > a for a, b in zip(values, values[1:])), sum(b < a for a, b in zip(values, values[1:]))
                score *= 0 if len(values) < 2 else max(up - down, 0) / (up + down + 1) if rule.says == find.INCREASES else (up + down) / (len(values) - 1)
            if score > 0:
                out.add((k, *c, round(score, 9)))
    return out


def test_find_signal_in_each_id_s_own_length(spark):
    rng = random.Random(4)
    rows = []
    for i in range(240):
        id_ = 1 + i % 4
        size = {1: 3, 2: 8, 3: 12, 4: 5 + i % 3}[id_]
        rows.append((i, i * 10, id_, 0, bytearray(rng.randrange(256) if b % 3 else i * (b + 1) % 256 for b in range(size))))
    rules = [find.Rule(0, 1500, find.INCREASES), find.Rule(0, 5000, find.CHANGES)]
    got = find.find_signal(log(spark, rows), rules, limit=None).collect()
    want = brute_found([(id_, t, seq, data) for seq, t, id_, _, data in rows], rules)
    assert {(r.key, r.start, r["size"], r.order, round(r.score, 9)) for r in got} == want and len(got) == len(want)
    assert {(s, o) for _, _, s, o, _ in want} == {(8, "little"), (8, "big"), (16, "little"), (16, "big")} and any(k == 3 and start >= 64 for k, start, *_ in want)


def test_find_signal_whole_query(spark, sf):
    df = events.frames(spark, sf).where("kind = 'data'")
    rules = [find.Rule(0, catalogue.T1, find.INCREASES), find.Rule(0, 1 << 62, find.CHANGES)]
    want = brute_found([(r.key, r.ts_ns, r.seq, bytes(r.data)) for r in df.select("key", "ts_ns", "seq", "data").collect()], rules)
    got = catalogue.QUERIES["find_signal_whole"](spark, sf).collect()
    assert {(r.key, r.start, r["size"], r.order, round(r.score, 9)) for r in got} == want and len(got) == len(want)


def test_load_counts_frames_only(spark):
    rows = [(0, 0, 1, 0, bytearray(8)), (1, 10**9, 1, schema.REMOTE, bytearray()), (2, 2 * 10**9, 1, schema.ERROR, bytearray())]
    got = [r.load for r in stats.bus_load(log(spark, rows), 0, 2 * 10**9, 2, 1000).orderBy("bucket").collect()]
    assert got == [(47 + 64) / 1000, 47 / 1000]


def test_suggestions_name_what_the_bytes_are(spark):
    rng = random.Random(8)
    rows = []
    level = 30000
    for i in range(600):
        level += rng.randint(-40, 40)
        data = [i % 256, level % 256, level // 256, 3 if (i // 60) % 2 else 12, rng.randrange(256), (i // 200) & 1, 0]
        rows.append((i, i * 10, 9, 0, bytearray([*data, sum(data) % 256])))
    got = {(r.start, r["size"]): (r.kind, r.level) for r in suggest.suggest(log(spark, rows)).collect()}
    assert got[0, 8] == ("counter", "high") and got[56, 8] == ("checksum", "high")
    assert got[8, 16][0] in ("continuous", "signed") and (24, 4) in got and got[24, 4][0] == "enum"
    assert not any(start in range(32, 40) for start, _ in got)


def test_suggestions_reach_all_bytes_of_long_payloads(spark):
    rng = random.Random(9)
    level, rows = 30000, []
    for i in range(600):
        level += rng.randint(-40, 40)
        data = bytearray(rng.randrange(256) for _ in range(20))
        data[9], data[12], data[13], data[15], data[17] = i % 256, level // 256, level % 256, 3 if (i // 60) % 2 else 12, (i // 200) & 1
        data += bytes((i * (b + 1) * 2 + i) % 256 for b in range(20))
        rows.append((i, i * 10, 9, 0, data))
    got = {(r.start, r["size"], r.order): r.kind for r in suggest.suggest(log(spark, rows)).collect()}
    assert got[72, 8, "little"] == "counter" and got[120, 4, "little"] == "enum" and got[103, 16, "big"] in ("continuous", "signed")
    assert any(136 <= start < 144 for start, *_ in got) and len(got) > suggest.MOST and max(start for start, *_ in got) >= 8 * 36


def test_suggestions_of_narrow_fields_floats_and_crcs(spark):
    rng = random.Random(3)
    table, speed, rows, blink = suggest.crc8(0x1D), 60.0, [], 0
    for i in range(900):
        speed = abs(speed + rng.uniform(-0.2, 0.25))
        blink = (i // 9) % 2
        level = int(600 + 500 * math.sin(i / 40))
        data = bytearray([i % 16 | (level & 15) << 4, level >> 4 & 255, blink | (32 if 430 <= i < 610 else 0), *struct.pack("<f", speed)])
        crc = 0xFF
        for b in data:
            crc = int(table[crc ^ b])
        rows.append((i, i * 10**8, 9, 0, data + bytes([crc ^ 0xFF])))
    frames = log(spark, rows)
    found = {(r.start, r["size"], r.order): r for r in suggest.suggest(frames).collect()}
    kinds = {k: r.kind for k, r in found.items()}
    assert kinds[0, 4, "little"] == "counter" and kinds[56, 8, "little"] == "checksum" and found[56, 8, "little"].score == 0.97
    assert kinds[24, 32, "little"] == "float"
    assert any(k == "continuous" and start == 4 and size in (11, 12) for (start, size, _), k in kinds.items())
    assert kinds[16, 1, "little"] == "flag" and kinds[21, 1, "little"] == "flag" and found[16, 1, "little"].score == 0.5
    known = spark.createDataFrame([(9, 58), (9, 2)], "key long, bit int")
    left = {(r.start, r["size"]) for r in suggest.unknown_only(suggest.suggest(frames), known).collect()}
    assert (56, 8) not in left and (0, 4) not in left and (24, 32) in left


def test_checksum_rules_and_markers(spark):
    rng = random.Random(4)
    rows = []
    for i in range(500):
        body = [rng.randrange(256) for _ in range(5)]
        folded = 0
        for b in body:
            folded ^= b
        rows += [(3 * i, i * 10**8, 1, 0, bytearray([*body, (sum(body) + 7) % 256])), (3 * i + 1, i * 10**8, 2, 0, bytearray([folded ^ 0x33, *body])), (3 * i + 2, i * 10**8, 3, 0, bytearray([3 if 200 <= i < 210 else 5, 0]))]
    frames = log(spark, rows)
    found = {(r.key, r.byte): (r.rule, r.share) for r in suggest.checksums(frames, spark.createDataFrame([(1, 5), (2, 0)], "key long, byte int")).collect()}
    assert found == {(1, 5): ("sum", 1.0), (2, 0): ("XOR", 1.0)}
    plain = {(r.key, r.start, r["size"]): r.score for r in suggest.scored(frames.where("key = 3")).collect()}
    near = {(r.key, r.start, r["size"]): r.score for r in suggest.scored(frames.where("key = 3"), [200 * 10**8]).collect()}
    raised = {k for k in near if near[k] > plain[k] + 0.1}
    assert raised and all(k[0] == 3 for k in raised)


def test_ranges_follow_change_rates():
    import numpy as np

    rates = np.zeros(64)
    rates[0:4], rates[4:12] = [1, 0.5, 0.25, 0.12], [0.9, 0.5, 0.3, 0.2, 0.1, 0.05, 0.03, 0.02]
    found = suggest.ranges_of(rates)
    assert (0, 4, "little") in found and (4, 8, "little") in found and (0, 12, "little") in found
    big = np.zeros(16)
    big[8:16], big[0:3] = [0.9, 0.45, 0.22, 0.11, 0.06, 0.03, 0.02, 0.01], [0.006, 0.003, 0.002]
    assert (2, 11, "big") in suggest.ranges_of(big) and (7, 16, "big") in suggest.ranges_of(big)
