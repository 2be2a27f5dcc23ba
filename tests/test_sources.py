import os

import pytest
from pyspark.sql import functions as F

from canlake import schema
from canlake.operators import transport
from canlake.sources import asc, binary_writers, csv_log, logs, text, trc, writers
from canlake.streaming import live


def lines(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "seq long, line string")


def test_candump_lines(spark):
    rows = ["(1.5) can0 123#0102", "(-2.000001) can1 00000123#R5", "(3.123456789999) vcan0 7FF##3AA.BB T", "(4.0) can0 20000004#00", "", "(5.0) can0 800#00", "(6.0) can0 123#010203040506070809", "junk"]
    got = {r.seq: r for r in text.candump(lines(spark, rows)).collect()}
    assert [s for s, r in got.items() if r.rejected] == [5, 6, 7] and 4 not in got
    assert (got[0].ts_ns, got[0].id, bytes(got[0].data)) == (1_500_000_000, 0x123, b"\x01\x02")
    assert (got[1].ts_ns, got[1].id, got[1].kind, got[1].remote_dlc, got[1].len) == (-2_000_001_000, schema.EXTENDED_ID | 0x123, "remote", 5, 0)
    assert (got[2].ts_ns, got[2].flags, bytes(got[2].data)) == (3_123_456_789, schema.FD | schema.BRS | schema.ESI | schema.TX, b"\xaa\xbb")
    assert got[3].kind == "error" and got[3].id == schema.ERROR_ID


def test_asc_lines(spark):
    rows = ["date Mon", "base hex  timestamps absolute", "   0.000100 1  123             Rx   d 2 01 02  Length = 0", "   0.2 2  18FEF100x       Tx   r 8", "0.3 1  ErrorFrame", "// note"]
    got = {r.seq: r for r in asc.asc(lines(spark, rows), 10).collect()}
    assert set(got) == {2, 3, 4}
    assert (got[2].ts_ns, got[2].bus, bytes(got[2].data)) == (100_010, "can1", b"\x01\x02")
    assert (got[3].id, got[3].flags, got[3].remote_dlc) == (schema.EXTENDED_ID | 0x18FEF100, schema.REMOTE | schema.TX, 8)
    assert got[4].kind == "error"


def test_files_keep_their_order(spark, tmp_path):
    path = f"{tmp_path}/log.txt"
    want = [f"({i}.0) can0 123#{i % 256:02X}" for i in range(5000)]
    with open(path, "w") as f:
        f.write("\n".join(want) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    got = text.read_lines(spark, path).orderBy("seq").collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.line for r in got] == want and [r.seq for r in got] == list(range(5000))


def sample(spark, buses):
    """Frames of every kind on two buses."""
    t = 1_759_190_400_250_000_000
    rows = [(0, buses[0], 0x123, 0, None, bytes(range(8))), (1000, buses[1], schema.EXTENDED_ID | 0x18FEF100, schema.TX, None, b"\1"), (2000, buses[0], 0x7FF, schema.REMOTE, 4, b""),
            (3000, buses[1], schema.ERROR_ID, schema.ERROR, None, b""), (3_600_000_000_000, buses[0], 0x1A, schema.FD | schema.BRS, None, bytes(range(12))), (3_600_000_001_000, buses[0], 0x1B, schema.FD | schema.ESI | schema.TX, None, bytes(64)),
            (3_600_000_002_000, buses[1], schema.EXTENDED_ID | 1, schema.FD | schema.BRS | schema.ESI, None, b"\7" * 7), (3_600_000_003_000, buses[1], 2, schema.REMOTE, 9, b""), (3_600_000_004_000, buses[1], 3, 0, None, b"")]
    df = spark.createDataFrame([(i, t + dt, bus, id_, flags, dlc, bytearray(data)) for i, (dt, bus, id_, flags, dlc, data) in enumerate(rows)], "seq long, ts_ns long, bus string, id long, flags int, remote_dlc int, data binary")
    extra = df.where("seq = 0").withColumn("flags", F.lit(schema.REASSEMBLED)).withColumn("seq", F.lit(99).cast("long"))
    return df, df.union(extra)


def plain(frames):
    return [(r.ts_ns, r.bus, r.id, r.flags, r.remote_dlc, bytes(r.data)) for r in frames.orderBy("ts_ns", "seq").collect()]


def test_logs_round_trip_in_every_format(spark, tmp_path):
    for k, (buses, numbered) in enumerate(((("can0", "vcan1"), ("can1", "can2")), (("can3", "can1"), ("can3", "can1")))):
        want, frames = sample(spark, buses)
        for format in ("candump", "csv", "asc", "trc"):
            for parts in (None, 1):
                path = f"{tmp_path}/{format}{k}{parts}"
                writers.write_log(frames, path, format, parts)
                assert logs.detect(spark, path) == format
                back, names = logs.read_log(spark, path), buses if format in ("candump", "csv") else numbered
                assert plain(back) == plain(want.replace(dict(zip(buses, names)), subset="bus")), format
        for format in ("blf", "mf4"):
            path = f"{tmp_path}/{format}{k}"
            names = binary_writers.write_binary(frames, path, format, 1)
            assert names == [f"part-00000.{format}"] and logs.detect(spark, f"{path}/{names[0]}") == format
            assert plain(logs.read_log(spark, path, format)) == plain(want.replace(dict(zip(buses, numbered)), subset="bus")), format
    binary_writers.write_binary(frames.repartition(3), f"{tmp_path}/many", "mf4")
    assert plain(logs.read_log(spark, f"{tmp_path}/many/*.mf4")) == plain(want)


@pytest.mark.parametrize("format", ["blf", "mf4"])
def test_files_have_one_order(spark, tmp_path, format):
    rows = [(i, 1_700_000_000_000_000_000 + 1000 * (i // 4), f"can{i % 2 + 1}", 256 + i % 3, 0, None, bytearray([i % 256])) for i in range(60)]
    frames = spark.createDataFrame(rows, "seq long, ts_ns long, bus string, id long, flags int, remote_dlc int, data binary")
    for part in range(3):  # equal times in all files
        binary_writers.write_binary(frames.where(f"seq % 3 = {part}"), f"{tmp_path}/{part}", format, 1)
        os.rename(f"{tmp_path}/{part}/part-00000.{format}", f"{tmp_path}/{'cab'[part]}.{format}")
    want = sorted((1000 * (i // 4), "cab"[i % 3], i) for i in range(60))
    for _ in range(2):
        read = logs.read_log(spark, f"{tmp_path}/*.{format}", format)
        got = read.orderBy("ts_ns", "seq").collect()
        assert len({r.seq for r in got}) == 60 and [bytes(r.data)[0] for r in got] == [i for *_, i in want]
        first = min(want)[2]
        assert next(r.channel for r in got if bytes(r.data)[0] == first) == 0


def test_what_formats_cannot_hold(spark):
    frames = spark.range(300).selectExpr("id as seq", "id as ts_ns", "concat('x', id) as bus", "1L as id", "0 as flags", "cast(null as int) as remote_dlc", "unhex('00') as data")
    for write in (writers.asc, writers.trc):
        with pytest.raises(ValueError, match="buses"):
            write(frames)
    assert writers.candump(frames).lines.count() == 300
    with pytest.raises(ValueError, match="1900"):
        writers.start_ns(frames.withColumn("ts_ns", F.lit(writers.EARLIEST_NS - 1)))


def packets(spark, rows):
    df = spark.createDataFrame([(i, ts, schema.EXTENDED_ID | id_, bytearray(d)) for i, (ts, id_, d) in enumerate(rows)], "seq long, ts_ns long, id long, data binary")
    return df.withColumn("channel", F.lit(0)).withColumn("kind", F.lit("data"))


MS = 1_000_000
BAM = (0, 0x18ECFF10, [32, 10, 0, 2, 255, 0xF1, 0xFE, 0])


def one(n, ts, id_=0x18EBFF10):
    return (ts, id_, [n, *range(10 * n, 10 * n + 7)])


def test_broadcast_transfer(spark):
    got = transport.reassemble(packets(spark, [BAM, one(1, 50 * MS), one(2, 100 * MS)])).collect()
    assert [(r.ts_ns, r.id, bytes(r.data)) for r in got] == [(100 * MS, schema.EXTENDED_ID | 0x18FEF110, bytes([*range(10, 17), 20, 21, 22]))]
    for bad in ([BAM, one(1, 50 * MS), one(2, 900 * MS)], [BAM, one(2, 50 * MS), one(1, 60 * MS), one(2, 70 * MS)], [BAM, one(1, 50 * MS), (60 * MS, 0x18ECFF10, [255, 1, 255, 255, 255, 0xF1, 0xFE, 0]), one(2, 70 * MS)]):
        assert transport.reassemble(packets(spark, bad)).count() == 0


def rts(ts, sender, to, size, group=(0, 0xEF, 0)):
    return (ts, 0x18EC0000 | to << 8 | sender, [16, size, 0, 2, 255, *group])


def dt(ts, sender, to, n, value):
    return (ts, 0x18EB0000 | to << 8 | sender, [n, *[value] * 7])


def made(spark, rows):
    return [(r.ts_ns, r.id, bytes(r.data)) for r in transport.reassemble(packets(spark, rows)).orderBy("ts_ns").collect()]


def bam(ts, sender, size, group=(0xCA, 0xFE, 0)):
    return (ts, 0x18ECFF00 | sender, [32, size & 255, size >> 8, -(-size // 7) & 255, 255, *group])


def test_transfers_of_every_size_and_group(spark):
    E = schema.EXTENDED_ID
    assert made(spark, [bam(1, 0, 3), dt(2, 0, 255, 1, 5)]) == [(2, E | 0x18FECA00, b"\5" * 3)]  # below nine bytes
    assert made(spark, [(1, 0x18ECFF00, [32, 10, 0, 9, 255, 0xCA, 0xFE, 0]), dt(2, 0, 255, 1, 1), dt(3, 0, 255, 2, 2)]) == [(3, E | 0x18FECA00, b"\1" * 7 + b"\2" * 3)]  # the announced number of packets isn't used
    largest = made(spark, [bam(5, 0, 1785)] + [dt(5 + i, 0, 255, i, i) for i in range(1, 256)])
    assert len(largest) == 1 and len(largest[0][2]) == 1785 and largest[0][2][-1] == 255
    assert made(spark, [bam(1, 0, 0), dt(2, 0, 255, 1, 1), bam(3, 1, 1786), dt(4, 1, 255, 1, 1), (5, 0x18ECFF02, [32, 8, 0])]) == []
    low = [(1, 0x1CEC1703, [16, 9, 0, 2, 255, 0x55, 0xEF, 0]), dt(3, 3, 0x17, 1, 1), dt(4, 3, 0x17, 2, 2)]
    assert [i for _, i, _ in made(spark, low)] == [E | 0x1CEF1703]  # the destination stands for a low byte of the group
    paged = [(1, 0x19ECFF00, [32, 7, 0, 1, 255, 0xCA, 0xFE, 0]), dt(2, 0, 255, 1, 1)]
    assert made(spark, paged) == []  # another data page is another group


def test_what_drops_a_transfer(spark):
    E, T1, T3 = schema.EXTENDED_ID, 750 * MS, 1250 * MS
    again = [bam(4, 0, 14), dt(5, 0, 255, 1, 1), bam(6, 0, 14), dt(7, 0, 255, 1, 2), dt(8, 0, 255, 2, 3)]
    assert made(spark, again) == [(8, E | 0x18FECA00, b"\2" * 7 + b"\3" * 7)]
    other_way = [rts(0, 3, 0x17, 14), rts(1, 0x17, 3, 14, (0, 0xEA, 0)), (2, 0x18EC0317, [255, 1, 255, 255, 255, 0, 0xEF, 0]), dt(3, 3, 0x17, 1, 1), dt(4, 0x17, 3, 1, 1), dt(5, 0x17, 3, 2, 2), dt(6, 3, 0x17, 2, 1)]
    assert made(spark, other_way) == [(5, E | 0x18EA0317, b"\1" * 7 + b"\2" * 7)]
    short = [bam(0, 0, 14), (1, 0x18EBFF00, [1, 1, 1]), dt(2, 0, 255, 1, 1), dt(3, 0, 255, 2, 1), rts(10, 3, 0x17, 14), (11, 0x18EB1703, [1, 9, 9]), dt(12, 3, 0x17, 1, 1), dt(13, 3, 0x17, 2, 2)]
    assert made(spark, short) == [(13, E | 0x18EF1703, b"\1" * 7 + b"\2" * 7)]
    assert len(made(spark, [bam(0, 0, 21), dt(50 * MS, 0, 255, 1, 1), dt(250 * MS, 0, 255, 2, 2), dt(250 * MS + T1, 0, 255, 3, 3)])) == 1
    assert made(spark, [bam(0, 0, 14), dt(100 * MS, 0, 255, 1, 1), dt(100 * MS + T1 + 1, 0, 255, 2, 2)]) == []
    assert made(spark, [rts(0, 3, 0x17, 7), dt(T3 + 1, 3, 0x17, 1, 1)]) == [] and len(made(spark, [rts(0, 3, 0x17, 7), dt(T3, 3, 0x17, 1, 1)])) == 1
    cts = lambda ts, n, first: (ts, 0x18EC0317, [17, n, first, 255, 255, 0, 0xEF, 0])
    assert made(spark, [rts(0, 3, 0x17, 14), cts(1, 2, 3), dt(2, 3, 0x17, 1, 1), dt(3, 3, 0x17, 2, 1)]) == []  # asks for a packet after the next
    block = [rts(0, 3, 0x17, 14), cts(1, 2, 1), dt(2, 3, 0x17, 1, 1), dt(2 + T1 + 1, 3, 0x17, 2, 1)]
    assert made(spark, block) == [] and len(made(spark, [block[0], cts(1, 1, 1), *block[2:]])) == 1  # within a block the limit is shorter


def test_addressed_transfer_rewinds_and_holds(spark):
    rts, cts = (0, 0x1CEC2010, [16, 10, 0, 2, 255, 0, 0xEF, 0]), lambda ts, n, first: (ts, 0x1CEC1020, [17, n, first, 255, 255, 0, 0xEF, 0])
    data = 0x1CEB2010
    rows = [rts, cts(10 * MS, 2, 1), one(1, 20 * MS, data), one(2, 30 * MS, 0x1CEB2011), cts(40 * MS, 0, 255), cts(1000 * MS, 2, 1), one(1, 1010 * MS, data), one(2, 1020 * MS, data)]
    got = transport.reassemble(packets(spark, rows)).collect()
    assert [(r.ts_ns, r.id, r.len) for r in got] == [(1020 * MS, schema.EXTENDED_ID | 0x1CEF2010, 10)]


def test_stream(spark, tmp_path):
    frames = spark.range(200).selectExpr("id as seq", "id * 100000000 as ts_ns", "0 as channel", "1L as id", "1L as key", "0 as flags", "'data' as kind", "1 as len", "cast(null as int) as remote_dlc", "unhex(lpad(hex(id div 10), 2, '0')) as data")
    for i, part in enumerate(frames.randomSplit([1.0] * 4, 3)):
        part.orderBy("seq").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = live.capture(spark, f"{tmp_path}/in/*")
    live.record(stream, f"{tmp_path}/log", f"{tmp_path}/c1").awaitTermination(120)
    log = spark.read.parquet(f"{tmp_path}/log")
    assert log.count() == 200 and live.recent(log, 1_000_000_000).count() == 11
    query = live.frame_rate(live.capture(spark, f"{tmp_path}/in/*")).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("rates").agg(F.max("rate")).first()[0] == 10.0
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    query = live.changes(live.capture(spark, f"{tmp_path}/log/day=1970-01-01")).writeStream.format("memory").queryName("changed").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c2").start()
    query.awaitTermination(120)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert spark.table("changed").count() == 19


def lobj(kind, body, time=None):
    import struct

    head = struct.pack("<IHHQ", 2, 0, 0, time) if time is not None else b""
    size = 16 + len(head) + len(body)
    return struct.pack("<4sHHII", b"LOBJ", 16 + len(head), 1, size, kind) + head + body


def test_blf_file(spark, tmp_path):
    import struct
    import zlib

    from canlake.sources.blf import read_blf

    inner = lobj(1, struct.pack("<HBBI8s", 1, 1, 3, 0x123, b"\1\2\3"), 5) + lobj(99, b"skip", 6)
    inner += lobj(86, struct.pack("<HBBI8s8x", 2, 0x80, 4, 0x80000123, b""), 1_000)
    inner += lobj(100, struct.pack("<HBBIIBBB5x64s", 1, 0, 9, 0x7, 0, 0, 3, 12, bytes(range(64))), 2_000)
    inner += lobj(73, struct.pack("<HHIBBBxIIH2x8s", 1, 0, 0, 0, 0, 2, 0, 0, 0, b"\x0a\x0b"), 3_000)
    start = struct.pack("<8H", 2024, 1, 0, 1, 0, 0, 0, 250)
    header = struct.pack("<4sI", b"LOGG", 144).ljust(40, b"\0") + start
    content = header.ljust(144, b"\0")
    for part in (inner[:70], inner[70:]):  # an object runs on into the second container
        packed = zlib.compress(part)
        box = lobj(10, struct.pack("<H6xI4x", 2, len(part)) + packed)
        content += box + b"\0" * (len(box) % 4)
    (tmp_path / "a.blf").write_bytes(content)
    (tmp_path / "b.blf").write_bytes(b"nothing of the kind")
    got = read_blf(spark, str(tmp_path / "*.blf")).orderBy("seq").collect()
    base = 1704067200_250_000_000
    assert [(r.ts_ns - base, r.bus, r.id, r.flags, r.remote_dlc, bytes(r.data)) for r in got] == [
        (5, "can1", 0x123, schema.TX, None, b"\1\2\3"),
        (1_000, "can2", schema.EXTENDED_ID | 0x123, schema.REMOTE, 4, b""),
        (2_000, "can1", 7, schema.FD | schema.BRS, None, bytes(range(12))),
        (3_000, "can1", schema.ERROR_ID, schema.ERROR, None, b"\x0a\x0b"),
    ]


def test_relative_asc_times_add_up(spark, tmp_path):
    rows = ["base hex  timestamps relative", "Begin Triggerblock", " 0.5 1 1 Rx d 0", " 0.25 Statistic: x", " 0.25 1 2 Rx d 0", "End TriggerBlock", "Begin Triggerblock", " 0.125 1 3 Rx d 0"]
    (tmp_path / "r.asc").write_text("\n".join(rows))
    got = logs.read_log(spark, f"{tmp_path}/r.asc").orderBy("seq").collect()
    assert [(r.id, r.ts_ns) for r in got] == [(1, 500_000_000), (2, 1_000_000_000), (3, 125_000_000)]
    (tmp_path / "c.dat").write_text("(1.0) can0 1FF#00\n")
    assert logs.detect(spark, f"{tmp_path}/c.dat") == "candump" and logs.read_log(spark, f"{tmp_path}/c.dat").count() == 1


NOON = 1_759_233_600_000_000_000  # 45930.5 days since 1899-12-30
EXT = schema.EXTENDED_ID


def parsed(spark, parse, content):
    return [r for r in parse(lines(spark, content.split("\n"))).orderBy("seq").collect()]


def test_asc_header_and_base(spark):
    content = "date Tue Sep 30 12:00:00.500 pm 2025\nbase dec  timestamps absolute\n1.5 1 256 Rx d 2 16 255\n1.6 1 2048 TxRq r 15\n1.7 1 18x Rx d 1 9\n1.8 1 256 Rx d 1 256\n1.9 1 99 Rx d 2 1\n2.0 1 Statistic: D 1\nx\n2.1z 1 2 Rx d 0\n2.2 1 22222222222 Rx d 0"
    got = parsed(spark, asc.asc, content)
    assert [(r.id, r.flags, bytes(r.data), r.remote_dlc) for r in got if not r.rejected] == [(256, 0, b"\x10\xff", None), (EXT | 2048, schema.REMOTE | schema.TX, b"", 15), (EXT | 18, 0, b"\t", None)]
    assert [(r.seq, r.reason) for r in got if r.rejected] == [(5, "bad data byte"), (6, "too few data bytes"), (9, "bad timestamp"), (10, "bad CAN ID")]
    assert got[0].ts_ns == NOON + 2_000_000_000
    relative = "date Di Okt 1 01:00:00 2024\nbase hex timestamps relative\nBegin Triggerblock\n 1.0 1 1 Rx d 0\n 0.5 Status\n 0.25 1 1 Rx d 0\nBegin Triggerblock\n 0.25 1 1 Rx d 0"
    got = parsed(spark, asc.asc, relative)
    start = 1727744400_000_000_000
    assert [r.ts_ns - start for r in got] == [1_000_000_000, 1_750_000_000, 250_000_000]


def test_trc_versions(spark):
    v11 = ";$FILEVERSION=1.1\n;$STARTTIME=45930.5\n 1) 1059.9 Rx 0001 8 00 11 22 33 44 55 66 77\n 2) 1298.9 Tx 18FEF100 4 01 02 03 04\n 3) 1300.0 Rx 0003 4 RTR\n 4) 1301.0 Warng 0004 1 00\n 5) 1302.0 Rx FFFFFFFF 4 00 00 00 04"
    got = parsed(spark, trc.trc, v11)
    assert [(r.ts_ns - NOON, r.id, r.flags, r.remote_dlc, len(r.data), r.rejected) for r in got] == [(1_059_900_000, 1, 0, None, 8, False), (1_298_900_000, EXT | 0x18FEF100, schema.TX, None, 4, False), (1_300_000_000, 3, schema.REMOTE, 4, 0, False)]
    v13 = ";$FILEVERSION=1.3\n;$STARTTIME=45930.5\n 1) 1059.9 2 Rx 0001 - 8 00 11 22 33 44 55 66 77\n 2) 1060.9 1 Tx 0002 - 2 AA BB"
    assert [(r.bus, r.id, r.flags, len(r.data), r.rejected) for r in parsed(spark, trc.trc, v13)] == [("can2", 1, 0, 8, False), ("can1", 2, schema.TX, 2, False)]
    v12 = ";$FILEVERSION=1.2\n;$STARTTIME=45930.5\n 1) 1059.9 2 Rx 0001 2 00 11"
    assert [(r.bus, len(r.data)) for r in parsed(spark, trc.trc, v12)] == [("can2", 2)]
    v10 = ";####\n; trace\n 1) 1059 0001 2 00 11\n 2) 1283 FFFFFFFF 4 00 00 00 04\n 3) 1290 0002 2 RTR\n 1 2 3"
    assert [(r.ts_ns, r.bus, r.id, r.remote_dlc, r.rejected) for r in parsed(spark, trc.trc, v10)][:2] == [(1_059_000_000, "can1", 1, None, False), (1_290_000_000, "can1", 2, 2, False)]
    assert parsed(spark, trc.trc, v10)[2].rejected
    v2 = ";$FILEVERSION=2.1\n;$STARTTIME=45930.50000001157407407407\n;$COLUMNS=N,O,T,B,I,d,R,l,D\n1 1.0 FE 1 0001 Rx - 2 AA BB\n2 1.0 BI 2 0002 Tx - 12 " + "00 " * 12 + "\n3 2.0 ST 1 - Rx - 4 00 00 00 00\n4 4 ER 1 - Rx - 5 01 02 03 04 05"
    got = parsed(spark, trc.trc, v2)
    assert [(r.ts_ns - NOON, r.flags, len(r.data), r.rejected) for r in got] == [(2_000_000, schema.FD | schema.ESI, 2, False), (2_000_000, schema.FD | schema.BRS | schema.ESI | schema.TX, 12, False), (5_000_000, schema.ERROR, 5, False)]
    bad = ";$FILEVERSION=2.1\n;$STARTTIME=45930.5\n;$COLUMNS=N,O,T,B,I,d,R,L,D\n1 x DT 1 0001 Rx - 1 00\n2 1.0 DT 1 000G Rx - 1 00\n3 1.0 DT 1 0001 Rx - 16 00\n4 1.0 DT 1 0001 Rx - 2 00\n5 1.0 DT 1 0001 Rx - 1 0G\n6 1.0 DT 1 0001 Rx\n7 1.0 DT x 0001 Rx - 1 00\n8 1.0 DT 1 0001 Xx - 1 00\n9 1.0 DT 1 20000000 Rx - 1 00\n10 1.0 DT 1 0001 Rx - 1 00"
    frames = trc.trc(lines(spark, bad.split("\n")))
    stats = logs.parse_stats(frames).first()
    assert (stats.frames, stats.rejected, stats.first_rejected, stats.reason) == (1, 9, 3, "bad time offset")
    for head in (";$FILEVERSION=2.1\n", ";$FILEVERSION=2.1\n;$COLUMNS=N,O,T,D,I\n"):
        assert [r.rejected for r in parsed(spark, trc.trc, head + "1 1.0 DT 1 0001 Rx - 1 00")] == [True]


def test_csv_layouts(spark):
    python_can = "timestamp,arbitration_id,extended,remote,error,dlc,data\n1483389946.197,0xdadada,1,0,0,4,ABCD/w==\n1483389946.2,0x123,0,0,0,8,AAECAwQFBgc=\n1483389946.3,0x123,0,1,0,4,\n1483389946.4,0x20000080,0,0,1,8,AAAAAAAAAAA=\n1e-05,0x7ff,0,0,0,2,1122\n1483389946.5,0x300,0,0,0,12,000102030405060708090a0b"
    got = parsed(spark, csv_log.csv, python_can)
    assert [(r.ts_ns, r.bus, r.id, r.flags, bytes(r.data), r.rejected) for r in got] == [
        (1_483_389_946_197_000_000, "can1", EXT | 0xDADADA, 0, bytes([0, 0x10, 0x83, 0xFF]), False), (1_483_389_946_200_000_000, "can1", 0x123, 0, bytes(range(8)), False),
        (1_483_389_946_300_000_000, "can1", 0x123, schema.REMOTE, b"", False), (1_483_389_946_400_000_000, "can1", schema.ERROR_ID | 0x80, schema.ERROR, bytes(8), False),
        (10_000, "can1", 0x7FF, 0, b"\x11\x22", False), (1_483_389_946_500_000_000, "can1", 0x300, schema.FD, bytes(range(12)), False)]
    assert got[2].remote_dlc == 4
    savvy = "Time Stamp,ID,Extended,Dir,Bus,LEN,D1,D2,D3,D4,D5,D6,D7,D8\r\n1000000,000000F1,false,Rx,0,8,00,11,22,33,44,55,66,77\r\n1000500,18FEF100,true,Tx,1,3,AA,BB,CC,,,,,\r\n1001000,00000100,false,Rx,0,2,01,02"
    got = parsed(spark, csv_log.csv, savvy)
    assert [(r.ts_ns, r.bus, r.id, r.flags, bytes(r.data)) for r in got] == [(1_000_000_000, "can0", 0xF1, 0, bytes(range(0, 0x78, 0x11))), (1_000_500_000, "can1", EXT | 0x18FEF100, schema.TX, b"\xaa\xbb\xcc"), (1_001_000_000, "can0", 0x100, 0, b"\1\2")]
    generic = '"Time (ms)";"CAN ID";"Channel";"Length";"Data";"FD";"BRS"\n12.5;0x123;vcan0;3;01 02 03;0;0\n13;7FF;vcan0;2;0x01:0x02;no;no\n14;18FEF100;can3;12;00-01-02-03-04-05-06-07-08-09-0a-0b;yes;yes'
    got = parsed(spark, csv_log.csv, generic)
    assert [(r.ts_ns, r.bus, r.id, r.flags, bytes(r.data)) for r in got] == [(12_500_000, "vcan0", 0x123, 0, b"\1\2\3"), (13_000_000, "vcan0", 0x7FF, 0, b"\1\2"), (14_000_000, "can3", EXT | 0x18FEF100, schema.FD | schema.BRS, bytes(range(12)))]
    single = "# note\nsep=\ttab\ntime_us\tid\tbyte0\tbyte1\n7\t1\tff\t\n-3\t2\t00\t01\n5\tzz\t00\t01"
    got = parsed(spark, csv_log.csv, single)
    assert [(r.ts_ns, r.id, bytes(r.data)) for r in got if not r.rejected] == [(7_000, 1, b"\xff"), (-3_000, 2, b"\0\1")] and got[2].reason == "bad CAN ID"
    for rows, want in (("t,id,data\n0,1,00\n1483389946197,1,00", 1_483_389_946_197_000_000), ("t,id,data\n0,1,00\n1483389946197000000,1,00", 1_483_389_946_197_000_000), ("t,id,data\n0,1,00\n1483389946,1,00", 1_483_389_946_000)):
        assert [r.ts_ns for r in parsed(spark, csv_log.csv, rows)] == [0, want]
    assert [r.rejected for r in parsed(spark, csv_log.csv, "a,b\n1,2")] == [True, True]


def test_strict_ids_and_times(spark):
    assert parsed(spark, csv_log.csv, "time_ns,id,data\n1," + "1" * 20 + ",00")[0].rejected
    assert parsed(spark, text.candump, "(99999999999999999999.5) can0 123#00")[0].reason == "bad timestamp"
    assert parsed(spark, asc.asc, "1.0 1 " + "1" * 22 + " Rx d 0")[0].rejected


def test_read_log_feeds_the_operators(spark, tmp_path):
    from canlake.operators import stats

    (tmp_path / "a.log").write_text("(1.0) vcan9 123#01\n(2.0) can0 123#02\nbad\n(3.0) vcan9 124#03\n")
    (tmp_path / "b.log").write_text("(0.5) can0 125#01\n")
    got = logs.read_log(spark, f"{tmp_path}/*.log")
    assert [(r.seq, r.bus, r.channel, r.key) for r in got.orderBy("seq").collect()] == [(0, "vcan9", 0, 0x123), (1, "can0", 1, 2**32 + 0x123), (3, "vcan9", 0, 0x124), (4, "can0", 1, 2**32 + 0x125)]
    assert stats.id_summary(got).count() == 4


def test_asc_fd_lines(spark):
    rows = ["0.1 CANFD 1 Rx 123 1 0 9 12 " + " ".join(f"{i:02x}" for i in range(12)) + " 130000 130 3000 0 0 0 0 0", "0.2 CANFD 2 Tx 18FEF100x Name 0 0 2 2 AA BB 1 1 0 0", "0.3 CANFD 1 Rx 124 0 0 8 0 1 1 10 0"]
    got = {r.seq: r for r in asc.asc(lines(spark, rows)).collect()}
    assert (got[0].id, got[0].flags, bytes(got[0].data)) == (0x123, schema.FD | schema.BRS, bytes(range(12)))
    assert (got[1].id, got[1].flags, bytes(got[1].data), got[1].rejected) == (schema.EXTENDED_ID | 0x18FEF100, schema.TX, b"\xaa\xbb", False)
    assert (got[2].kind, got[2].remote_dlc, got[2].len) == ("remote", 8, 0)
