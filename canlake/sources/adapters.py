"""Frames as capture adapters give them: slcan lines, gs_usb host frames and packed records of a capture."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canlake import schema
from canlake.functions import frames as ff
from canlake.sources.text import error_id, frames_of, hex_number, with_file

# First letters of slcan lines by what they stand for, and of host frames the mark of a received one,
# flags of its ID and of the frame, and the bytes before and of its payload.
EXTENDED, REMOTE, FLEXIBLE, SWITCHED = "TRDB", "rR", "dDbB", "bB"
RECEIVED, RTR, ERR, EFF = 0xFFFFFFFF, 1 << 30, 1 << 29, 1 << 31
OVERFLOW, HOST_FD, HOST_BRS, HOST_ESI = 1, 2, 4, 8
HEADER, CLASSIC_FIELD, FD_FIELD = 12, 8, 64
_RECORD = "<dIBB"


def _length(dlc: Column, fd: Column) -> Column:
    coded = F.element_at(F.array(*map(F.lit, schema.DLC_LENGTHS)), dlc.cast("int") + 1)
    return F.when(fd, coded).otherwise(F.least(dlc, F.lit(8)).cast("int"))


def slcan(lines: DataFrame, bus: str = "can1", start_ns: int = 0) -> DataFrame:
    """Frames of lines as an adapter sends them, and rejected ones; a time of four hex digits after the data is in ms."""
    rows = with_file(lines).withColumn("line", F.regexp_replace("line", r"[\r\n\x07]+$", "")).where(F.col("line") != "")
    kind = F.substring("line", 1, 1)
    wide, remote, fd = kind.isin(*EXTENDED), kind.isin(*REMOTE), kind.isin(*FLEXIBLE)
    digits = F.when(wide, 8).otherwise(3)
    raw, dlc = hex_number(F.substring("line", F.lit(2), digits)), hex_number(F.substring("line", digits + 2, F.lit(1)))
    length = F.when(remote, 0).otherwise(_length(F.coalesce(dlc, F.lit(0)), fd))
    body = F.substring("line", digits + 3, length * 2)
    extra = F.substring("line", digits + 3 + length * 2, F.length("line"))
    flags = F.when(fd, schema.FD).otherwise(0) + F.when(kind.isin(*SWITCHED), schema.BRS).otherwise(0) + F.when(remote, schema.REMOTE).otherwise(0)
    checks = [
        (kind.isin(*EXTENDED, *REMOTE, *FLEXIBLE, "t"), "not a frame"),
        (raw.isNotNull() & (F.length("line") > digits), "bad CAN ID"),
        (raw <= F.when(wide, 0x1FFFFFFF).otherwise(0x7FF), "CAN ID out of range"),
        (dlc.isNotNull(), "bad length"),
        (fd | (dlc <= 8), "classic CAN length over 8"),
        (F.length(body) == length * 2, "data cut short"),
        ((extra == "") | extra.rlike("^[0-9A-Fa-f]{4}$"), "unexpected characters after the data"),
        (body.rlike("^[0-9A-Fa-f]*$"), "bad hex data"),
    ]
    ts = F.coalesce(hex_number(extra), F.lit(0).cast("long")) * 1_000_000 + start_ns
    id_ = F.when(wide, raw.bitwiseOR(F.lit(schema.EXTENDED_ID).cast("long"))).otherwise(raw)
    return frames_of(rows, ts, F.lit(bus), id_, flags, F.when(body.rlike("^(?:[0-9A-Fa-f]{2})*$"), F.unhex(body)), dlc, checks)


def slcan_lines(frames: DataFrame) -> DataFrame:
    """(seq, line) of frames in the notation of slcan; error and reassembled frames have none."""
    has = lambda bit: F.col("flags").bitwiseAND(F.lit(bit)) != 0
    wide = F.col("id").bitwiseAND(F.lit(schema.EXTENDED_ID).cast("long")) != 0
    letter = F.when(has(schema.REMOTE), "r").when(has(schema.BRS), "b").when(has(schema.FD), "d").otherwise("t")
    name = F.lpad(F.hex(F.col("id").bitwiseAND(F.lit(0x1FFFFFFF).cast("long"))), F.when(wide, 8).otherwise(3), F.lit("0"))
    code = F.array_position(F.array(*map(F.lit, schema.DLC_LENGTHS)), F.length("data")) - 1
    dlc = F.hex(F.when(has(schema.REMOTE), F.coalesce("remote_dlc", F.lit(0)).cast("long")).otherwise(code))
    line = F.concat(F.when(wide, F.upper(letter)).otherwise(letter), name, dlc, F.hex("data"))
    return frames.where(~has(schema.ERROR) & ~has(schema.REASSEMBLED)).select("seq", line.alias("line"))


def _little(data: Column, first: int, size: int) -> Column:
    parts = [F.call_function("shiftleft", ff.byte(data, first + i).cast("long"), F.lit(8 * i)) for i in range(size)]
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out


def gs_usb(transfers: DataFrame, channel: int = 0, timestamps: bool = False) -> DataFrame:
    """Frames (seq, id, flags, kind, len, remote_dlc, data, overflow, device_us) of received transfers (seq, transfer binary).

    Echoes of sent frames, other channels' frames and short transfers give none; device_us is null without timestamps.
    """
    t = F.col("transfer")
    rows = transfers.where((F.length(t) >= HEADER) & (_little(t, 0, 4) == RECEIVED) & (ff.byte(t, 9) == channel))
    number, marks = _little(t, 4, 4), ff.byte(t, 10)
    has = lambda c, bit: c.bitwiseAND(F.lit(bit).cast("long") if bit > 255 else F.lit(bit)) != 0
    fd, error = has(marks, HOST_FD), has(number, ERR)
    remote = ~fd & has(number, RTR)
    wide = ~error & has(number, EFF)
    dlc = ff.byte(t, 8).bitwiseAND(F.lit(15))
    length = F.when(remote, 0).otherwise(_length(dlc, fd))
    bit = lambda on, value: F.when(on, value).otherwise(0)
    flags = bit(fd, schema.FD) + bit(fd & has(marks, HOST_BRS), schema.BRS) + bit(fd & has(marks, HOST_ESI), schema.ESI) + bit(remote, schema.REMOTE) + bit(error, schema.ERROR)
    low = number.bitwiseAND(F.lit(0x1FFFFFFF).cast("long"))
    id_ = F.when(error, low.bitwiseOR(error_id())).when(wide, low.bitwiseOR(F.lit(schema.EXTENDED_ID).cast("long"))).otherwise(number.bitwiseAND(F.lit(0x7FF).cast("long")))
    at = F.when(fd, HEADER + FD_FIELD).otherwise(HEADER + CLASSIC_FIELD)
    clock = [F.call_function("shiftleft", ff.byte(t, at + i).cast("long"), F.lit(8 * i)) for i in range(4)]
    us = F.when(F.length(t) >= at + 4, clock[0].bitwiseOR(clock[1]).bitwiseOR(clock[2]).bitwiseOR(clock[3])) if timestamps else F.lit(None).cast("long")
    found = rows.where(F.length(t) >= HEADER + length)
    return found.select("seq", id_.alias("id"), flags.alias("flags"), ff.kind(flags).alias("kind"), length.cast("int").alias("len"), F.when(remote, dlc).alias("remote_dlc"), F.substring(t, F.lit(HEADER + 1), length).alias("data"), has(marks, OVERFLOW).alias("overflow"), us.alias("device_us"))


def packed_records(batches: DataFrame, started_at_ns: int, channel: int = 0) -> DataFrame:
    """Frames of a capture's batches (batch long, packed binary): records one after another, with the time since its start.

    seq is batch * 2^20 and the record's number in its batch. A batch that is cut short, or holds a record that no frame can
    be, raises an error, as nothing tells where its next record begins.
    """
    names = ["seq", "ts_ns", "id", "flags", "dlc", "data"]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            out: list[tuple] = []
            for batch, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = n = 0
                while at < len(packed):
                    if at + struct.calcsize(_RECORD) > len(packed):
                        raise ValueError("a captured frame is cut short")
                    offset, id_, marks, size = struct.unpack_from(_RECORD, packed, at)
                    remote = marks & schema.REMOTE
                    if remote and size > 15 or size > 64:
                        raise ValueError("a captured frame is too long")
                    end = at + struct.calcsize(_RECORD) + (0 if remote else size)
                    if end > len(packed) or offset - offset != 0:
                        raise ValueError("a captured frame is cut short or has no time")
                    out.append(((batch << 20) + n, started_at_ns + round(offset), id_, marks & 63, size if remote else None, packed[at + struct.calcsize(_RECORD) : end]))
                    at, n = end, n + 1
            columns = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()])], names)

    read = batches.select("batch", "packed").mapInArrow(run, "seq long, ts_ns long, id long, flags int, dlc int, data binary")
    return read.select("seq", "ts_ns", F.lit(channel).alias("channel"), "id", ff.key(F.lit(channel), F.col("id")).alias("key"), "flags", ff.kind(F.col("flags")).alias("kind"), F.length("data").alias("len"), F.col("dlc").alias("remote_dlc"), "data")


def pack_records(frames: DataFrame, started_at_ns: int, per_batch: int = 5000) -> DataFrame:
    """(batch, packed): frames as a capture's batches, cut by seq."""
    remote = F.col("flags").bitwiseAND(F.lit(schema.REMOTE)) != 0
    size = F.when(remote, F.coalesce("remote_dlc", F.lit(0))).otherwise(F.length("data"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            packed = [b"".join(struct.pack(_RECORD, float(r["ts"]), r["id"], r["flags"], r["size"]) + r["data"] for r in items) for items in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], ["batch", "packed"])

    record = F.struct("seq", (F.col("ts_ns") - started_at_ns).alias("ts"), "id", "flags", size.alias("size"), "data")
    grouped = frames.groupBy(F.floor(F.col("seq") / per_batch).alias("batch")).agg(F.sort_array(F.collect_list(record)).alias("records"))
    return grouped.mapInArrow(run, "batch long, packed binary")
