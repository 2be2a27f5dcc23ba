"""Writers of BLF and MF4 logs. Spark orders the frames and cuts them into parts; each task writes its part as a file of its own.

A part's file has its own start time and is a whole log. Files are written through the path's file system, under the
number of the part, so a task that runs again writes the same file again.
"""

from __future__ import annotations

import datetime
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canlake import schema
from canlake.sources.writers import bus_numbers, dlc_of, numbered, sent, start_ns

#: Bytes of objects in a BLF container, and records in a deflated MF4 block.
CONTAINER_BYTES, BLOCK_RECORDS = 1 << 17, 12_000
COLUMNS = "ts_ns long, number int, low long, wide boolean, flexible boolean, flags int, dlc int, data binary"


def _system_time(seconds: int) -> bytes:
    at = datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=seconds)
    return struct.pack("<8H", at.year, at.month, at.isoweekday() % 7, at.day, at.hour, at.minute, at.second, 0)


def _blf_object(kind: int, body: bytes, ns: int) -> bytes:
    size = 32 + len(body)
    return struct.pack("<4sHHIIII", b"LOBJ", 32, 1, size, kind, 2, 0) + struct.pack("<Q", ns) + body + b"\0" * (size % 4)


def blf_content(batches: Iterator[pd.DataFrame]) -> Iterator[bytes]:
    """A BLF file in pieces: containers as they fill, and last of all the header, which comes first in the file."""
    start = end = None
    packed, total, objects = [], 0, 0
    held = bytearray()

    def container() -> bytes:
        body = struct.pack("<H6xI4x", 2, len(held)) + zlib.compress(bytes(held))
        size = 16 + len(body)
        return struct.pack("<4sHHII", b"LOBJ", 16, 1, size, 10) + body + b"\0" * (size % 4)

    for b in batches:
        for ts, number, low, wide, flexible, flags, dlc, data in b.itertuples(index=False, name=None):
            start = ts // 10**9 if start is None else start
            end = ts // 10**9
            id_ = low | (schema.EXTENDED_ID if wide else 0)
            if flags & schema.ERROR:
                kind, body = 73, struct.pack("<H8xB13x8s", number, min(len(data), 8), bytes(data[:8]))
            elif flexible:
                marks = 0x1000 | (0x2000 if flags & schema.BRS else 0) | (0x4000 if flags & schema.ESI else 0)
                kind, body = 101, struct.pack("<BBBxII", number, dlc, len(data), id_, 0) + struct.pack("<I18xBxI", marks, 1 if flags & schema.TX else 0, 0) + bytes(data)
            else:
                kind, body = 1, struct.pack("<HBBI8s", number, (1 if flags & schema.TX else 0) | (0x80 if flags & schema.REMOTE else 0), dlc, id_, bytes(data))
            held += _blf_object(kind, body, ts - start * 10**9)
            objects += 1
            if len(held) >= CONTAINER_BYTES:
                packed.append(container())
                total, held = total + len(held), bytearray()
    if held:
        packed.append(container())
        total += len(held)
    size = 144 + sum(map(len, packed))
    head = struct.pack("<4sI4xB3xQQI4x", b"LOGG", 144, 2, size, total, objects) + _system_time(start or 0) + _system_time(end or 0)
    yield head.ljust(144, b"\0")
    yield from packed


def _block(kind: bytes, links: list[int], data: bytes) -> bytes:
    size = 24 + 8 * len(links) + len(data)
    return struct.pack("<4s4xQQ", kind, size, len(links)) + struct.pack(f"<{len(links)}Q", *links) + data + b"\0" * (-size % 8)


# The structures of bus events, their members as (name, byte, bit, bits, type), and the bytes of a record.
MEMBERS = [("BusChannel", 8, 0, 8, 0), ("ID", 9, 0, 32, 0), ("IDE", 13, 0, 1, 0), ("Dir", 13, 1, 1, 0), ("EDL", 13, 2, 1, 0), ("BRS", 13, 3, 1, 0), ("ESI", 13, 4, 1, 0), ("DLC", 14, 0, 8, 0), ("DataLength", 15, 0, 8, 0), ("DataBytes", 16, 0, 512, 10)]
STRUCTURES, RECORD = ["CAN_DataFrame", "CAN_RemoteFrame", "CAN_ErrorFrame"], 80


def _records(b: pd.DataFrame, start: int) -> np.ndarray:
    out = np.zeros((len(b), RECORD), np.uint8)
    flags = b["flags"].to_numpy()
    out[:, :8] = (b.ts_ns.to_numpy() - start).astype("<u8").reshape(-1, 1).view(np.uint8)
    out[:, 8] = b.number
    out[:, 9:13] = b.low.to_numpy().astype("<u4").reshape(-1, 1).view(np.uint8)
    has = lambda bit: (flags & bit > 0).astype(np.uint8)
    out[:, 13] = b.wide.to_numpy() | has(schema.TX) << 1 | b.flexible.to_numpy().astype(np.uint8) << 2 | has(schema.BRS) << 3 | has(schema.ESI) << 4
    out[:, 14], out[:, 15] = b.dlc, b.data.str.len()
    out[:, 16:] = np.frombuffer(b"".join(bytes(d).ljust(64, b"\0") for d in b.data), np.uint8).reshape(-1, 64)
    return out


def mf4_content(batches: Iterator[pd.DataFrame]) -> Iterator[bytes]:
    """An MF4 file in pieces: identification and header, then for each structure its deflated records and its channels."""
    rows: list[list[np.ndarray]] = [[], [], []]
    start = None
    for b in batches:
        if len(b):
            start = int(b.ts_ns.iloc[0]) if start is None else start
            kind = np.where(b["flags"] & schema.ERROR, 2, np.where((b["flags"] & schema.REMOTE > 0) & ~b["flexible"], 1, 0))
            for k in range(3):
                if (kind == k).any():
                    rows[k].append(_records(b[kind == k], start))
    made, at = [], 64 + 24 + 8 * 6 + 32

    def put(kind: bytes, links: list[int], data: bytes) -> int:
        nonlocal at
        piece = _block(kind, links, data)
        made.append(piece)
        at += len(piece)
        return at - len(piece)

    def text(value: str) -> int:
        return put(b"##TX", [], value.encode() + b"\0")

    group = 0
    for k in (2, 1, 0):  # the list of groups is made from its end
        if not rows[k]:
            continue
        records = np.concatenate(rows[k])
        parts = []
        for i in range(0, len(records), BLOCK_RECORDS):
            part = records[i : i + BLOCK_RECORDS]
            body = zlib.compress(np.ascontiguousarray(part.T).tobytes())
            parts.append(put(b"##DZ", [], struct.pack("<2sBxIQQ", b"DT", 1, RECORD, part.size, len(body)) + body))
        offsets = np.arange(len(parts), dtype=np.uint64) * np.uint64(BLOCK_RECORDS * RECORD)
        data = put(b"##DL", [0, *parts], struct.pack("<B3xI", 0, len(parts)) + offsets.tobytes())
        data = put(b"##HL", [data], struct.pack("<HBB4x", 0, 1, 0))
        channel = 0
        for name, byte, bit, bits, type_ in reversed(MEMBERS):
            channel = put(b"##CN", [channel, 0, text(f"{STRUCTURES[k]}.{name}"), 0, 0, 0, 0, 0], struct.pack("<BBBBIIIIBBHdddddd", 0, 0, type_, bit, byte, bits, 0, 0, 0, 0, 0, *[0.0] * 6))
        frame = put(b"##CN", [0, channel, text(STRUCTURES[k]), 0, 0, 0, 0, 0], struct.pack("<BBBBIIIIBBHdddddd", 0, 0, 10, 0, 8, (RECORD - 8) * 8, 0, 0, 0, 0, 0, *[0.0] * 6))
        to_seconds = put(b"##CC", [0, 0, 0, 0], struct.pack("<BBHHHdddd", 1, 0, 0, 0, 2, 0.0, 0.0, 0.0, 1e-9))
        time = put(b"##CN", [frame, 0, text("Timestamp"), 0, to_seconds, 0, text("s"), 0], struct.pack("<BBBBIIIIBBHdddddd", 2, 1, 0, 0, 0, 64, 0, 0, 0, 0, 0, *[0.0] * 6))
        cg = put(b"##CG", [0, time, text(STRUCTURES[k]), 0, 0, 0], struct.pack("<QQHH4xII", 0, len(records), 2, 46, RECORD, 0))
        group = put(b"##DG", [group, cg, data, 0], struct.pack("<B7x", 0))
    head = _block(b"##HD", [group, 0, 0, 0, 0, 0], struct.pack("<qhhBBBBdd", start or 0, 0, 0, 0, 0, 0, 0, 0.0, 0.0))
    yield struct.pack("<8s8s8sHHHH", b"MDF     ", b"4.10    ", b"canlake ", 0, 0, 410, 0).ljust(64, b"\0")
    yield head
    yield from made


CONTENTS = {"blf": blf_content, "mf4": mf4_content}


def write_binary(frames: DataFrame, path: str, format: str, parts: int | None = None) -> list[str]:
    """Writes a log in time order as binary files below path, and returns their names; with parts=1 it is one file."""
    start_ns(frames)  # times before 1900 can't be written
    number = numbered(bus_numbers(frames))
    rows = sent(frames)
    rows = rows.select("ts_ns", "seq", number.cast("int").alias("number"), F.col("low").bitwiseAND(F.lit(0x1FFFFFFF).cast("long")).alias("low"), "wide", "flexible", "flags", F.coalesce("remote_dlc", dlc_of(F.length("data"))).alias("dlc"), "data")
    ordered = rows.coalesce(1).sortWithinPartitions("ts_ns", "seq") if parts == 1 else rows.orderBy("ts_ns", "seq")
    contents, suffix = CONTENTS[format], format

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = next((b for b in batches if len(b)), None)
        if first is None:
            return
        name = f"part-{TaskContext.get().partitionId():05d}.{suffix}"  # type: ignore[union-attr]
        system, folder = pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder.rstrip('/')}/{name}") as out:
            for piece in contents(b for one in ([first], batches) for b in one):
                out.write(piece)
        yield pd.DataFrame({"name": [name]})

    return sorted(r.name for r in ordered.drop("seq").mapInPandas(run, "name string").collect())
