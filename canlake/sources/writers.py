"""Writers of text logs: each gives the lines of a log in time order as (ts_ns, seq, line); reassembled frames stay out.

A log is written as part files in time order, each of which begins with the format's header and so is a log of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canlake import schema

CSV_COLUMNS = ["timestamp", "channel", "arbitration_id", "extended", "remote", "error", "fd", "brs", "esi", "dlc", "dir", "data"]
# The first time that formats with a start time can hold, 1900, and days from TRC's epoch to 1970.
EARLIEST_NS, TRC_DAYS, DAY_NS = -2_208_988_800_000_000_000, 25569, 86_400_000_000_000
#: Buses that a numbered format can tell apart.
NUMBERED = 255


def _has(bit: int) -> Column:
    return F.col("flags").bitwiseAND(F.lit(bit)) != 0


def sent(frames: DataFrame) -> DataFrame:
    """The frames that came from the log, with the low bits of their ID and whether it is extended and they need an FD record."""
    low, wide = F.col("id").bitwiseAND(F.lit(0x7FFFFFFF).cast("long")), F.col("id").bitwiseAND(F.lit(schema.EXTENDED_ID).cast("long")) != 0
    return frames.where(~_has(schema.REASSEMBLED)).withColumn("low", low).withColumn("wide", wide).withColumn("flexible", _has(schema.FD) | (F.length("data") > 8))


def start_ns(frames: DataFrame) -> int:
    """The first time of a log; before 1900 only candump and CSV can hold it."""
    first = sent(frames).agg(F.min("ts_ns")).first()[0] or 0
    if first < EARLIEST_NS:
        raise ValueError("the log has times before 1900, which only candump and CSV can hold")
    return first


def bus_numbers(frames: DataFrame) -> dict[str, int]:
    """The number of each bus: N for buses that are all named can<N> (1 to 255), or else from 1 in the order of appearance."""
    first = F.min(F.struct(*schema.ORDER))
    buses = [r.bus for r in sent(frames).groupBy("bus").agg(first.alias("first")).orderBy("first").limit(NUMBERED + 1).collect()]
    if len(buses) > NUMBERED:
        raise ValueError(f"the log has more than {NUMBERED} buses, which only candump and CSV can hold")
    named = [int(b[3:]) for b in buses if b and b.startswith("can") and b[3:].isascii() and b[3:].isdigit() and not b[3:].startswith("0") and int(b[3:]) <= NUMBERED]
    return dict(zip(buses, named)) if len(set(named)) == len(buses) else {b: i + 1 for i, b in enumerate(buses)}


def numbered(numbers: dict[str, int]) -> Column:
    """The number of a frame's bus."""
    pairs = [F.lit(x) for bus, n in numbers.items() if bus is not None for x in (bus, n)]
    return F.coalesce(F.create_map(*pairs)[F.col("bus")] if pairs else F.lit(None).cast("int"), F.lit(numbers.get(None, 1)))


def dlc_of(length: Column) -> Column:
    """The smallest data length code that holds so many bytes."""
    return F.array_position(F.transform(F.array(*map(F.lit, schema.DLC_LENGTHS)), lambda n: n >= length), True).cast("int") - 1


def length_of(dlc: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, schema.DLC_LENGTHS)), dlc + 1)


def _plain_bus() -> Column:
    return F.when(F.coalesce(F.col("bus"), F.lit("")) == "", "can").otherwise(F.regexp_replace("bus", r'[\s\p{Cntrl},"]', "_"))


def _spaced(data: Column) -> Column:
    return F.rtrim(F.regexp_replace(F.hex(data), "(..)", "$1 "))


def _digit(n: Column) -> Column:
    return F.hex(n.cast("long"))


def _decimal(ns: Column, unit: int, digits: int) -> Column:
    """A time as units and fraction, cut to digits."""
    size = F.abs(ns)
    whole = F.call_function("div", size, F.lit(unit))
    rest = F.call_function("div", size % unit, F.lit(unit // 10**digits))
    return F.concat(F.when(ns < 0, "-").otherwise(""), whole.cast("string"), F.lit("."), F.lpad(rest.cast("string"), digits, "0"))


@dataclass
class Log:
    """Lines in a format with its header."""

    lines: DataFrame
    header: list[str]


def candump(frames: DataFrame) -> Log:
    """Microseconds; remote frames carry their length; all lines have a direction if a frame was sent."""
    rows = sent(frames)
    directed = bool(rows.where(_has(schema.TX)).limit(1).count())
    id_ = F.when(F.col("wide") | _has(schema.ERROR), F.lpad(F.hex("low"), 8, "0")).otherwise(F.lpad(F.hex("low"), 3, "0"))
    fd = F.when(_has(schema.BRS), 1).otherwise(0) + F.when(_has(schema.ESI), 2).otherwise(0)
    dlc = F.coalesce("remote_dlc", F.lit(0))
    remote = F.concat(F.lit("#R"), F.when(dlc == 0, "").when(dlc <= 8, _digit(dlc)).otherwise(F.concat(F.lit("8_"), _digit(dlc))))
    body = F.when(F.col("flexible"), F.concat(F.lit("##"), _digit(fd), F.hex("data"))).when(_has(schema.REMOTE), remote).otherwise(F.concat(F.lit("#"), F.hex("data")))
    way = F.when(_has(schema.TX), " T").otherwise(" R") if directed else F.lit("")
    return Log(rows.select(*schema.ORDER, F.concat(F.lit("("), _decimal(F.col("ts_ns"), 10**9, 6), F.lit(") "), _plain_bus(), F.lit(" "), id_, body, way).alias("line")), [])


def asc(frames: DataFrame) -> Log:
    """Hex IDs and seconds from the second of the first frame, which the date line gives in the session's time zone."""
    second = start_ns(frames) // 10**9
    zone = F.date_format(F.timestamp_seconds(F.lit(second)), "EEE MMM d HH:mm:ss.'000' yyyy")
    date = frames.sparkSession.range(1).select(zone).first()[0]
    number = numbered(bus_numbers(frames)).cast("string")
    way = F.when(_has(schema.TX), "Tx").otherwise("Rx")
    id_ = F.concat(F.hex("low"), F.when(F.col("wide"), "x").otherwise(""))
    brs, esi = (F.when(_has(bit), 1).otherwise(0) for bit in (schema.BRS, schema.ESI))
    said = F.hex((F.lit(0x1000) + brs * 0x2000 + esi * 0x4000).cast("long"))
    data = F.when(F.length("data") > 0, _spaced(F.col("data")))
    time = _decimal(F.col("ts_ns") - second * 10**9, 10**9, 6)
    fd = F.concat_ws(" ", time, F.lit("CANFD"), number, way, id_, F.lit(""), brs.cast("string"), esi.cast("string"), F.lower(_digit(dlc_of(F.length("data")))), F.length("data").cast("string"), data, F.lit("0 0"), said, F.lit("0 0 0 0 0"))
    remote = F.concat_ws(" ", time, number, id_, way, F.lit("r"), F.lower(_digit(F.col("remote_dlc"))))
    classic = F.concat_ws(" ", time, number, id_, way, F.lit("d"), F.length("data").cast("string"), data)
    line = F.when(_has(schema.ERROR), F.concat_ws(" ", time, number, F.lit("ErrorFrame"))).when(F.col("flexible"), fd).when(_has(schema.REMOTE), remote).otherwise(classic)
    head = [f"date {date}", "base hex  timestamps absolute", "internal events logged", f"Begin Triggerblock {date}", "   0.000000 Start of measurement"]
    return Log(sent(frames).select(*schema.ORDER, line.alias("line")), head)


def trc(frames: DataFrame) -> Log:
    """TRC 2.1: offsets in ms from the midnight before the first frame. An FD frame of a length without a code is padded with zeros."""
    day = start_ns(frames) // DAY_NS
    number = numbered(bus_numbers(frames)).cast("string")
    remote = _has(schema.REMOTE) & ~F.col("flexible")
    kind = F.when(_has(schema.ERROR), "ER").when(remote, "RR").when(~F.col("flexible"), "DT").when(_has(schema.BRS) & _has(schema.ESI), "BI").when(_has(schema.BRS), "FB").when(_has(schema.ESI), "FE").otherwise("FD")
    id_ = F.when(_has(schema.ERROR), "-").when(F.col("wide"), F.lpad(F.hex("low"), 8, "0")).otherwise(F.lpad(F.hex("low"), 4, "0"))
    dlc = F.when(remote & F.col("remote_dlc").isNotNull(), F.col("remote_dlc")).otherwise(dlc_of(F.length("data")))
    filled = F.when(remote, F.hex("data")).otherwise(F.rpad(F.hex("data"), 2 * length_of(dlc), "0"))
    data = F.when(F.length(filled) > 0, F.rtrim(F.regexp_replace(filled, "(..)", "$1 ")))
    line = F.concat_ws(" ", (F.col("seq") + 1).cast("string"), _decimal(F.col("ts_ns") - day * DAY_NS, 10**6, 3), kind, number, id_, F.when(_has(schema.TX), "Tx").otherwise("Rx"), F.lit("-"), dlc.cast("string"), data)
    return Log(sent(frames).select(*schema.ORDER, line.alias("line")), [";$FILEVERSION=2.1", f";$STARTTIME={day + TRC_DAYS}", ";$COLUMNS=N,O,T,B,I,d,R,L,D", ";"])


def csv(frames: DataFrame) -> Log:
    """One line a frame in CSV_COLUMNS, with Unix seconds, hex IDs and hex data."""
    mark = lambda bit: F.when(_has(bit), "1").otherwise("0")
    dlc = F.coalesce("remote_dlc", F.length("data")).cast("string")
    cells = [_decimal(F.col("ts_ns"), 10**9, 6), _plain_bus(), F.concat(F.lit("0x"), F.lower(F.hex("low"))), F.when(F.col("wide"), "1").otherwise("0"), *map(mark, (schema.REMOTE, schema.ERROR, schema.FD, schema.BRS, schema.ESI)), dlc, F.when(_has(schema.TX), "Tx").otherwise("Rx"), F.lower(F.hex("data"))]
    return Log(sent(frames).select(*schema.ORDER, F.concat_ws(",", *cells).alias("line")), [",".join(CSV_COLUMNS)])


FORMATS: dict[str, Callable[[DataFrame], Log]] = {"candump": candump, "asc": asc, "trc": trc, "csv": csv}


def write_log(frames: DataFrame, path: str, format: str = "candump", parts: int | None = None) -> None:
    """Writes a log as text files in time order, each with the header; with parts=1 it is one file."""
    log = FORMATS[format](frames)
    ordered = log.lines.orderBy(*schema.ORDER) if parts != 1 else log.lines.coalesce(1).sortWithinPartitions(*schema.ORDER)

    def headed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = log_header
        for b in rows:
            if head and b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(head, pa.string())], schema=b.schema)
                head = []
            yield b

    log_header = log.header
    lines = ordered.select("line")
    (lines.mapInArrow(headed, "line string") if log_header else lines).write.mode("overwrite").text(path)


def decode_csv(decoded: DataFrame, path: str) -> None:
    """Writes the rows of decode_all as CSV: frame, message, signal, value, in the order of frames."""
    rows = decoded.orderBy("seq", "message", "signal").select(F.col("seq").alias("frame"), "message", "signal", "value")
    rows.write.mode("overwrite").option("header", True).csv(path)
