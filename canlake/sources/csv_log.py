"""Reader of CSV logs of any tool whose header names a time, an ID and the data; delimiter, columns and units come from the header."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canlake import schema
from canlake.sources.text import can_id, decimal_ns, frames_of, hex_number, whole_number, with_file

# Names of columns, without blanks, underscores and dashes, by what they hold.
NAMES = {
    "id": ["id", "arbitrationid", "canid", "identifier", "frameid", "msgid", "messageid", "arbid"],
    "length": ["dlc", "len", "length", "datalength", "datalen"],
    "data": ["data", "databytes", "payload", "bytes", "hexdata", "datahex"],
    "extended": ["extended", "ext", "ide", "isextended", "isextendedid", "extendedid", "extendedframe"],
    "remote": ["remote", "rtr", "isremote", "remoteframe", "isremoteframe"],
    "error": ["error", "err", "iserror", "errorframe", "iserrorframe"],
    "fd": ["fd", "isfd", "canfd", "edl"],
    "brs": ["brs", "bitrateswitch"],
    "esi": ["esi", "errorstateindicator"],
    "way": ["dir", "direction", "rx/tx", "rxtx", "tx"],
    "bus": ["bus", "channel", "interface", "buschannel", "chn", "ch"],
}
# Names of units by their power of ten of ns; what flags read as; Unix ms from 2000 to 2100.
UNITS = {0: ["ns", "nano", "nanos", "nanosecond", "nanoseconds"], 3: ["us", "µs", "μs", "micro", "micros", "microsecond", "microseconds"], 6: ["ms", "milli", "millis", "millisecond", "milliseconds"], 9: ["s", "sec", "secs", "second", "seconds"]}
TRUE, FALSE = ["1", "true", "yes", "y", "t", "x"], ["0", "false", "no", "n", "f", "-", ""]
UNIX_MS = (946_684_800_000, 4_102_444_800_000)
#: Columns of a header that are looked at.
MOST = 256

_ROLE = {name: role for role, names in NAMES.items() for name in names if name != "tx"}
_BASE64 = "^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"


@dataclass
class Layout:
    """Where a header's columns stand; unit is a power of ten of ns, or None where the rows must tell."""

    delimiter: str
    columns: dict[str, int] = field(default_factory=dict)
    bytes_: tuple[int, int] | None = None
    unit: int | None = None


def _cell(raw: str) -> str:
    raw = raw.strip()
    return raw[1:-1].strip() if len(raw) > 1 and raw[0] == raw[-1] == '"' else raw


def layout(header: str) -> Layout | None:
    """The layout that a header line describes; None if it lacks a time, an ID or the data."""
    delimiter = max(",;\t", key=header.count) if any(d in header for d in ",;\t") else ","
    out, single = Layout(delimiter), []
    for i, raw in enumerate(header.lstrip("﻿").split(delimiter)[:MOST]):
        name = re.sub(r"[ _'-]", "", _cell(raw).lower())
        if number := re.fullmatch(r"(?:byte|data|d|b)(?:\[(\d{1,3})\]|(\d{1,3}))", name):
            single.append((int(number[1] or number[2]), i))
        elif re.split(r"[(\[]", name)[0] in ("t", "ts") or name.startswith("time"):
            if "time" not in out.columns:
                out.columns["time"] = i
                words = re.findall(r"[^\W_]+", _cell(raw).lower())
                out.unit = next((p for p, names in UNITS.items() if words and words[-1] in names), None)
        elif role := _ROLE.get(name.split("(")[0]):
            out.columns.setdefault(role, i)
    if "data" not in out.columns:
        single.sort()
        if not single or any(b[0] != a[0] + 1 or b[1] != a[1] + 1 for a, b in zip(single, single[1:])):
            return None
        out.bytes_ = (single[0][1], min(len(single), 64))
    return out if {"time", "id"} <= out.columns.keys() and re.search("[A-Za-z]", header) else None


def csv(lines: DataFrame) -> DataFrame:
    """Frames and rejected lines. A file's header is its first line that is no comment; without a usable one all of its lines are rejected.

    Files with one header are read together; the distinct headers come to the driver, one line for each tool's layout.
    """
    lines = with_file(lines).where(F.trim("line") != "")
    plain = lines.where(~F.col("line").startswith("#") & ~F.lower("line").startswith("sep="))
    heads = plain.groupBy("file").agg(F.min(F.struct("seq", "line")).alias("head")).select("file", F.col("head.seq").alias("head_seq"), F.col("head.line").alias("header"))
    rows = lines.join(F.broadcast(heads), "file").where(F.col("seq") >= F.col("head_seq"))  # a row for each file
    headers = [r.header for r in heads.select("header").distinct().collect()]
    parts = []
    for header in headers:
        of = layout(header)
        own = rows.where(F.col("header") == header)
        parts.append(_rows(own.where("seq > head_seq"), of) if of else _unreadable(own))
    return reduce(DataFrame.unionByName, parts) if parts else _unreadable(rows.withColumn("header", F.lit("")))


def _unreadable(rows: DataFrame) -> DataFrame:
    no = F.lit(None)
    return frames_of(rows, no.cast("long"), no.cast("string"), no.cast("long"), F.lit(0), no.cast("binary"), no.cast("int"), [(F.lit(False), "no usable header")])


def _by_shape(time: Column) -> Column:
    """The unit that a time without one implies: with a point or an exponent seconds, else by its size ns, ms or us."""
    plain = F.ltrim(time, F.lit("-"))
    number = plain.try_cast("long")
    return F.when(plain.rlike("[.eE+-]"), 9).when(F.length(plain) >= 17, 0).when(number.between(UNIX_MS[0], UNIX_MS[1] - 1), 6).otherwise(3)


def _time(text: Column, unit: Column) -> Column:
    number = F.when(text.rlike(r"^-?\d+(?:\.\d*)?[eE][+-]?\d+$"), text.try_cast("double"))
    scaled = reduce(lambda a, p: a.when(unit == p, F.when(number.isNotNull(), F.when(F.abs(number) * 10.0**p < 9e18, F.round(number * 10.0**p).cast("long"))).otherwise(decimal_ns(text, p))), UNITS, F.when(F.lit(False), F.lit(0).cast("long")))
    return scaled


def _rows(rows: DataFrame, of: Layout) -> DataFrame:
    cells = F.transform(F.split("line", re.escape(of.delimiter)), lambda c: F.trim(F.regexp_replace(F.trim(F.regexp_replace(c, r"\r$", "")), '^"(.*)"$', "$1")))
    rows = rows.withColumn("w", cells)
    cell = lambda role: F.get("w", F.lit(of.columns[role])) if role in of.columns else F.lit(None).cast("string")
    if of.unit is None:  # the first time that isn't zero tells the unit of its file
        shape = _by_shape(cell("time"))
        telling = rows.where(cell("time").rlike(r"^-?\d[0-9.eE+-]*$") & ~cell("time").rlike("^-?0+$"))
        units = telling.groupBy("file").agg(F.min_by(shape, "seq").alias("unit"))
        rows = rows.join(F.broadcast(units), "file", "left").withColumn("unit", F.coalesce("unit", F.lit(3)))
    else:
        rows = rows.withColumn("unit", F.lit(of.unit))
    flag = lambda role: F.when(cell(role).isNull() | F.lower(cell(role)).isin(FALSE), False).when(F.lower(cell(role)).isin(TRUE), True)
    bare = F.regexp_replace(cell("id"), "^0[xX]", "")
    length = whole_number(cell("length"))
    way = F.lower(F.coalesce(cell("way"), F.lit("")))
    rows = rows.select(
        "file", "seq", "w", _time(cell("time"), F.col("unit")).alias("time"), hex_number(bare).alias("raw"), *[flag(r).alias(r) for r in ("extended", "remote", "error", "fd", "brs", "esi")],
        F.when(way.isin("tx", "t"), schema.TX).otherwise(0).alias("way"), cell("length").isNotNull().alias("has_length"), length.alias("length"), cell("bus").alias("bus"), F.coalesce(cell("data"), F.lit("")).alias("text"), (F.size("w") > max(of.columns["id"], of.columns.get("data", 0), of.bytes_[0] if of.bytes_ else 0)).alias("whole"),
    )
    if of.bytes_:
        first, count = of.bytes_
        some = F.slice("w", first + 1, count)
        empty = F.array_position(F.transform(some, lambda b: b == ""), True)
        taken = F.when(empty > 0, F.slice(some, F.lit(1), (empty - 1).cast("int"))).otherwise(some)
        digits = F.transform(taken, lambda b: F.regexp_replace(b, "^0[xX]", ""))
        data = F.when(~F.exists(digits, lambda b: ~b.rlike("^[0-9A-Fa-f]{1,2}$")), F.unhex(F.array_join(F.transform(digits, lambda b: F.lpad(b, 2, "0")), "")))
    else:
        # bytes in hex, with or without separators and 0x, or base64; the reading that has the stated length counts
        text = F.regexp_replace("text", "0[xX]", "")
        as_hex = F.when(F.col("bare").rlike("^[ :.,-]*(?:[0-9A-Fa-f]{2}[ :.,-]*)*$"), F.unhex(F.regexp_replace("bare", "[ :.,-]", "")))
        as_64 = F.when(F.trim("text").rlike(_BASE64), F.unbase64(F.trim("text")))
        rows = rows.withColumn("bare", text).withColumns({"as_hex": as_hex, "as_64": as_64})  # columns, as each is looked at several times
        fits = lambda d: F.length(d) == F.col("length")
        told = F.col("as_hex").isNotNull() & (~F.col("has_length") | fits("as_hex") | F.col("as_64").isNull() | ~fits("as_64"))
        data = F.when(told, F.col("as_hex")).otherwise(F.col("as_64"))
    rows = rows.withColumn("data", data)
    taken = F.when(F.col("length") < F.length("data"), F.substring("data", F.lit(1), F.col("length").cast("int"))).otherwise(F.col("data"))
    rows = rows.withColumn("data", F.when(F.length("data") <= 64, taken))
    flexible = F.col("fd") | F.col("brs") | F.col("esi") | (F.length("data") > 8)
    bit = lambda name, value: F.when(F.col(name), value).otherwise(0)
    flags = F.when(flexible, schema.FD).otherwise(0) + bit("brs", schema.BRS) + bit("esi", schema.ESI) + bit("remote", schema.REMOTE) + bit("error", schema.ERROR) + F.col("way")
    low = F.col("raw").bitwiseAND(F.lit(0x1FFFFFFF).cast("long"))
    id_ = F.when(F.col("error"), low.bitwiseOR(F.lit(schema.ERROR_ID).cast("long"))).otherwise(can_id(F.col("raw"), F.col("extended")))
    bus = F.when(F.coalesce(F.col("bus"), F.lit("")) == "", "can1").when(whole_number(F.col("bus")).isNotNull(), F.concat(F.lit("can"), whole_number(F.col("bus")).cast("string"))).otherwise(F.col("bus"))
    checks = [
        (F.col("whole"), "too few columns"),
        (F.col("time").isNotNull(), "bad timestamp"),
        *[(F.col(r).isNotNull(), f"bad {r} flag") for r in ("extended", "remote", "error", "fd", "brs", "esi")],
        (F.col("raw").isNotNull() & (F.col("error") | (F.col("raw") <= 0x1FFFFFFF)), "bad CAN ID"),
        (~F.col("has_length") | (F.col("length") <= 64), "bad length"),
        (F.col("data").isNotNull(), "bad data"),
    ]
    return frames_of(rows, F.col("time"), bus, id_, flags, F.col("data"), F.when(F.col("length") <= 15, F.col("length")), checks)
