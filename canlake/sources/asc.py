"""Reader of Vector ASC logs: classic and FD frames, hex or decimal, with absolute or relative times.

What a file's header says (`base`, `date`, `timestamps`) holds for the whole file and comes to its lines by a join on the
file; of several lines of a kind the last counts. Dates are in the session's time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canlake import schema
from canlake.operators.history import with_running_sum
from canlake.sources.text import can_id, decimal_ns, error_id, frames_of, hex_number, whole_number, with_file

# Names of months as the tools write them, English and German, by their first three letters.
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12, "mai": 5, "okt": 10, "dez": 12}
# Bits of a CANFD line's flags, for FD frames and remote ones.
EDL, RTR = 0x1000, 0x10
_DATE = r"\b(" + "|".join(MONTHS) + r")[a-z]*\s+(\d{1,2})\s+(\d{1,2}):(\d{1,2}):(\d{1,2})(?:\.(\d+))?\s+(?:(am|pm)\s+)?(\d{4})\b"


def date_ns(line: Column) -> Column:
    """The time in a `date` line in ns since 1970; null where it isn't one."""
    low = F.lower(line)
    part = lambda n: F.regexp_extract(low, _DATE, n)
    number = lambda n: part(n).try_cast("int")
    month = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])[part(1)]
    hour = F.when(part(7) == "", number(3)).otherwise(number(3) % 12 + F.when(part(7) == "pm", 12).otherwise(0))
    at = F.call_function("try_make_timestamp", number(8), month, number(2), hour, number(4), number(5).cast("decimal(16,6)"))
    return F.when(low.rlike(r"^\s*date\s") & low.rlike(_DATE), F.unix_micros(at) * 1000 + F.rpad(F.substring(part(6), 1, 9), 9, "0").cast("long"))


def headers(lines: DataFrame) -> DataFrame:
    """(file, decimal, relative, date_ns) of the files that have such lines."""
    low = F.lower(F.trim("line"))
    is_base = low.rlike(r"^base\s")
    last = lambda found, value: F.max_by(F.when(found, value), F.when(found, F.col("seq")))
    timed = is_base & low.rlike(r"^base\s+\S+\s+timestamps")
    rows = lines.where(low.rlike(r"^(base|date)\s"))
    return rows.groupBy("file").agg(
        last(low.rlike(r"^base\s+(dec|hex)\b"), low.rlike(r"^base\s+dec\b")).alias("decimal"),
        last(timed, low.rlike(r"^base\s+\S+\s+timestamps\s+relative\b")).alias("relative"),
        last(low.rlike(r"^date\s"), date_ns(F.col("line"))).alias("date_ns"),
    )


def asc(lines: DataFrame, start_ns: int = 0) -> DataFrame:
    """Frames and rejected lines. Times count from the header's date, or from start_ns in a file without a date that can be read.

    Relative times count from the event before, whatever it holds, and start anew at each `Begin` line; they are added up
    by running sums over spans of lines. Lines of other events are skipped.
    """
    lines = with_file(lines)
    known = headers(lines)
    lines = lines.join(F.broadcast(known), "file", "left").withColumn("decimal", F.coalesce("decimal", F.lit(False))).withColumn("relative", F.coalesce("relative", F.lit(False)))
    lines = lines.withColumn("w", F.split(F.trim("line"), r"\s+"))
    event = F.col("w")[0].rlike(r"^\d")
    own = decimal_ns(F.col("w")[0], 9)
    if known.where("relative").limit(1).count():
        begins = F.lower(F.col("w")[0]) == "begin"
        blocks = with_running_sum(lines, ["file"], begins.cast("long"), "block")
        step = F.when(event & F.col("relative"), F.coalesce(own, F.lit(0).cast("long"))).otherwise(0)
        lines = with_running_sum(blocks, ["file", "block"], step, "sum").withColumn("time", F.when(own.isNotNull(), F.when(F.col("relative"), F.col("sum")).otherwise(own)))
    else:
        lines = lines.withColumn("time", own)

    word = lambda i: F.get("w", F.lit(i) if isinstance(i, int) else i)
    number = lambda text: F.when(F.col("decimal"), whole_number(text)).otherwise(hex_number(text))
    way = lambda text: F.when(F.lower(text) == "rx", 0).when(F.lower(text).isin("tx", "txrq"), schema.TX)
    fd = F.lower(word(1)) == "canfd"
    error = F.when(fd, F.lower(word(4)) == "errorframe").otherwise(F.lower(word(2)) == "errorframe")
    classic = word(1).rlike(r"^\d+$") & (error | way(word(3)).isNotNull())
    rows = lines.where(event).withColumn("fd", F.coalesce(fd, F.lit(False))).withColumn("error", F.coalesce(error, F.lit(False)))
    rows = rows.where(F.col("time").isNull() | F.col("fd") | F.coalesce(classic, F.lit(False)))
    # a symbolic name may stand before the bit rate switch
    shift = F.when(word(5).isin("0", "1"), 0).otherwise(1)
    is_fd, form = F.col("fd"), F.lower(word(4))
    name = F.when(is_fd, word(4)).otherwise(word(2))
    rows = rows.select(
        "file", "seq", "w", "decimal", "time", "fd", "error", "date_ns",
        F.when(is_fd, word(2)).otherwise(word(1)).alias("channel"), F.when(is_fd, way(word(3))).otherwise(F.when(F.col("error"), 0).otherwise(way(word(3)))).alias("way"),
        F.lower(name).endswith("x").alias("wide"), number(F.regexp_replace(name, "[xX]$", "")).alias("raw"), F.when(is_fd, "d").otherwise(form).alias("form"),
        word(5 + shift).alias("brs"), word(6 + shift).alias("esi"), number(F.when(is_fd, word(7 + shift)).otherwise(word(5))).alias("dlc"),
        whole_number(word(8 + shift)).alias("said"), F.when(is_fd, 9 + shift).otherwise(6).alias("first"),
    )
    remote_line = ~is_fd & (F.col("form") == "r")
    size = F.when(is_fd, F.col("said")).when(F.col("form") == "d", F.least(F.col("dlc"), F.lit(8))).otherwise(0).cast("int")
    rows = rows.withColumn("size", F.when(F.col("error"), 0).otherwise(size))
    taken = F.when(F.col("size") > 0, F.slice("w", F.col("first") + 1, F.col("size"))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("taken", taken).withColumn("bytes", F.transform("taken", lambda b: F.when(F.col("decimal"), whole_number(b)).otherwise(hex_number(b))))
    said = F.when(is_fd, hex_number(word(F.col("first") + F.col("size") + 2)))
    marks = lambda bit: said.bitwiseAND(F.lit(bit).cast("long")) != 0
    flexible = is_fd & (said.isNull() | marks(EDL))
    remote = remote_line | F.coalesce(marks(RTR), F.lit(False))
    flags = F.when(flexible, schema.FD + F.when(F.col("brs") == "1", schema.BRS).otherwise(0) + F.when(F.col("esi") == "1", schema.ESI).otherwise(0)).otherwise(0) + F.when(remote, schema.REMOTE).otherwise(0)
    flags = F.when(F.col("error"), schema.ERROR).otherwise(flags + F.col("way"))
    data = F.unhex(F.array_join(F.transform("bytes", lambda b: F.lpad(F.hex(b), 2, "0")), ""))
    good, is_error = F.col("taken"), F.col("error")
    checks = [
        (F.col("time").isNotNull(), "bad timestamp"),
        (whole_number(F.col("channel")).isNotNull(), "bad channel"),
        (F.col("way").isNotNull(), "bad direction"),
        (is_error | (F.col("raw") <= 0x1FFFFFFF), "bad CAN ID"),
        (is_error | F.col("form").isin("d", "r"), "bad frame type"),
        (is_error | remote_line | (F.col("dlc") <= 15), "bad DLC"),
        (is_error | ~is_fd | (F.col("said") <= 64), "bad data length"),
        (is_error | (F.size(good) == F.coalesce(F.col("size"), F.lit(-1))), "too few data bytes"),
        (is_error | ~F.exists("bytes", lambda b: b.isNull() | (b > 255)), "bad data byte"),
    ]
    ts = F.call_function("try_add", F.col("time"), F.coalesce(F.col("date_ns"), F.lit(start_ns).cast("long")))
    bus = F.concat(F.lit("can"), whole_number(F.col("channel")).cast("string"))
    dlc = F.coalesce(F.when(F.col("dlc") <= 15, F.col("dlc")), F.lit(0).cast("long"))
    return frames_of(rows, ts, bus, F.when(is_error, error_id()).otherwise(can_id(F.col("raw"), F.col("wide"))), flags, data, dlc, checks)
