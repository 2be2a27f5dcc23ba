"""Reader of PEAK TRC logs, versions 1.0 to 2.1. A file's header comes to its lines by a join on the file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canlake import schema
from canlake.sources.text import can_id, decimal_ns, error_id, frames_of, hex_number, whole_number, with_file

# The flags of each type of frame; others are no frames. Days of the format's epoch before 1970.
TYPES = {"DT": 0, "RR": schema.REMOTE, "ER": schema.ERROR, "EC": schema.ERROR, "EB": schema.ERROR, "FD": schema.FD, "FB": schema.FD | schema.BRS, "FE": schema.FD | schema.ESI, "BI": schema.FD | schema.BRS | schema.ESI}
EPOCH_DAYS, DAY_NS = 25569, 86_400_000_000_000


def start_ns(days: Column) -> Column:
    """Days since 1899-12-30 with a fraction (18 digits count) as ns since 1970; null where it isn't that."""
    whole, fraction = F.substring_index(days, ".", 1).try_cast("long"), F.when(days.contains("."), F.substring(F.substring_index(days, ".", -1), 1, 18)).otherwise("0")
    part = F.concat(F.lit("0."), fraction).cast("decimal(18,18)") * F.lit(DAY_NS).cast("decimal(14,0)")
    ns = F.call_function("try_add", F.call_function("try_multiply", whole - EPOCH_DAYS, F.lit(DAY_NS).cast("long")), F.round(part, 0).cast("long"))
    return F.when(days.rlike(r"^\d{1,18}(?:\.\d*)?$"), ns)


def headers(lines: DataFrame) -> DataFrame:
    """(file, version_2, start, columns) of the files that have such lines."""
    key, value = F.regexp_extract("line", r"^\s*;\$(\w+)=", 1), F.trim(F.regexp_extract("line", "=(.*)$", 1))
    rows = lines.where(F.col("line").rlike(r"^\s*;\$(FILEVERSION|STARTTIME|COLUMNS)=")).select("file", "seq", key.alias("key"), value.alias("value"))
    last = lambda name: F.max_by(F.when(F.col("key") == name, F.col("value")), F.when(F.col("key") == name, F.col("seq")))
    return rows.groupBy("file").agg(last("FILEVERSION").startswith("2.").alias("version_2"), F.coalesce(start_ns(last("STARTTIME")), F.lit(0).cast("long")).alias("start"), F.transform(F.split(last("COLUMNS"), ","), lambda c: F.trim(c)).alias("columns"))


def trc(lines: DataFrame, default_start_ns: int = 0) -> DataFrame:
    """Frames and rejected lines. Times count from $STARTTIME, or from default_start_ns in a file without a header.

    Bus status changes, warnings and other lines that hold no frame are skipped.
    """
    lines = with_file(lines)
    known = headers(lines)
    rows = lines.where(~F.ltrim("line").startswith(";") & (F.trim("line") != "")).join(F.broadcast(known), "file", "left")  # a row for each file
    rows = rows.withColumn("w", F.split(F.trim("line"), r"\s+")).withColumn("version_2", F.coalesce("version_2", F.lit(False))).withColumn("start", F.coalesce("start", F.lit(default_start_ns).cast("long")))
    newer = F.col("version_2") | F.col("columns").isNotNull()
    return _version_2(rows.where(newer)).unionByName(_version_1(rows.where(~newer)))


def _way(text: Column) -> Column:
    return F.when(F.lower(text) == "rx", 0).when(F.lower(text) == "tx", schema.TX)


def _payload(words: Column) -> Column:
    return F.unhex(F.array_join(F.transform(words, lambda b: F.lpad(b, 2, "0")), ""))


def _bad_byte(words: Column) -> Column:
    return F.exists(words, lambda b: ~b.rlike("^[0-9A-Fa-f]{1,2}$"))


def _slice(first: Column, size: Column) -> Column:
    return F.when(size > 0, F.slice("w", first, size)).otherwise(F.array().cast("array<string>"))


def _version_2(rows: DataFrame) -> DataFrame:
    """Lines whose columns $COLUMNS names by letters; the data come last."""
    place = lambda letter: F.coalesce(F.array_position("columns", F.lit(letter)), F.lit(0)).cast("int")
    cell = lambda letter: F.when(place(letter) > 0, F.get("w", place(letter) - 1))
    usable = F.coalesce((F.least(*[place(x) for x in "OTID"]) > 0) & (F.greatest(place("l"), place("L")) > 0) & (place("D") == F.size("columns")), F.lit(False))
    of_type = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    rows = rows.withColumn("usable", usable).withColumn("type", cell("T")).where(~F.col("usable") | F.col("type").isin(list(TYPES)) | (F.size("w") < F.size("columns") - 1))
    rows = rows.select(
        "file", "seq", "w", "start", "usable", "columns", "type", of_type[F.col("type")].alias("marks"), decimal_ns(cell("O"), 6).alias("time"), F.when(place("B") > 0, whole_number(cell("B"))).otherwise(1).alias("bus"),
        F.when(place("d") > 0, _way(cell("d"))).otherwise(0).alias("way"), cell("I").alias("name"), whole_number(cell("l")).alias("said"), whole_number(cell("L")).alias("dlc"), place("l").alias("has_said"), place("D").alias("first"),
    )
    fd, error, remote = (F.col("marks").bitwiseAND(F.lit(bit)) != 0 for bit in (schema.FD, schema.ERROR, schema.REMOTE))
    coded = F.when(fd, F.element_at(F.array(*map(F.lit, schema.DLC_LENGTHS)), F.least(F.col("dlc"), F.lit(15)).cast("int") + 1)).otherwise(F.least(F.col("dlc"), F.lit(8)))
    length = F.when(F.col("has_said") > 0, F.col("said")).otherwise(coded).cast("int")
    there = F.size("w") - F.col("first") + 1
    rows = rows.withColumn("length", length).withColumn("taken", _slice(F.greatest(F.col("first"), F.lit(1)), F.when(error, F.greatest(there, F.lit(0))).when(remote, 0).otherwise(F.col("length"))))
    raw = hex_number(F.col("name"))
    id_ = F.when(error, error_id()).otherwise(can_id(raw, F.length("name") > 4))
    checks = [
        (F.col("usable"), "missing or unsupported ;$COLUMNS header"),
        (F.size("w") >= F.size("columns") - 1, "too few columns"),
        (F.col("time").isNotNull(), "bad time offset"),
        (F.col("bus").isNotNull(), "bad bus number"),
        (F.col("way").isNotNull(), "bad direction"),
        (F.when(F.col("has_said") > 0, F.col("said") <= 64).otherwise(F.col("dlc") <= 15), "bad data length"),
        (error | (raw <= 0x1FFFFFFF), "bad CAN ID"),
        (error | remote | (F.size("taken") == F.col("length")), "too few data bytes"),
        (F.size("taken") <= 64, "payload over 64 bytes"),
        (~_bad_byte(F.col("taken")), "bad data byte"),
    ]
    dlc = F.coalesce(F.col("dlc"), F.col("said"))
    good = F.size("taken") <= 64
    return frames_of(rows, F.call_function("try_add", F.col("start"), F.col("time")), F.concat(F.lit("can"), F.col("bus").cast("string")), id_, F.col("marks") + F.col("way"), F.when(good & ~_bad_byte(F.col("taken")), _payload(F.col("taken"))), F.when(dlc <= 15, dlc), checks)


def _version_1(rows: DataFrame) -> DataFrame:
    """Lines `number) offset [[bus] direction] ID [-] DLC data`, which tell their layout by where the direction stands."""
    word = lambda i: F.get("w", F.lit(i) if isinstance(i, int) else i)
    second, third = _way(word(2)), _way(word(3))
    at = F.when(second.isNotNull(), 3).when(third.isNotNull(), 4).otherwise(2)  # where the ID stands
    numbered = word(0).endswith(")")
    rows = rows.withColumn("at", at).withColumn("numbered", numbered)
    rows = rows.where(~F.col("numbered") | ~((F.lower(word(2)).isin("warng", "error") & second.isNull()) | (word(F.col("at")) == "FFFFFFFF")) | F.size("w").__lt__(4))
    next_ = F.col("at") + 1 + F.when((F.col("at") > 2) & (word(F.col("at") + 1) == "-"), 1).otherwise(0)
    rows = rows.select("file", "seq", "w", "start", "numbered", "at", decimal_ns(word(1), 6).alias("time"), word(F.col("at")).alias("name"), F.when(F.col("at") == 4, whole_number(word(2))).otherwise(1).alias("bus"), F.coalesce(_way(word(F.col("at") - 1)), F.lit(0)).alias("way"), whole_number(word(next_)).alias("dlc"), (next_ + 1).alias("first"))
    remote = F.coalesce(word(F.col("first")) == "RTR", F.lit(False))
    length = F.when(remote, 0).otherwise(F.least(F.col("dlc"), F.lit(8))).cast("int")
    rows = rows.withColumn("remote", remote).withColumn("length", length).withColumn("taken", _slice(F.col("first") + 1, F.col("length")))
    raw = hex_number(F.col("name"))
    checks = [
        (F.col("numbered"), "expected a message number"),
        (F.col("time").isNotNull(), "bad time offset"),
        (F.col("bus").isNotNull(), "bad bus number"),
        (F.col("dlc") <= 15, "bad DLC"),
        (raw <= 0x1FFFFFFF, "bad CAN ID"),
        (F.size("taken") == F.col("length"), "too few data bytes"),
        (~_bad_byte(F.col("taken")), "bad data byte"),
    ]
    flags = F.when(F.col("remote"), schema.REMOTE).otherwise(0) + F.col("way")
    return frames_of(rows, F.call_function("try_add", F.col("start"), F.col("time")), F.concat(F.lit("can"), F.col("bus").cast("string")), can_id(raw, F.length("name") > 4), flags, F.when(~_bad_byte(F.col("taken")), _payload(F.col("taken"))), F.col("dlc"), checks)
