"""Text logs as native expressions over lines: the lines themselves, what the parsers share, and candump.

Each parser takes lines (file, seq, line) and returns frames and, for lines that should be a frame but aren't one,
`rejected` true and a reason; bad lines never stop a read. Files are split by Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canlake import schema
from canlake.functions import frames as ff


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq, line): lines numbered file after file by name, counted per input split and added up over splits."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("line"))
    numbered = rows.withColumn("at", F.row_number().over(Window.partitionBy("file", "block").orderBy("row")))
    sizes = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each split
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return numbered.join(starts, ["file", "block"]).select("file", (F.col("start") + F.col("at") - 1).alias("seq"), F.regexp_replace("line", "^\ufeff", "").alias("line"))


def hex_number(text: Column) -> Column:
    """One to eight hex digits as a number; null for anything else."""
    return F.when(text.rlike("^[0-9A-Fa-f]{1,8}$"), F.conv(text, 16, 10).cast("long"))


def whole_number(text: Column) -> Column:
    """Decimal digits whose value fits a long; null for anything else."""
    return F.when(text.rlike(r"^\d+$"), text.try_cast("long"))


def decimal_ns(text: Column, power: int) -> Column:
    """A decimal number of units of 10^power ns, as ns; finer digits are cut, and what isn't one or passes a long is null."""
    plain = F.when(text.startswith("-"), F.substring(text, 2, 1 << 20)).otherwise(text)
    whole, fraction = F.substring_index(plain, ".", 1), F.when(plain.contains("."), F.substring_index(plain, ".", -1)).otherwise("")
    rest = F.rpad(F.substring(fraction, 1, power), power, "0").try_cast("long") if power else F.lit(0).cast("long")
    ns = F.call_function("try_add", F.call_function("try_multiply", whole.try_cast("long"), F.lit(10**power).cast("long")), rest)
    return F.when(text.rlike(r"^-?\d+(?:\.\d*)?$"), F.when(text.startswith("-"), -ns).otherwise(ns))


def with_file(lines: DataFrame) -> DataFrame:
    """lines with the file they come from; those made by hand are of one file without a name."""
    return lines if "file" in lines.columns else lines.withColumn("file", F.lit(""))


def can_id(raw: Column, extended: Column) -> Column:
    """The ID with its extended bit, which any ID above 11 bits gets."""
    return F.when(extended | (raw > 0x7FF), raw.bitwiseOR(F.lit(schema.EXTENDED_ID).cast("long"))).otherwise(raw)


def error_id() -> Column:
    return F.lit(schema.ERROR_ID).cast("long")


def frames_of(rows: DataFrame, ts: Column, bus: Column, id_: Column, flags: Column, data: Column, dlc: Column, checks: list[tuple[Column, str]]) -> DataFrame:
    """Frames of parsed lines; the first check that doesn't hold gives the reason for which a line is rejected."""
    reason = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(why)) for ok, why in checks])
    out = rows.select("file", "seq", ts.alias("ts_ns"), bus.alias("bus"), id_.alias("id"), flags.cast("int").alias("flags"), data.alias("data"), dlc.cast("int").alias("dlc"), reason.alias("reason"))
    remote = F.col("flags").bitwiseAND(F.lit(schema.REMOTE)) != 0
    return out.select(
        "file", "seq", "ts_ns", "bus", "id", "flags", ff.kind(F.col("flags")).alias("kind"), F.when(remote, 0).otherwise(F.length("data")).alias("len"), F.when(remote, F.col("dlc")).alias("remote_dlc"),
        F.when(remote, F.unhex(F.lit(""))).otherwise(F.col("data")).alias("data"), F.col("reason").isNotNull().alias("rejected"), "reason",
    )


_CANDUMP = r"^\s*\((-?\d+)\.(\d+)\)\s+(\S+)\s+([0-9A-Fa-f]{3}|[0-9A-Fa-f]{8})#(?:(R)([0-9A-Fa-f]?)(?:_([0-9A-Fa-f]))?|#([0-9A-Fa-f])((?:[0-9A-Fa-f]{2}\.?)*)|((?:[0-9A-Fa-f]{2}\.?)*)(?:_[0-9A-Fa-f])?)(?:\s+([TR]))?\s*$"


def candump(lines: DataFrame) -> DataFrame:
    """(sec.frac) bus ID#DATA, ID##fDATA for FD, ID#R for remote frames; eight digits make an extended ID.

    One pattern decides whether a line is good; its parts are then split off by their separators.
    """
    rows = with_file(lines).where(F.trim("line") != "").withColumn("cells", F.split(F.trim("line"), r"\s+"))
    frame = F.get("cells", F.lit(2))
    rows = rows.select(
        "file", "seq", "line", F.col("line").rlike(_CANDUMP).alias("good"), F.get("cells", F.lit(0)).alias("time"), F.get("cells", F.lit(1)).alias("bus"),
        F.get("cells", F.lit(3)).alias("mark"), F.substring_index(frame, "#", 1).alias("name"), F.regexp_replace(frame, "^[^#]*#", "").alias("body"),
    )
    ts = decimal_ns(F.rtrim(F.ltrim(F.col("time"), F.lit("(")), F.lit(")")), 9)
    raw, wide = hex_number(F.col("name")), F.length("name") == 8
    error = wide & (raw.bitwiseAND(F.lit(schema.ERROR_ID).cast("long")) != 0)
    id_ = F.when(error, F.lit(schema.ERROR_ID).cast("long")).when(wide, raw.bitwiseAND(F.lit(0x1FFFFFFF).cast("long")).bitwiseOR(F.lit(schema.EXTENDED_ID).cast("long"))).otherwise(raw)
    fd, remote = F.col("body").startswith("#"), F.col("body").startswith("R")
    fd_flags = F.coalesce(hex_number(F.substring("body", 2, 1)), F.lit(0))
    flags = F.when(fd, F.lit(schema.FD) + (fd_flags % 2) * schema.BRS + (F.floor(fd_flags / 2) % 2) * schema.ESI).otherwise(0) + F.when(remote, schema.REMOTE).otherwise(0) + F.when(error, schema.ERROR).otherwise(0) + F.when(F.col("mark") == "T", schema.TX).otherwise(0)
    plain = F.substring_index("body", "_", 1)
    data = F.when(~remote, F.call_function("try_to_binary", F.translate(F.when(fd, F.substring("body", 3, 1 << 20)).otherwise(plain), ".", ""), F.lit("hex")))
    digits = F.translate(F.substring("body", 2, 3), "_", "")
    dlc = F.coalesce(hex_number(F.when(remote & (digits != ""), F.right(digits, F.lit(1)))), F.lit(0))
    valid = remote | (F.length(data) <= F.when(fd, 64).otherwise(8))
    checks = [(F.col("good"), "not a frame"), (ts.isNotNull(), "bad timestamp"), (wide | (raw <= 0x7FF), "bad CAN ID"), (valid, "payload too long")]
    return frames_of(rows, F.when(F.col("good"), ts), F.col("bus"), id_, flags, data, dlc, checks)
