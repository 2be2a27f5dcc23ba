"""Logs of any format as frames: detection, reading with channels and keys, and the counts of a read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canlake.functions import frames as ff
from canlake.sources import asc, blf, csv_log, mf4, text, trc

#: Formats by file name, where the content doesn't tell.
EXTENSIONS = {"log": "candump", "txt": "candump", "candump": "candump", "asc": "asc", "trc": "trc", "csv": "csv", "blf": "blf", "mf4": "mf4", "mdf": "mf4"}
#: Buses that have a channel of their own; all later ones share the last.
CHANNELS = 256
#: Numbers that each binary file has for its frames.
FILE_ROWS = 1 << 40
FRAME = ["seq", "ts_ns", "bus", "channel", "id", "key", "flags", "kind", "len", "remote_dlc", "data"]


def detect(spark: SparkSession, path: str, most: int = 20) -> str:
    """The format of a log by its first lines, or else by its name, or else candump. Only a few lines are read."""
    rows = spark.read.text(path).limit(most).select("value", F.col("_metadata.file_path").alias("file")).collect()
    head = [r.value.lstrip("﻿") for r in rows]
    first = next((h.strip() for h in head if h.strip()), "")
    low = first.lower()
    if first.startswith("LOGG"):
        return "blf"
    if first.startswith(("MDF     ", "UnFinMF ")):
        return "mf4"
    if first.startswith("("):
        return "candump"
    plain = next((h for h in head if h.strip() and not h.startswith("#") and not h.lower().startswith("sep=")), "")
    if csv_log.layout(plain):
        return "csv"
    if first.startswith((";$", ";#", ";-")):
        return "trc"
    if low.startswith(("base hex", "base dec", "begin triggerblock")) or (low.startswith("date ") and any(m in low for m in asc.MONTHS)):
        return "asc"
    name = rows[0].file if rows else path
    return EXTENSIONS.get(name.rstrip("/").rsplit(".", 1)[-1].lower(), "candump")


def in_one_order(spark: SparkSession, frames: DataFrame, path: str) -> DataFrame:
    """frames (file, seq in the file) of several files with one seq over all: file after file by name, each in its own order.

    Frames of one time then go by file, group and record, on every read. Numbers leave gaps between files.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("_path"))  # names only, no contents
    place = F.row_number().over(Window.orderBy("_path")) - 1  # over a row for each file
    numbered = files.withColumn("_place", place.cast("long"))
    return frames.join(numbered, F.col("file") == F.col("_path")).withColumn("seq", F.col("_place") * FILE_ROWS + F.col("seq")).select(*frames.columns)


def with_channels(frames: DataFrame, by_time: bool = False) -> DataFrame:
    """frames with the channel of their bus, in the order of first appearance in the files or in time, and their key."""
    first = frames.groupBy("bus").agg(F.min(F.struct("ts_ns", "seq") if by_time else F.col("seq")).alias("_first"))
    number = F.row_number().over(Window.orderBy("_first", "bus")) - 1  # over a row for each bus
    numbered = first.select("bus", F.least(number, F.lit(CHANNELS - 1)).cast("int").alias("channel"))
    rows = frames.drop("channel").join(numbered, "bus")
    return rows.withColumn("key", ff.key(F.col("channel"), F.col("id")))


def parse(spark: SparkSession, path: str, format: str | None = None, start_ns: int = 0) -> DataFrame:
    """Frames and rejected lines of a log (a file, a folder or a pattern of one format), without channels.

    start_ns is where times begin in files that don't say it themselves.
    """
    format = format or detect(spark, path)
    if format in ("blf", "mf4"):
        read = {"blf": blf.read_blf, "mf4": mf4.read_mf4}[format](spark, path)
        return in_one_order(spark, read, path).withColumn("rejected", F.lit(False)).withColumn("reason", F.lit(None).cast("string"))
    lines = text.read_lines(spark, path)
    if format == "candump":
        return text.candump(lines)
    return csv_log.csv(lines) if format == "csv" else {"asc": asc.asc, "trc": trc.trc}[format](lines, start_ns)


def read_log(spark: SparkSession, path: str, format: str | None = None, start_ns: int = 0) -> DataFrame:
    """The frames of a log as the operators take them; lines that were rejected are left out (see parse_stats)."""
    format = format or detect(spark, path)
    # the groups of MF4 files are merged by time, and so are their buses
    return with_channels(parse(spark, path, format, start_ns).where("not rejected"), format == "mf4").select(*FRAME)


def parse_stats(parsed: DataFrame) -> DataFrame:
    """One row: frames, rejected lines, and the first of these with its reason."""
    first = F.min(F.when(F.col("rejected"), F.struct("seq", "reason")))
    return parsed.agg(F.count_if(~F.col("rejected")).alias("frames"), F.count_if("rejected").alias("rejected"), first["seq"].alias("first_rejected"), first["reason"].alias("reason"))
