"""Live capture as Structured Streaming: frames that arrive in files, filtered, counted and kept as they come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from canlake.functions import frames as ff
from canlake.schema import FRAME_DDL


def capture(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream of frames from Parquet files that a recorder drops into a folder."""
    return spark.readStream.schema(FRAME_DDL).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def timed(frames: DataFrame, late: str = "10 seconds") -> DataFrame:
    """frames with the event time `at` and a watermark; later frames stay in the log and only miss live windows."""
    return frames.withColumn("at", F.timestamp_micros(ff.micros(F.col("ts_ns")))).withWatermark("at", late)


def frame_rate(frames: DataFrame, window: str = "2 seconds", slide: str = "1 second", seconds: int = 2) -> DataFrame:
    """Frames per second of each channel in sliding windows."""
    found = timed(frames).groupBy("channel", F.window("at", window, slide).alias("w")).agg((F.count(F.lit(1)) / seconds).alias("rate"))
    return found.select("channel", F.col("w.start").alias("start"), "rate")


def changes(frames: DataFrame) -> DataFrame:
    """Frames whose payload differs, over the common bytes, from the last frame of the same ID and kind; state is that payload.

    For frames that arrive in order; follow.follow takes any filter and places late frames.
    """

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts_ns", "seq"])
        before = state.get[0] if state.exists else None
        hit = []
        for data in rows.data:
            n = 0 if before is None else min(len(before), len(data))
            hit.append(n > 0 and before[:n] != data[:n])
            before = data
        state.update((before,))
        yield rows[hit][["seq", "ts_ns", "key", "kind"]]

    grouped = frames.select("seq", "ts_ns", "key", "kind", "data").groupBy("key", "kind")
    return grouped.applyInPandasWithState(follow, "seq long, ts_ns long, key long, kind string", "data binary", "append", GroupStateTimeout.NoTimeout)


def record(frames: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends what has arrived to a log by day, and ends when all of it is written; start it again for more."""
    dated = frames.withColumn("day", F.to_date(F.timestamp_micros(ff.micros(F.col("ts_ns")))))
    return dated.writeStream.format("parquet").partitionBy("day").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recent(log: DataFrame, keep_ns: int) -> DataFrame:
    """The rolling window of a recorded log: the last keep_ns before its newest frame."""
    newest = log.agg(F.max("ts_ns")).first()[0]
    return log.where(F.col("ts_ns") >= (newest or 0) - keep_ns)
