"""A recorded capture that keeps its statistics: spans of time as partitions, and for each a state that merges with the next.

A span's state has the ends of every ID, sums over the gaps and flips inside it, and its first and last payloads. States of
spans that follow each other merge into what a look at all frames would give: the gap and the pair of payloads across
each cut come from the ends. A batch makes the states of the spans that it touches anew, from these spans alone, so late
frames are counted where they belong and a repeated batch changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from canlake.functions.frames import payload
from canlake.operators.history import in_order, place
from canlake.operators.stats import byte_flips, flip_rows
from canlake.schema import FRAME_DDL, ORDER

#: Nanoseconds of a span.
SPAN_NS = 60_000_000_000


def id_states(frames: DataFrame) -> DataFrame:
    """(span, key, channel, id, ...): counts, ends and sums over gaps of each ID in each span; frames have `span`."""
    own = Window.partitionBy("span", "key").orderBy(*ORDER)
    gap = F.col("ts_ns") - F.col("before")
    rows = frames.withColumn("before", F.lag("ts_ns").over(own))
    return rows.groupBy("span", "key", "channel", "id").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"), F.min(F.struct(*ORDER))["seq"].alias("first_seq"),
        F.count(gap).alias("gaps"), F.coalesce(F.sum(gap.cast("double")), F.lit(0.0)).alias("sum"), F.coalesce(F.sum(gap.cast("double") * gap), F.lit(0.0)).alias("squares"),
        F.min("len").cast("long").alias("min_len"), F.max("len").cast("long").alias("max_len"), F.bit_or("flags").cast("long").alias("flags"),
    )


def merged_ids(states: DataFrame) -> DataFrame:
    """Per ID what stats.id_summary says of all frames, from the states of its spans."""
    across = F.col("first_ns") - F.lag("last_ns").over(Window.partitionBy("key").orderBy("span"))
    rows = states.withColumn("across", across.cast("double"))
    n, gaps = F.sum("n"), F.sum(F.col("gaps") + F.col("across").isNotNull().cast("int"))
    total, squares = F.sum(F.col("sum") + F.coalesce("across", F.lit(0.0))), F.sum(F.col("squares") + F.coalesce(F.col("across") * F.col("across"), F.lit(0.0)))
    variance = F.greatest(squares / gaps - (total / gaps) * (total / gaps), F.lit(0.0))
    return rows.groupBy("key", "channel", "id").agg(
        n.alias("count"), F.when(n > 1, (F.max("last_ns") - F.min("first_ns")) / (n - 1) / 1e6).alias("period_ms"), F.when(gaps >= 2, F.sqrt(variance) / 1e6).alias("jitter_ms"),
        F.min("min_len").alias("min_len"), F.max("max_len").alias("max_len"), F.bit_or("flags").alias("flags"), F.min(F.struct("first_ns", "first_seq"))["first_seq"].alias("first_seq"),
    )


def flip_states(frames: DataFrame) -> DataFrame:
    """(span, key, kind, first, last, size, flips): of each ID and kind in each span its ends and the flips of its bytes."""
    own = Window.partitionBy("span", "key", "kind").orderBy(*in_order())
    rows = frames.select("span", "key", "kind", *ORDER, "data").withColumn("before", F.lag("data").over(own))
    ends = rows.groupBy("span", "key", "kind").agg(F.min_by("data", place()).alias("first"), F.max_by("data", place()).alias("last"), F.max(payload(frames).length()).alias("size"))
    sums = byte_flips(rows, ["span", "key", "kind"])
    packed = sums.groupBy("span", "key", "kind").agg(F.collect_list(F.struct("byte", "pairs", *[f"f{b}" for b in range(8)])).alias("flips"))  # at most a payload's bytes
    return ends.join(packed, ["span", "key", "kind"], "left")


def merged_flips(states: DataFrame) -> DataFrame:
    """(key, byte, bit, flips, pairs) as stats.bit_flips gives it for all frames, from the states of the spans."""
    before = F.lag("last").over(Window.partitionBy("key", "kind").orderBy("span"))
    across = byte_flips(states.select("key", F.col("first").alias("data"), before.alias("before")), ["key"])
    inside = states.select("key", F.explode("flips").alias("f")).select("key", "f.*")
    names = ["pairs", *[f"f{b}" for b in range(8)]]
    sums = inside.unionByName(across).groupBy("key", "byte").agg(*[F.sum(c).alias(c) for c in names])
    sizes = states.groupBy("key").agg(F.max("size").alias("size")).where("size > 0")
    return flip_rows(sums, sizes)


@dataclass(frozen=True)
class CaptureLog:
    """A capture in a folder that all executors share: frames, and the states of IDs and of flips, all by span."""

    folder: str
    span_ns: int = SPAN_NS

    def _span(self) -> Column:
        return F.floor(F.col("ts_ns") / F.lit(self.span_ns))

    def _write(self, batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("span", self._span())
        # a batch has its own folder in each span, which a repeated attempt replaces
        self._replace(batch.withColumn("batch", F.lit(number)), "frames", ["span", "batch"])
        spark = batch.sparkSession
        touched = batch.select("span").distinct()
        rows = self.frames(spark).join(F.broadcast(touched), "span", "left_semi")  # at most a row for each span of the batch
        self._replace(id_states(rows), "ids", ["span"])
        self._replace(flip_states(rows), "flips", ["span"])

    def _replace(self, rows: DataFrame, name: str, by: list[str]) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{self.folder}/{name}")

    def record(self, frames: DataFrame, checkpoint: str) -> StreamingQuery:
        """Writes what has arrived, batch by batch with its statistics, and ends; start it again for more."""
        return frames.writeStream.foreachBatch(self._write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def _read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.option("ignoreMissingFiles", "true").parquet(f"{self.folder}/{name}")

    def frames(self, spark: SparkSession) -> DataFrame:
        reader = spark.read.schema(f"{FRAME_DDL}, span long, batch long").option("ignoreMissingFiles", "true")
        return reader.parquet(f"{self.folder}/frames").drop("batch")

    def id_summary(self, spark: SparkSession) -> DataFrame:
        return merged_ids(self._read(spark, "ids"))

    def bit_flips(self, spark: SparkSession) -> DataFrame:
        return merged_flips(self._read(spark, "flips"))

    def recent(self, spark: SparkSession, keep_ns: int) -> DataFrame:
        """The frames of the last keep_ns before the newest one; spans before them aren't read."""
        newest = self._read(spark, "ids").agg(F.max("last_ns")).first()[0] or 0
        low = newest - keep_ns
        return self.frames(spark).where((F.col("span") >= low // self.span_ns) & (F.col("ts_ns") >= low)).drop("span")

    def trim(self, spark: SparkSession, keep_ns: int) -> int:
        """Drops the spans that end before the last keep_ns, and says how many; at most one span more than keep_ns stays.

        Whole folders go, oldest first and frames before their states, so a writer that adds newer spans isn't disturbed
        and a trim that was cut short is finished by the next one.
        """
        ids = self._read(spark, "ids")
        newest = ids.agg(F.max("last_ns")).first()[0]
        if newest is None:
            return 0
        first = (newest - keep_ns) // self.span_ns
        old = [r.span for r in ids.where(F.col("span") < first).select("span").distinct().orderBy("span").collect()]  # folders to drop
        for span in old:
            for name in ("frames", "flips", "ids"):
                path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/span={span}")
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        return len(old)
