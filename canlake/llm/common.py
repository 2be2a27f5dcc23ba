"""What several operators of this subpackage share: tables, written intermediates, ranks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space; `bytes.split()` cuts UTF-8 the same way.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a temporary one only where none is set on a single machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}/canlake-shared"
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def utf8(column: Column) -> Column:
    """The UTF-8 bytes of a string column; null stays null."""
    return column.cast("binary")


def on(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equality of the keys in which nulls meet."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def ranked(df: DataFrame, by: list[str], block: Column, order: list[str], out: str, plan: DataFrame | None = None) -> DataFrame:
    """df with `out`, the rank from 0 of each row among the rows of its group `by`, ordered by (block, order).

    No task holds a group: equal rows are counted first, only one (group, block) is sorted at a time, and blocks get
    their first rank from a running sum over the small table of block sizes. `block` must be a small integer. `plan`,
    a table with one row for each group, is joined to the block sizes and so reaches the rows without another shuffle.
    """
    cols = [c for c in df.columns]
    rows = df.withColumn("_block", block).groupBy(*cols, "_block").agg(F.count(F.lit(1)).alias("_n"))
    keys = [*by, "_block"]
    sizes = rows.groupBy(*keys).agg(F.sum("_n").alias("_size"))
    upto = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = sizes.withColumn("_start", F.sum("_size").over(upto) - F.col("_size")).drop("_size")
    extra: list[str] = []
    if plan is not None:
        extra = [c for c in plan.columns if c not in by]
        starts = starts.alias("s").join(plan.alias("p"), on(starts, plan, by), "left").select("s.*", *[f"p.{c}" for c in extra])
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_at", F.sum("_n").over(within) - F.col("_n"))
    both = rows.alias("r").join(starts.alias("s"), on(rows, starts, keys)).select(*[f"r.{c}" for c in cols], "_n", (F.col("_at") + F.col("_start")).alias("_from"), *[f"s.{c}" for c in extra])
    return both.select(*cols, *extra, F.explode(F.sequence(F.col("_from"), F.col("_from") + F.col("_n") - 1)).alias(out))


def batches(rows: Iterator[pa.RecordBatch], most: int = 1 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose `column` holds about `most` bytes, so that a task's memory doesn't depend on text lengths."""
    for b in rows:
        if not b.num_rows:
            continue
        array = b.column(b.schema.get_field_index(column))
        ends = pa.compute.cumulative_sum(pa.compute.fill_null(pa.compute.binary_length(array), 0).cast(pa.int64())).to_numpy(zero_copy_only=False)
        first = 0
        while first < b.num_rows:
            before = ends[first - 1] if first else 0
            last = max(int((ends <= before + most).sum()), first + 1)
            yield b.slice(first, last - first)
            first = last
