"""Time series of signals: decimated views that keep every spike, byte lanes, window statistics and lookups in time.

A series is (ts_ns, seq, value); NaN is a value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canlake.functions import frames as ff
from canlake.operators.history import spanned, spans_of, with_index, with_previous


def info(series: DataFrame) -> DataFrame:
    """Count, and minimum and maximum without NaN."""
    real = F.when(~F.isnan("value"), F.col("value"))
    return series.agg(F.count(F.lit(1)).alias("count"), F.min(real).alias("min"), F.max(real).alias("max"))


def _extremes(rows: DataFrame, by: list[str], place: str) -> DataFrame:
    """Of each bucket the first NaN, the first lowest and the first highest point."""
    real, at = ~F.isnan("value"), F.col(place)
    point = F.struct(F.col(place).alias("place"), "ts_ns", "value")
    lowest = F.min_by(F.when(real, point), F.when(real, F.struct("value", at)))
    highest = F.max_by(F.when(real, point), F.when(real, F.struct(F.col("value"), -at)))
    nan = F.min_by(F.when(~real, point), F.when(~real, at))
    found = rows.groupBy(*by, "bucket").agg(F.array_compact(F.array(nan, lowest, highest)).alias("points"))
    return found.select(*by, "bucket", F.explode("points").alias("p")).select(*by, "bucket", "p.place", "p.ts_ns", "p.value").distinct()


def view(series: DataFrame, t0_ns: int, t1_ns: int, buckets: int) -> DataFrame:
    """(ts_ns, value) of the window and one neighbour on either side; decimated if it has more than two points a bucket.

    The neighbours are found by one aggregate, and only the window's points are numbered.
    """
    at, low, high = F.struct("ts_ns", "seq"), F.col("ts_ns") < t0_ns, F.col("ts_ns") > t1_ns
    ends = series.agg(F.max(F.when(low, at)).alias("left"), F.min(F.when(high, at)).alias("right"), F.count_if(~low & ~high).alias("inside")).first()
    edge = [(F.col("ts_ns") == e.ts_ns) & (F.col("seq") == e.seq) for e in (ends.left, ends.right) if e]
    near = series.where(reduce(lambda a, b: a | b, edge, ~low & ~high))
    points = ends.inside + len(edge)
    if points <= 2 * buckets or t1_ns <= t0_ns or buckets <= 0:
        return near.select("ts_ns", "value")
    window = with_index(near)
    bucket = F.floor((F.col("ts_ns") - t0_ns).cast("double") / ((t1_ns - t0_ns) / buckets)).cast("long")
    return _extremes(window.withColumn("bucket", bucket), [], "index").select("ts_ns", "value")


def byte_lanes(frames: DataFrame, key: int, t0_ns: int, t1_ns: int, buckets: int) -> DataFrame:
    """(byte, bucket, ts_ns, value): a view of each payload byte of one ID: the window's points and a neighbour on either side.

    A byte with at most two points a bucket has them all; of others each bucket keeps the extremes. Neighbours stand in
    buckets outside 0 to buckets - 1. A number that is missing in an array is no point.
    """
    rows = frames.where(F.col("key") == key)
    lanes = rows.select("ts_ns", "seq", F.posexplode(ff.payload(frames).numbers()).alias("byte", "value")).where("value is not null").withColumn("value", F.col("value").cast("double"))
    at, low, high = F.struct("ts_ns", "seq"), F.col("ts_ns") < t0_ns, F.col("ts_ns") > t1_ns
    ends = lanes.groupBy("byte").agg(F.max(F.when(low, at)).alias("left"), F.min(F.when(high, at)).alias("right"), F.count_if(~low & ~high).alias("inside"))
    some = lanes.join(F.broadcast(ends), "byte")  # a row for each byte of a payload
    point = F.struct("ts_ns", "seq")
    near = some.where((~low & ~high) | F.coalesce(point == F.col("left"), F.lit(False)) | F.coalesce(point == F.col("right"), F.lit(False)))
    inner = ff.bucket_of(F.col("ts_ns"), t0_ns, t1_ns, buckets) if t1_ns > t0_ns and buckets > 0 else F.lit(0).cast("long")
    near = near.withColumn("bucket", F.when(low, F.lit(-1).cast("long")).when(high, F.lit(max(buckets, 1)).cast("long")).otherwise(inner))
    points = F.col("inside") + F.col("left").isNotNull().cast("int") + F.col("right").isNotNull().cast("int")
    plain = (points <= 2 * buckets) | F.lit(t1_ns <= t0_ns or buckets <= 0)
    shown = ["byte", "bucket", "ts_ns", "value"]
    few = near.where(plain).select(F.col("byte").cast("long").alias("byte"), *shown[1:])
    return few.unionByName(_extremes(near.where(~plain), ["byte"], "seq").select(F.col("byte").cast("long").alias("byte"), *shown[1:]))


def finite_range(series: DataFrame) -> DataFrame:
    """One row: the lowest and the highest finite value, nulls if there are none."""
    real = F.when(~F.isnan("value") & (F.abs("value") != float("inf")), F.col("value"))
    return series.agg(F.min(real).alias("lo"), F.max(real).alias("hi"))


def with_gaps(series: DataFrame) -> DataFrame:
    """series with null for values that can't be drawn: NaN and infinities."""
    return series.withColumn("value", F.when(~F.isnan("value") & (F.abs("value") != float("inf")), F.col("value")))


def isolated_points(series: DataFrame) -> DataFrame:
    """The drawable points of a series with gaps that have no drawable neighbour; a line through the others misses them."""
    rows = with_gaps(series).withColumn("there", F.col("value").isNotNull())
    turned = rows.withColumn("seq", -F.col("seq")).withColumn("ts_ns", -F.col("ts_ns"))
    before = with_previous(rows, [], {"there": "before"})
    after = with_previous(turned, [], {"there": "after"}).select((-F.col("ts_ns")).alias("ts_ns"), (-F.col("seq")).alias("seq"), "after")
    alone = ~F.coalesce("before", F.lit(False)) & ~F.coalesce("after", F.lit(False))
    return before.join(after, ["ts_ns", "seq"]).where(F.col("there") & alone).select("ts_ns", "seq", "value")


def window_stats(series: DataFrame, t0_ns: int, t1_ns: int) -> DataFrame:
    """One row: points, changes (NaN to NaN and 0 to -0 are none), minimum, maximum and last value of a window."""
    rows = with_previous(series.where(F.col("ts_ns").between(t0_ns, t1_ns)), [], {"value": "before"})
    same = F.col("value") == F.col("before")
    return rows.agg(
        F.count(F.lit(1)).alias("points"),
        F.count_if(F.col("before").isNotNull() & ~same).alias("changes"),
        F.min(F.when(~F.isnan("value"), F.col("value"))).alias("min"),
        F.max(F.when(~F.isnan("value"), F.col("value"))).alias("max"),
        F.max_by("value", F.struct("ts_ns", "seq")).alias("last"),
    )


def sparkline(frames: DataFrame, key: int, points: int = 64) -> DataFrame:
    """(k, seq): evenly spaced frames of an ID, the first and the last among them; all if there are fewer.

    Frames are counted by span, and only the spans that hold a chosen frame are ordered.
    """
    rows = frames.where(F.col("key") == key).select("ts_ns", "seq")
    rows = rows.withColumn("_span", spans_of(rows).of())
    sizes = rows.groupBy("_span").agg(F.count(F.lit(1)).alias("n"))
    every = F.sum("n").over(Window.partitionBy(F.lit(0)))  # over a row for each span
    counted = sizes.withColumn("first", F.sum("n").over(Window.orderBy("_span")) - F.col("n")).withColumn("total", every)
    count = F.least(F.lit(points).cast("long"), F.col("total"))
    place = F.call_function("div", F.col("k") * (F.col("total") - 1), F.greatest(count - 1, F.lit(1)))
    wanted = counted.select("_span", "n", "first", "total", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("k")).withColumn("at", place)
    wanted = wanted.where((F.col("at") >= F.col("first")) & (F.col("at") < F.col("first") + F.col("n"))).select("_span", (F.col("at") - F.col("first")).alias("_at"), "k")
    near = rows.join(F.broadcast(wanted.select("_span").distinct()), "_span", "left_semi")  # at most a row for each point
    numbered = near.withColumn("_at", (F.row_number().over(Window.partitionBy("_span").orderBy("ts_ns", "seq")) - 1).cast("long"))
    return numbered.join(F.broadcast(wanted), ["_span", "_at"]).select("k", "seq")


def sample_at(series: DataFrame, times_ns: list[int]) -> DataFrame:
    """(t_ns, value): linear between the neighbouring points, and the nearest end outside. One pass for all times."""
    def around(t: int) -> list[Column]:
        at, point = F.struct("ts_ns", "seq"), F.struct("ts_ns", "value")
        upto, after = F.col("ts_ns") <= t, F.col("ts_ns") > t
        return [F.max_by(F.when(upto, point), F.when(upto, at)).alias(f"a{t}"), F.min_by(F.when(after, point), F.when(after, at)).alias(f"b{t}")]

    found = series.agg(*[c for t in times_ns for c in around(t)])

    def between(t: int) -> Column:
        a, b = F.col(f"a{t}"), F.col(f"b{t}")
        share = (F.lit(t) - a["ts_ns"]) / (b["ts_ns"] - a["ts_ns"])
        return F.when(a.isNull(), b["value"]).when(b.isNull(), a["value"]).otherwise(a["value"] + share * (b["value"] - a["value"]))

    return found.select(F.inline(F.array(*[F.struct(F.lit(t).cast("long").alias("t_ns"), between(t).alias("value")) for t in times_ns])))


def points_at(series: DataFrame, times_ns: list[int]) -> DataFrame:
    """(t_ns, ts_ns, value): the last point at or before each time, or else the first point. One pass for all times."""
    at, point = F.struct("ts_ns", "seq"), F.struct("ts_ns", "value")
    last = [F.max_by(F.when(F.col("ts_ns") <= t, point), F.when(F.col("ts_ns") <= t, at)).alias(f"a{i}") for i, t in enumerate(times_ns)]
    found = series.agg(F.min_by(point, at).alias("first"), *last)
    rows = [F.struct(F.lit(t).cast("long").alias("t_ns"), F.coalesce(f"a{i}", "first").alias("p")) for i, t in enumerate(times_ns)]
    return found.select(F.inline(F.array(*rows))).where("p is not null").select("t_ns", "p.ts_ns", "p.value")


def as_of(series: DataFrame, reference: DataFrame, span_ns: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """(ts_ns, seq, value, reference), and the columns of the series to keep: the last reference value at or before each point, null before the first.

    The two are merged in spans of about equal numbers of rows, and each span starts from the last reference of the spans before it, so no
    task sees a whole series. A point without a time has no reference, and a reference without one belongs to no point.
    """
    keep, reference = keep or [], reference.where("ts_ns is not null")
    both = series.select("ts_ns", "seq", "value", *keep, F.lit(None).cast("double").alias("reference"), F.lit(1).alias("side"))
    both = both.unionByName(reference.select("ts_ns", "seq", F.lit(None).cast("double").alias("value"), F.col("value").alias("reference"), F.lit(0).alias("side")), allowMissingColumns=True)
    both, single = spanned(both, None if span_ns is not None else spans_of(both).by_time(), span_ns)
    order = Window.partitionBy("_span").orderBy("ts_ns", "side", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = both.withColumn("reference", F.last("reference", ignorenulls=True).over(order)).where("side = 1")
    if single:
        return merged.select("ts_ns", "seq", "value", *keep, "reference")
    last = both.groupBy("_span").agg(F.max_by("reference", F.when(F.col("side") == 0, F.struct("ts_ns", "seq"))).alias("_last"))
    upto = Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.withColumn("_carried", F.last("_last", ignorenulls=True).over(upto)).drop("_last")
    found = F.when(F.col("ts_ns").isNotNull(), F.coalesce("reference", "_carried")).alias("reference")
    return merged.join(carried, "_span", "left").select("ts_ns", "seq", "value", *keep, found)


def line(x: str, y: str) -> tuple[Column, Column]:
    """Aggregates: Pearson's correlation and the slope of y over x; null where one of them doesn't vary."""
    ratio = lambda a, b: a / F.nullif(b, F.lit(0.0))
    return ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), ratio(F.covar_pop(x, y), F.var_pop(x))


def fit(pairs: DataFrame) -> DataFrame:
    """Points with a reference, and their Pearson correlation and line."""
    both = pairs.where("reference is not null and not isnan(value) and not isnan(reference)")
    r, slope = line("value", "reference")
    sums = both.agg(F.count(F.lit(1)).alias("n"), r.alias("r"), slope.alias("slope"), F.avg("value").alias("_x"), F.avg("reference").alias("_y"))
    return sums.select("n", "r", "slope", (F.col("_y") - F.col("slope") * F.col("_x")).alias("intercept"))


def near_markers(frames: DataFrame, markers_ns: list[int], around_ns: int = 1_000_000_000) -> DataFrame:
    """(key, marker, frames, changes): what each ID does within a time around each marker (at most a few tens)."""
    rows = with_previous(frames, ["key", "kind"], {"data": "before"})
    spark = frames.sparkSession
    marks = F.broadcast(spark.createDataFrame([(i, m - around_ns, m + around_ns) for i, m in enumerate(markers_ns)], "marker long, low long, high long"))
    data, before = ff.payload(rows), ff.payload(rows, "before")
    size = data.common(before)
    changed = (size > 0) & (data.start(size) != before.start(size))
    inside = rows.where(F.expr(" or ".join(f"ts_ns between {m - around_ns} and {m + around_ns}" for m in markers_ns))).withColumn("changed", F.coalesce(changed, F.lit(False)))
    near = inside.join(marks, F.col("ts_ns").between(F.col("low"), F.col("high")))
    return near.groupBy("key", "marker").agg(F.count(F.lit(1)).alias("frames"), F.count_if("changed").alias("changes"))


def aligned(left: DataFrame, right: DataFrame) -> DataFrame:
    """(ts_ns, a, b) of two series with one value for each time (the last), null where one has none."""
    last = lambda df, name: df.groupBy("ts_ns").agg(F.max_by("value", "seq").alias(name))
    return last(left, "a").join(last(right, "b"), "ts_ns", "full_outer")
