"""Summaries of a log: totals, IDs, bit flips, activity and bus load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canlake import schema
from canlake.functions import frames as ff
from canlake.operators.history import with_previous

DEFAULT_BITRATE = 500_000


def log_info(frames: DataFrame) -> DataFrame:
    """One row: frames, duration in seconds, channels, and counts of error and reassembled frames."""
    has = lambda bit: F.col("flags").bitwiseAND(F.lit(bit)) != 0
    return frames.agg(
        F.count(F.lit(1)).alias("frames"),
        F.count_if(has(schema.ERROR)).alias("error_frames"),
        F.count_if(has(schema.REASSEMBLED)).alias("reassembled_frames"),
        ((F.max("ts_ns") - F.min("ts_ns")) / F.lit(1e9)).alias("duration_s"),
        F.count_distinct("channel").alias("channels"),
    )


def with_messages(summary: DataFrame, names: DataFrame) -> DataFrame:
    """An ID summary with each ID's message, its own ID and the database it comes from, or nulls. names: as decode.resolve gives them."""
    told = names.select("channel", "id", "message", F.col("scope").alias("database"), "message_id")
    return summary.join(told, ["channel", "id"], "left")


def channels(frames: DataFrame) -> DataFrame:
    """Channels in the order of their first frame."""
    return frames.groupBy("channel").agg(F.count(F.lit(1)).alias("frames"), F.min(F.struct(*schema.ORDER)).alias("first")).select("channel", "frames", F.col("first.ts_ns").alias("first_ns"), F.col("first.seq").alias("first_seq"))


def kind_counts(frames: DataFrame) -> DataFrame:
    return frames.groupBy("channel", "kind").agg(F.count(F.lit(1)).alias("frames"), F.sum("len").cast("long").alias("bytes"))


def id_summary(frames: DataFrame) -> DataFrame:
    """Per ID: count, mean period, jitter (population deviation of all gaps), payload lengths, flags and first frame."""
    gaps = with_previous(frames.select("seq", "ts_ns", "channel", "id", "key", "flags", "len"), ["key"], {"ts_ns": "before"})
    gap = F.col("ts_ns") - F.col("before")
    n = F.count(F.lit(1))
    return gaps.groupBy("key", "channel", "id").agg(
        n.alias("count"),
        F.when(n > 1, (F.max("ts_ns") - F.min("ts_ns")) / (n - 1) / 1e6).alias("period_ms"),
        F.when(F.count(gap) >= 2, F.stddev_pop(gap) / 1e6).alias("jitter_ms"),
        F.min("len").cast("long").alias("min_len"),
        F.max("len").cast("long").alias("max_len"),
        F.bit_or("flags").cast("long").alias("flags"),
        F.min(F.struct(*schema.ORDER))["seq"].alias("first_seq"),
    )


def _pairs(frames: DataFrame, t0: int | None, t1: int | None) -> DataFrame:
    """Frames with the payload of the previous frame of the same ID and kind; with bounds, both frames lie inside."""
    rows = frames.select("seq", "ts_ns", "key", "kind", "data")
    if t0 is not None:
        rows = rows.where(F.col("ts_ns").between(t0, t1))
    return with_previous(rows, ["key", "kind"], {"data": "before"})


def byte_flips(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(*by, byte, pairs, f0 to f7): over rows (data, before), how often both have the byte (and its number isn't missing), and each of its bits differs."""
    data, before = ff.payload(pairs), ff.payload(pairs, "before")
    common = data.common(before)
    places = F.when(common > 0, F.sequence(F.lit(0), common - 1))
    xor = data.byte(F.col("byte")).bitwiseXOR(before.byte(F.col("byte")))
    changed = pairs.where(common > 0).select(*by, "data", "before", F.explode(places).alias("byte")).select(*by, "byte", xor.alias("x"))
    return changed.groupBy(*by, "byte").agg(F.count("x").alias("pairs"), *[F.sum(F.shiftright("x", b).bitwiseAND(F.lit(1))).alias(f"f{b}") for b in range(8)])


def flip_rows(sums: DataFrame, sizes: DataFrame) -> DataFrame:
    """(key, byte, bit, flips, pairs) of every bit of each ID's longest payload; sizes: (key, size), sums: as byte_flips by key."""
    grid = sizes.select("key", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("byte"))
    flips = F.array(*[F.coalesce(f"f{b}", F.lit(0)).cast("long") for b in range(8)])
    wide = grid.join(sums, ["key", "byte"], "left").select("key", "byte", F.coalesce("pairs", F.lit(0)).alias("pairs"), F.posexplode(flips).alias("bit", "flips"))
    return wide.select("key", F.col("byte").cast("long"), F.col("bit").cast("long"), "flips", F.col("pairs").cast("long"))


def bit_flips(frames: DataFrame, t0: int | None = None, t1: int | None = None) -> DataFrame:
    """(key, byte, bit, flips, pairs) for every bit of the ID's longest payload in the whole log.

    A pair is two neighbouring frames of one ID and kind that both have the byte. All bits of a byte are summed in one
    pass and become rows afterwards.
    """
    sizes = frames.groupBy("key").agg(F.max(ff.payload(frames).length()).alias("size")).where("size > 0")
    return flip_rows(byte_flips(_pairs(frames, t0, t1), ["key"]), sizes)


def change_activity(frames: DataFrame, t0: int, t1: int, buckets: int) -> DataFrame:
    """(key, bucket, changed_bits): bits that changed against the previous frame, which may lie before the window."""
    pairs = _pairs(frames, None, None)
    data, before = ff.payload(pairs), ff.payload(pairs, "before")
    common = data.common(before)
    places = F.when(common > 0, F.sequence(F.lit(0), common - 1))
    changed = F.aggregate(places, F.lit(0), lambda a, i: a + F.coalesce(F.bit_count(data.byte(i).bitwiseXOR(before.byte(i))), F.lit(0)))
    rows = pairs.where(F.col("ts_ns").between(t0, t1) & (common > 0))
    return rows.groupBy("key", ff.bucket_of(F.col("ts_ns"), t0, t1, buckets).alias("bucket")).agg(F.sum(changed).cast("long").alias("changed_bits"))


def bus_load(frames: DataFrame, t0: int, t1: int, buckets: int, bitrate: int | dict[int, int] = DEFAULT_BITRATE) -> DataFrame:
    """(channel, bucket, t_s, load) with every bucket of every channel; errors and reassembled frames take no part.

    bitrate is one for all channels, or one for each, with the default for others. A window without a length has loads of 0.
    """
    width = max(t1 - t0, 0) / buckets / 1e9
    sent = frames.where(F.col("flags").bitwiseAND(F.lit(schema.ERROR | schema.REASSEMBLED)) == 0).where(F.col("ts_ns").between(t0, t1))
    grid = frames.select("channel").distinct().select("channel", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))).alias("bucket"))
    middle = ((F.col("bucket") + 0.5) * width).alias("t_s")
    if not width:
        return grid.select("channel", "bucket", middle, F.lit(0.0).alias("load"))
    bits = sent.groupBy("channel", ff.bucket_of(F.col("ts_ns"), t0, t1, buckets).alias("bucket")).agg(F.sum(ff.frame_bits(F.col("id"), F.col("flags"), F.col("len"))).alias("bits"))
    own = bitrate if isinstance(bitrate, dict) else {}
    rate = F.coalesce(F.create_map(*[F.lit(x) for pair in own.items() for x in pair])[F.col("channel")], F.lit(DEFAULT_BITRATE)) if own else F.lit(bitrate if isinstance(bitrate, int) else DEFAULT_BITRATE)
    load = F.least(F.coalesce("bits", F.lit(0)) / (rate * F.lit(width)), F.lit(1.0))
    return grid.join(bits, ["channel", "bucket"], "left").select("channel", "bucket", middle, load.alias("load"))


#: An overview has a bucket for each so many seconds, and no more buckets than these.
OVERVIEW_S, OVERVIEW_MOST = 0.1, 600


def overview_buckets(duration_ns: int) -> int:
    return min(max(int(duration_ns / 1e9 / OVERVIEW_S), 1), OVERVIEW_MOST)


def overview_load(frames: DataFrame, bitrate: int | dict[int, int] = DEFAULT_BITRATE) -> DataFrame:
    """Mean and peak load of each channel over the whole log, cut as an overview cuts it."""
    ends = frames.agg(F.min("ts_ns").alias("first"), F.max("ts_ns").alias("last")).first()
    first, last = ends["first"] or 0, ends["last"] or 0
    return load_overview(bus_load(frames, first, last, overview_buckets(last - first), bitrate))


def total_load(load: DataFrame) -> DataFrame:
    """Load over all channels of each bucket."""
    return load.groupBy("bucket").agg(F.sum("load").alias("load"))


def load_overview(load: DataFrame) -> DataFrame:
    """Mean and peak load of each channel."""
    return load.groupBy("channel").agg(F.avg("load").alias("mean_load"), F.max("load").alias("peak_load"))


def checksum_share(frames: DataFrame) -> DataFrame:
    """Per ID, the share of full payloads whose last byte is the sum of the others modulo 256."""
    data = ff.payload(frames)
    size = data.length()
    total = F.aggregate(F.sequence(F.lit(0), size - 2), F.lit(0).cast("long"), lambda a, i: a + data.byte(i)) % 256
    rows = frames.where(size >= 2).select("key", size.alias("size"), (total == data.byte(size - 1)).alias("ok"))
    return rows.groupBy("key", "size").agg(F.count(F.lit(1)).alias("frames"), F.count_if("ok").alias("matching"))


def byte_histogram(frames: DataFrame) -> DataFrame:
    """(key, byte, value, frames) of the data payloads; a number that is missing in an array counts nowhere."""
    bytes_ = F.posexplode(ff.payload(frames).numbers()).alias("byte", "value")
    return frames.where("kind in ('data', 'reassembled')").select("key", bytes_).where("value is not null").groupBy("key", "byte", "value").agg(F.count(F.lit(1)).alias("frames"))


def ranked_ids(summary: DataFrame, by: str, descending: bool = False) -> DataFrame:
    """The ID table in the order of a column: nulls last either way, ties by channel and ID."""
    order: Column = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    return summary.orderBy(order, "channel", "id")


def frame_rate(frames: DataFrame, window_s: int = 2, slide_s: int = 1) -> DataFrame:
    """Frames per second in sliding windows; works on a stream as on a table."""
    at = F.timestamp_micros(ff.micros(F.col("ts_ns")))
    return frames.groupBy(F.window(at, f"{window_s} seconds", f"{slide_s} seconds").alias("w")).agg((F.count(F.lit(1)) / window_s).alias("rate")).select(F.unix_micros("w.start").alias("start_us"), "rate")


def id_rates(frames: DataFrame) -> DataFrame:
    """(key, channel, id, count, rate): frames per second of the log's duration; null in a log without one."""
    span = frames.agg(((F.max("ts_ns") - F.min("ts_ns")) / F.lit(1e9)).alias("s")).first().s
    rate = F.col("count") / F.lit(span) if span else F.lit(None).cast("double")
    return frames.groupBy("key", "channel", "id").agg(F.count(F.lit(1)).alias("count")).withColumn("rate", rate)


def with_baseline(frames: DataFrame, window: tuple[int, int], baseline: tuple[int, int]) -> DataFrame:
    """bit_flips of a window with `background`: whether the bit also changes in the baseline's window."""
    back = bit_flips(frames, *baseline).select("key", "byte", "bit", (F.col("flips") > 0).alias("background"))
    return bit_flips(frames, *window).join(back, ["key", "byte", "bit"], "left").withColumn("background", F.coalesce("background", F.lit(False)))


def heat_step(changes: Column, pairs: Column, steps: int = 6) -> Column:
    """The step (0 to steps - 1) of a change rate on a logarithmic scale of four decades."""
    rate = changes / F.greatest(pairs, F.lit(1))
    share = F.when(rate > 0, F.least(F.greatest((F.log10(rate) + 4) / 4, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return F.least(F.floor(share * steps), F.lit(steps - 1)).cast("int")


def bit_history(frames: DataFrame, key: int, t0: int, t1: int, most: int, first_byte: int = 0, last_byte: int = 7) -> DataFrame:
    """(seq, ts_ns, bits): the last frames of an ID in a window, oldest first, with the bits of some bytes as text, highest first.

    Bytes past a payload's end show as blanks. A top-k by time, so no order of the whole ID is made.
    """
    rows = frames.where((F.col("key") == key) & F.col("ts_ns").between(t0, t1)).orderBy(F.desc("ts_ns"), F.desc("seq")).limit(most)
    lane = lambda i: F.coalesce(F.lpad(F.bin(ff.payload(frames).byte(i)), 8, "0"), F.lit(" " * 8))
    return rows.select("seq", "ts_ns", F.concat(*[lane(i) for i in range(first_byte, last_byte + 1)]).alias("bits")).orderBy("ts_ns", "seq")
