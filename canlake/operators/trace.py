"""Filtered traces: predicates on frames, pages of rows, and lookups by time."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from canlake.functions import frames as ff
from canlake.operators.history import Spans, in_order, place, spans_of, with_index, with_previous

#: Bytes of a payload that a page shows, and compares with the previous frame.
SHOWN = 64
#: What a byte past the end of a payload reads as.
ABSENT = 0xFFFF


@dataclass(frozen=True)
class ByteEquals:
    byte: int
    value: int


@dataclass(frozen=True)
class BitIs:
    byte: int
    bit: int
    set: bool


@dataclass(frozen=True)
class Changes:
    """Some byte differs from the previous frame of the same ID and kind, over the bytes that both have."""


@dataclass(frozen=True)
class FrameFilter:
    """A conjunction; None restricts nothing, and an empty list matches nothing. Data rules are joined by all or by any."""

    channels: list[int] | None = None
    keys: list[int] | None = None
    kinds: list[str] | None = None
    rules: list = field(default_factory=list)
    match_all: bool = True
    t0_ns: int | None = None
    t1_ns: int | None = None


def _member(column: str, values: list | None) -> Column:
    return F.lit(True) if values is None else F.col(column).isin(values) if values else F.lit(False)


def changed_places(data: ff.Payload, before: ff.Payload) -> Column:
    """Places of the common bytes that differ, among the first SHOWN."""
    common = data.common(before)
    places = F.when(common > 0, F.sequence(F.lit(0), F.least(common, F.lit(SHOWN)) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: data.byte(i) != before.byte(i))


def _any_change(data: ff.Payload, before: ff.Payload) -> Column:
    common = data.common(before)
    return F.coalesce((common > 0) & (data.start(common) != before.start(common)), F.lit(False))


def _rule(rule: object, rows: DataFrame) -> Column:
    data = ff.payload(rows)
    if isinstance(rule, ByteEquals):
        return F.coalesce(data.byte(rule.byte) == rule.value, F.lit(False))
    if isinstance(rule, BitIs):
        if not 0 <= rule.bit <= 7:
            raise ValueError("a bit is 0 to 7")
        return F.coalesce(F.getbit(data.byte(rule.byte), F.lit(rule.bit)) == int(rule.set), F.lit(False))
    return _any_change(data, ff.payload(rows, "before"))


def filtered(frames: DataFrame, spec: FrameFilter) -> DataFrame:
    """The frames that match. Previous frames are looked up only for a Changes rule, and before the time window applies."""
    kept = frames.where(_member("channel", spec.channels) & _member("key", spec.keys) & _member("kind", spec.kinds))
    columns = frames.columns
    if any(isinstance(r, Changes) for r in spec.rules):
        kept = with_previous(kept, ["key", "kind"], {"data": "before"})
    if spec.t0_ns is not None:
        kept = kept.where(F.col("ts_ns") >= spec.t0_ns)
    if spec.t1_ns is not None:
        kept = kept.where(F.col("ts_ns") <= spec.t1_ns)
    if spec.rules:
        kept = kept.where(reduce(lambda a, b: a & b if spec.match_all else a | b, [_rule(r, kept) for r in spec.rules]))
    return kept.select(*columns)


def changed_mask(data: ff.Payload, before: ff.Payload) -> Column:
    """A long whose bit i is set if byte i differs; bit 63 is the sign."""
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    return F.aggregate(changed_places(data, before), F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(bit(i)))


def page(frames: DataFrame, start: int, count: int, key: int | None = None, spans: Spans | None = None) -> DataFrame:
    """Rows [start, start + count) in time order, with seconds from the first frame and the mask of changed bytes.

    Frames are counted by span first; only the spans that hold the rows are ordered, and payloads before them are only
    looked at for the last one of each ID and kind. Who turns many pages passes the log's spans, found once.
    """
    rows = frames if key is None else frames.where(F.col("key") == key)
    spans = spans or spans_of(rows.select("ts_ns", "seq"))
    spanned = rows.withColumn("_span", spans.of())
    sizes = spanned.groupBy("_span").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy("_span"))  # over a row for each span
    near = sizes.select("_span", "n", (upto - F.col("n")).alias("first")).where((F.col("first") < start + count) & (F.col("first") + F.col("n") > start))
    bounds = near.agg(F.min("_span").alias("low"), F.max("_span").alias("high"), F.min("first").alias("first")).first()
    origin = frames.agg(F.min("ts_ns")).first()[0]
    if bounds.low is None:
        bounds = Row(low=0, high=-1, first=0)
    inside = spanned.where(F.col("_span").between(bounds.low, bounds.high)).drop("_span")
    last = frames.where(spans.before(bounds.low)).groupBy(F.col("key").alias("_key"), F.col("kind").alias("_kind")).agg(F.max_by("data", place()).alias("earlier"))
    if key is not None:
        last = last.where(F.col("_key") == key)
    same = F.col("key").eqNullSafe(F.col("_key")) & F.col("kind").eqNullSafe(F.col("_kind"))
    followed = with_previous(inside, ["key", "kind"], {"data": "near"}, spans=spans).join(last, same, "left")
    first_one = F.row_number().over(Window.partitionBy("key", "kind").orderBy(*in_order())) == 1
    followed = followed.withColumn("before", F.when(first_one, F.col("earlier")).otherwise(F.col("near")))
    chosen = with_index(followed, spans=spans).withColumn("index", F.col("index") + F.lit(bounds.first)).where(F.col("index").between(start, start + count - 1))
    # the mask comes first: beside a new column named data, its lambdas would read that one
    data = ff.payload(chosen)
    shown = chosen.withColumn("changed", changed_mask(data, ff.payload(chosen, "before")))
    return shown.select("index", "seq", ((F.col("ts_ns") - F.lit(origin)) / F.lit(1e9)).alias("t"), "key", data.length().cast("long").alias("full_len"), data.hex(SHOWN).alias("data"), "changed")


def changed_masks(frames: DataFrame) -> DataFrame:
    """(seq, changed) of all frames: bit i is set if byte i differs from the previous frame of the ID and kind."""
    rows = with_previous(frames, ["key", "kind"], {"data": "before"})
    return rows.select("seq", changed_mask(ff.payload(rows), ff.payload(rows, "before")).alias("changed"))


def matched_bytes(frames: DataFrame, rules: list) -> DataFrame:
    """(seq, bytes): the payload bytes of each frame that its data rules matched, in order, each once."""
    rows = with_previous(frames, ["key", "kind"], {"data": "before"}) if any(isinstance(r, Changes) for r in rules) else frames

    def places(rule: object) -> Column:
        if isinstance(rule, Changes):
            return changed_places(ff.payload(rows), ff.payload(rows, "before"))
        return F.when(_rule(rule, rows), F.array(F.lit(rule.byte))).otherwise(F.array().cast("array<int>"))

    return rows.select("seq", F.array_sort(F.array_distinct(F.concat(F.array().cast("array<int>"), *map(places, rules)))).alias("bytes"))


def with_selected(spec: FrameFilter, selected: int | None) -> FrameFilter:
    """A filter narrowed to one ID, if one is selected: nothing matches if the filter's own keys leave it out."""
    if selected is None:
        return spec
    return replace(spec, keys=[selected] if spec.keys is None or selected in spec.keys else [])


def row_bytes(frames: DataFrame, first: int, count: int) -> DataFrame:
    """(seq, byte, value) of bytes [first, first + count) of each frame; ABSENT past the end."""
    places = F.explode(F.sequence(F.lit(first), F.lit(first + count - 1))).alias("byte")
    return frames.select("seq", "data", places).select("seq", F.col("byte").cast("long"), F.coalesce(ff.payload(frames).byte(F.col("byte")), F.lit(ABSENT)).cast("long").alias("value"))


def row_at_time(frames: DataFrame, times_ns: list[int]) -> DataFrame:
    """(t_ns, row): for each time the first row at or after it, or the last row. One pass of counts, without row numbers."""
    counts = frames.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("ts_ns") < t).alias(f"c{i}") for i, t in enumerate(times_ns)])
    rows = F.array(*[F.struct(F.lit(t).cast("long").alias("t_ns"), F.least(F.col(f"c{i}"), F.col("n") - 1).alias("row")) for i, t in enumerate(times_ns)])
    return counts.select(F.inline(rows))


def count_between(frames: DataFrame, t0_ns: int, t1_ns: int) -> DataFrame:
    return frames.where(F.col("ts_ns").between(t0_ns, t1_ns)).groupBy("key").agg(F.count(F.lit(1)).alias("rows"))


def frame_at(frames: DataFrame, t_ns: int) -> DataFrame:
    """Per ID the last frame at or before a time, or else the first."""
    order = F.struct("ts_ns", "seq")
    before = F.col("ts_ns") <= t_ns
    data = F.struct("ts_ns", "seq", F.hex("data").alias("data"))
    last, first = F.max_by(F.when(before, data), F.when(before, order)), F.min_by(data, order)
    return frames.groupBy("key").agg(F.coalesce(last, first).alias("f")).select("key", "f.ts_ns", "f.seq", "f.data")


def search(summary: DataFrame, text: str, names: DataFrame | None = None) -> DataFrame:
    """IDs whose label has the text, in any case, or whose message or one of its signals has it.

    names: (channel, id, message, signals), as decode.names_of gives them.
    """
    has = F.lower(ff.id_label(F.col("id"))).contains(text.lower())
    if names is None:
        return summary.where(has)
    both = summary.join(names.withColumnsRenamed({"message": "_message", "signals": "_signals"}), ["channel", "id"], "left")
    named = F.lower("_message").contains(text.lower()) | F.exists("_signals", lambda x: F.lower(x).contains(text.lower()))
    return both.where(has | F.coalesce(named, F.lit(False))).drop("_message", "_signals")


def trimmed(frames: DataFrame, cutoff_ns: int) -> DataFrame:
    """Without the leading frames (in order of arrival, seq) before the cutoff: all from the first that reaches it."""
    first = frames.where(F.col("ts_ns") >= cutoff_ns).agg(F.min("seq")).first()[0]
    return frames.where(F.col("seq") >= F.lit(first))
