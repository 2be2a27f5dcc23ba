"""Search for signals: which 8- and 16-bit ranges of which IDs move as the user says they do in some windows of time."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canlake.functions import bits
from canlake.functions.frames import payload
from canlake.operators.history import with_previous

INCREASES, DECREASES, CHANGES, CONSTANT = "increases", "decreases", "changes", "constant"


@dataclass(frozen=True)
class Rule:
    """What a signal does from t0 to t1; None is the log's own end, where frames without a time stand last."""

    t0_ns: int | None
    t1_ns: int | None
    says: str

    def holds(self, then_ns: Column, ts_ns: Column) -> Column:
        """Whether the window has both frames of a pair."""
        return (F.lit(True) if self.t0_ns is None else then_ns >= self.t0_ns) & (F.lit(True) if self.t1_ns is None else ts_ns <= self.t1_ns)


def candidates(length: int) -> list[tuple[int, int, str]]:
    """(start, size, order) of all 8- and 16-bit ranges that fit a payload; an 8-bit range in whole bytes stands once."""
    out = []
    for size in (8, 16):
        for order in (bits.LITTLE, bits.BIG):
            for start in range(8 * length):
                if order == bits.BIG and size == 8 and start % 8 == 7:
                    continue
                if order == bits.LITTLE and start + size > 8 * length:
                    continue
                if max(b for b, _ in bits.positions(start, size, order)) < length:
                    out.append((start, size, order))
    return out


#: Payload bytes of the longest frame that is searched, as in CAN FD.
MAX_PAYLOAD = 64


def _ranges(spark: SparkSession, length: int, sizes: tuple[int, ...], orders: tuple[str, ...]) -> DataFrame:
    """(range, start, size, order, last, byte, big, shift, mask): each candidate's last byte, and where its bits lie in three bytes from `byte` on."""
    rows = []
    for n, (start, size, order) in enumerate(candidates(length)):
        if size in sizes and order in orders:
            first = start if order == bits.LITTLE else start // 8 * 8 + 7 - start % 8
            shift = first % 8 if order == bits.LITTLE else 24 - first % 8 - size
            rows.append((n, start, size, order, max(b for b, _ in bits.positions(start, size, order)), first // 8, order == bits.BIG, shift, (1 << size) - 1))
    return spark.createDataFrame(rows, "range int, start long, size long, order string, last int, byte int, big boolean, shift int, mask int")


def _value(numbers: str) -> Column:
    """A candidate's bits in an array of payload bytes, or of numbers' low 24 bits: what passes a byte adds to the next place."""
    near = [F.coalesce(F.get(F.col(numbers), F.col("byte") + i), F.lit(0)) for i in range(3)]
    joined = lambda a, b, c: a + F.shiftleft(b.bitwiseAND(F.lit(0xFFFF)), 8) + F.shiftleft(c.bitwiseAND(F.lit(0xFF)), 16)
    word = F.when(F.col("big"), joined(*near[::-1])).otherwise(joined(*near))
    return F.call_function("shiftright", word, F.col("shift")).bitwiseAND(F.col("mask"))


def find_signal(frames: DataFrame, rules: list[Rule], length: int | None = None, keys: list[int] | None = None, sizes: tuple[int, ...] = (8, 16), orders: tuple[str, ...] = (bits.LITTLE, bits.BIG), limit: int | None = 50) -> DataFrame:
    """(key, start, size, order, score) of the best ranges whose steps fit all rules; all of them, in no order, without a limit.

    The ranges of an ID are those that fit its shortest frame (of MAX_PAYLOAD bytes at most). With `length`, they are those
    that fit so many bytes, and IDs with a shorter frame are left out. A pair of neighbouring frames meets the ranges of its
    ID's length from a small table, and all rules are counted in one aggregate. Payloads are bytes, or arrays of numbers.
    """
    shortest = frames.groupBy("key").agg(F.min(F.coalesce(payload(frames).length(), F.lit(0))).alias("least"))
    size_of = shortest.select("key", F.least("least", F.lit(MAX_PAYLOAD)).alias("least")) if length is None else shortest.where(F.col("least") >= length).select("key", F.lit(length).alias("least"))
    table = _ranges(frames.sparkSession, MAX_PAYLOAD if length is None else length, sizes, orders)
    fits = F.broadcast(table)  # of fixed size
    rows = frames.select("seq", "ts_ns", "key", "data")
    rows = rows.where(F.col("key").isin(keys)) if keys else rows.where(F.col("key").bitwiseAND(F.lit(1 << 29).cast("long")) == 0)
    rows = rows.join(size_of.where("least > 0"), "key")
    # a row for each length and range that fits it
    lengths = frames.sparkSession.range(1, MAX_PAYLOAD + 1).select(F.col("id").cast("int").alias("least")) if length is None else frames.sparkSession.range(1).select(F.lit(length).alias("least"))
    ranges = F.broadcast(lengths.join(fits, F.col("last") < F.col("least")).select("least", "range", "byte", "big", "shift", "mask"))

    # a pair counts for each rule whose window holds both of its frames, so the frames are paired, and meet the ranges, once
    starts, ends = [r.t0_ns for r in rules], [r.t1_ns for r in rules]
    rows = rows if None in starts else rows.where(F.col("ts_ns") >= min(starts))
    rows = rows if None in ends else rows.where(F.col("ts_ns") <= max(ends))
    paired = with_previous(rows, ["key"], {"data": "before", "ts_ns": "then_ns"}).where("before is not null")
    inside = [r.holds(F.col("then_ns"), F.col("ts_ns")) for r in rules]
    pairs = paired.where(reduce(lambda a, b: a | b, inside)).select("key", "least", payload(paired).numbers(24).alias("now"), payload(paired, "before").numbers(24).alias("then"), *[c.alias(f"in{n}") for n, c in enumerate(inside)])
    marks = [f"in{n}" for n in range(len(rules))]
    steps = pairs.join(ranges, "least").select("key", "range", *marks, (_value("now") - _value("then")).alias("step"))
    counts = [(F.count_if(m), F.count_if(F.col(m) & (F.col("step") > 0)), F.count_if(F.col(m) & (F.col("step") < 0))) for m in marks]
    sums = steps.groupBy("key", "range").agg(*[c.alias(f"{name}{n}") for n, group in enumerate(counts) for name, c in zip(("n", "up", "down"), group)])

    def score(n: int, rule: Rule) -> Column:
        up, down, count = F.col(f"up{n}"), F.col(f"down{n}"), F.col(f"n{n}")
        moves = up + down
        return {INCREASES: F.greatest(up - down, F.lit(0)) / (moves + 1), DECREASES: F.greatest(down - up, F.lit(0)) / (moves + 1), CHANGES: moves / F.nullif(count, F.lit(0)), CONSTANT: 1 - moves / F.nullif(count, F.lit(0))}[rule.says]

    total = reduce(lambda a, b: a * b, [score(n, rule) for n, rule in enumerate(rules)])
    met = reduce(lambda a, b: a & b, [F.col(f"n{n}") > 0 for n in range(len(rules))])
    best = sums.where(met).select("key", "range", total.alias("score")).where("score > 0").join(fits, "range").select("key", "start", "size", "order", "score", "range")
    return (best if limit is None else best.orderBy(F.desc("score"), "size", "key", "range").limit(limit)).drop("range")
