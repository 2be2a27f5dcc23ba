"""Order within a log at scale: previous rows, running counts and row numbers without a task that holds a whole group.

A log is cut into spans of about equal numbers of rows, however densely they lie in time. Rows are windowed within
(group, span); a table with one row for each group and span carries the rest over from earlier spans. A log that fits
into one span needs no cuts and no such table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import ceil
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canlake.schema import ORDER

#: Rows of a span, about; and the estimated bytes of a table up to which it is one span without a look at its rows.
ROWS, SMALL = 1_000_000, 16 << 20
#: Cuts at most, a bound for what the driver sees; beyond them spans grow.
MOST_CUTS = 4096
_LOWEST = -(1 << 63)


@dataclass(frozen=True)
class Spans:
    """Where a log is cut: each (ts_ns, seq) begins a span. Span 0 is before the first cut."""

    cuts: tuple[tuple[int, int], ...] = ()

    def of(self, ts_ns: str = "ts_ns", seq: str = "seq") -> Column:
        """The number of a row's span."""
        if not self.cuts:
            return F.lit(0)
        ts, by_time = F.col(ts_ns), all(s == _LOWEST for _, s in self.cuts)

        def passed(t: Column, s: Column) -> Column:
            return F.coalesce(ts >= t if by_time else (ts > t) | ((ts == t) & (F.col(seq) >= s)), F.lit(True))  # what has no time comes last

        if len(self.cuts) <= 32:
            return reduce(add, [passed(F.lit(t), F.lit(s)).cast("int") for t, s in self.cuts])
        times, seqs = (F.lit([c[i] for c in self.cuts]) for i in (0, 1))
        steps = F.lit([1 << i for i in reversed(range(len(self.cuts).bit_length()))])
        fits = lambda n: n <= len(self.cuts)
        further = lambda at, step: F.when(fits(at + step) & passed(F.get(times, at + step - 1), F.get(seqs, at + step - 1)), at + step).otherwise(at)
        return F.aggregate(steps, F.lit(0), further)

    def by_time(self) -> Spans:
        """The same without cuts inside one time."""
        return Spans(tuple(sorted({(t, _LOWEST) for t, _ in self.cuts})))

    def before(self, span: int) -> Column:
        """Rows of the spans before this one."""
        if span <= 0:
            return F.lit(False)
        t, s = self.cuts[span - 1]
        return (F.col("ts_ns") < t) | ((F.col("ts_ns") == t) & (F.col("seq") < s))


def spans_of(rows: DataFrame, per_span: int | None = None) -> Spans:
    """Cuts for about per_span rows a span, from one pass over times; a table that is known to be small isn't looked at.

    Times come from a sketch of quantiles. Where more than a span's rows have one time, that time is cut by seq.
    """
    per_span = per_span or ROWS
    if int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL:
        return Spans()
    shares = [i / MOST_CUTS for i in range(1, MOST_CUTS)]
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("ts_ns", shares, 8 * MOST_CUTS).alias("q")).first()
    wanted = min(ceil(found.n / per_span), MOST_CUTS)
    if wanted < 2:
        return Spans()
    times = [found.q[round(i * MOST_CUTS / wanted) - 1] for i in range(1, wanted)]
    cuts = {(t, _LOWEST) for t in times}
    dense = sorted({a for a, b in zip(times, times[1:]) if a == b})
    if dense:
        part = F.percentile_approx("seq", shares, 8 * MOST_CUTS).alias("q")
        for r in rows.where(F.col("ts_ns").isin(dense)).groupBy("ts_ns").agg(F.count(F.lit(1)).alias("n"), part).collect():  # at most a row a cut
            inside = min(ceil(r.n / per_span), MOST_CUTS)
            cuts |= {(r.ts_ns, r.q[round(i * MOST_CUTS / inside) - 1]) for i in range(1, inside)}
    return Spans(tuple(sorted(cuts)))


def in_order() -> list[Column]:
    """Time order; as in SQL, a row without a time comes last, and within a time one without a number."""
    return [F.col(c).asc_nulls_last() for c in ORDER]


def place() -> Column:
    """A row's place in time order, to be compared."""
    return F.struct(*[part for c in ORDER for part in (F.col(c).isNull(), F.col(c))])


def _matches(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def spanned(rows: DataFrame, spans: Spans | None = None, span_ns: int | None = None) -> tuple[DataFrame, bool]:
    """rows with `_span`, and whether there is only one: spans of a fixed time, given ones, or cuts by the rows' number."""
    if span_ns is not None:
        return rows.withColumn("_span", F.floor(F.col("ts_ns") / F.lit(span_ns))), False
    spans = spans or spans_of(rows)
    return rows.withColumn("_span", spans.of()), not spans.cuts


def with_previous(rows: DataFrame, by: list[str], values: dict[str, str], span_ns: int | None = None, spans: Spans | None = None) -> DataFrame:
    """rows with, for each value column, that of the previous row of the group under a new name; null at the first."""
    columns, (rows, single) = rows.columns, spanned(rows, spans, span_ns)
    packed = F.struct(*values)
    within = Window.partitionBy(*by, "_span").orderBy(*in_order())
    near = rows.withColumn("_near", F.lag(packed).over(within))
    if single:
        return near.select(*columns, *[F.col(f"_near.{v}").alias(name) for v, name in values.items()])
    last = rows.groupBy(*by, "_span").agg(F.max_by(packed, place()).alias("_last"))
    carried = last.withColumn("_carried", F.lag("_last").over(Window.partitionBy(*by).orderBy(F.col("_span").asc_nulls_last()))).drop("_last")
    near = near.withColumn("_first", F.row_number().over(within) == 1)
    both = near.alias("r").join(carried.alias("c"), _matches(near, carried, [*by, "_span"])).select("r.*", "c._carried")
    out = both.withColumn("_previous", F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_near")))
    return out.select(*columns, *[F.col(f"_previous.{v}").alias(name) for v, name in values.items()])


def with_index(rows: DataFrame, by: list[str] | None = None, name: str = "index", span_ns: int | None = None, spans: Spans | None = None) -> DataFrame:
    """rows with their number from 0 in their group (or the whole log), in time order."""
    by = by or []
    columns, (rows, single) = rows.columns, spanned(rows, spans, span_ns)
    keys = [*by, "_span"]
    numbered = rows.withColumn("_at", (F.row_number().over(Window.partitionBy(*keys).orderBy(*in_order())) - 1).cast("long"))
    if single:
        return numbered.select(*[c for c in columns if c != name], F.col("_at").alias(name))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.col("_span").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(upto), F.lit(0))).drop("_n")
    both = numbered.alias("r").join(starts.alias("s"), _matches(numbered, starts, keys)).select("r.*", "s._start")
    return both.withColumn(name, F.col("_start") + F.col("_at")).drop("_span", "_at", "_start")


def with_running_sum(rows: DataFrame, by: list[str], value: Column, name: str, span: int = 100_000, by_time: bool = False, spans: Spans | None = None) -> DataFrame:
    """rows with the sum of a value over this and all earlier rows of the group, in the order of seq, or of time."""
    order = in_order() if by_time else ["seq"]
    valued = rows.withColumn("_v", value)
    cut = spanned(valued, spans)[0] if by_time else valued.withColumn("_span", F.floor(F.col("seq") / span))
    keys = [*by, "_span"]
    sums = cut.groupBy(*keys).agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.col("_span").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = cut.withColumn("_here", F.sum("_v").over(within))
    both = near.alias("r").join(starts.alias("s"), _matches(near, starts, keys)).select("r.*", "s._start")
    return both.withColumn(name, F.col("_start") + F.col("_here")).drop("_v", "_span", "_here", "_start")
