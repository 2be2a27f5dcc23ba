"""Mixing sources to target weights by subset-sum budget fitting.

A source's target is a number of words. Whole passes over the source come first; the rest of the budget, less than one
pass, is fitted exactly: documents are counted by length, every length gives its proportional number, and the remainder
is filled by a bounded-knapsack dynamic programme over the counts left, whose totals are the bits of one number. Which documents of a length are taken is
decided by a seeded hash of their ids.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canlake.llm.common import WORD, on, ranked, written

#: No document is taken more often than this.
PASSES = 3
#: The dynamic programme fits the last words of a budget, at first as many as so many of the longest documents have.
ROOM = 4
SEED = 20


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _reach(items: Sequence[tuple[int, int]], limit: int, goal: int | None = None) -> tuple[int, int]:
    """Totals of subsets of the items up to the limit, a bit for each, and how many items it took to reach the goal."""
    mask, reached = (1 << (limit + 1)) - 1, 1
    for i, (length, take) in enumerate(items):
        if goal is not None and reached >> goal & 1:
            return reached, i
        reached |= (reached << (length * take)) & mask
    return reached, len(items)


def _recover(items: Sequence[tuple[int, int]], total: int, out: dict[int, int]) -> None:
    """Adds to out the counts by length of a subset of the items with this total: the first half's total is where the sums of
    the first half from below meet those of the second from above."""
    if not total:
        return
    if len(items) == 1:
        out[items[0][0]] = out.get(items[0][0], 0) + items[0][1]
        return
    half = len(items) // 2
    from_above = 1 << total
    for length, take in items[half:]:
        from_above |= from_above >> (length * take)
    met = _reach(items[:half], total)[0] & from_above
    first = (met & -met).bit_length() - 1
    _recover(items[:half], first, out)
    _recover(items[half:], total - first, out)


def knapsack(lengths: Sequence[int], left: Sequence[int], budget: int) -> dict[int, int]:
    """Counts by length, at most `left` of each, whose total is nearest to `budget`; of two as near, the smaller."""
    most = 2 * budget  # nothing is nearer than 0 is
    items: list[tuple[int, int]] = []
    for length, n in zip(lengths, left):
        n, power = min(n, most // length), 1
        while n > 0:  # 1, 2, 4 and so on of a length make every count of it
            items.append((length, min(power, n)))
            n, power = n - min(power, n), 2 * power
    limit = min(most, budget + max(lengths, default=0))
    reached, used = _reach(items, limit, budget)
    below = (reached & ((1 << (budget + 1)) - 1)).bit_length() - 1
    above = reached >> (budget + 1)
    over = (above & -above).bit_length() if above else limit + 1
    taken: dict[int, int] = {}
    _recover(items[:used], below if budget - below <= over else budget + over, taken)
    return taken


def fit_counts(lengths: Sequence[int], counts: Sequence[int], budget: int, room: int = ROOM) -> list[int]:
    """How many documents of each length (all above 0) to take so that their words are as near to the budget as can be.

    All but the last few documents' worth of the budget (`room` times the longest) is shared by length in proportion; the
    dynamic programme fills the rest. If it misses the budget by more than the lengths' common divisor explains, it gets
    four times the room, up to the whole budget, where its answer is the nearest of all subsets.
    """
    total = sum(a * b for a, b in zip(lengths, counts))
    if budget >= total:
        return list(counts)
    divisor = math.gcd(*lengths)
    unavoidable = min(budget % divisor, divisor - budget % divisor)
    space = room * max(lengths)
    while True:
        shared = max(budget - space, 0)
        taken = [c * shared // total for c in counts]
        rest = budget - sum(a * b for a, b in zip(lengths, taken))
        by_fraction = sorted(range(len(lengths)), key=lambda i: (-(counts[i] * shared % total), -lengths[i])) if shared else list(range(len(lengths)))
        for i in by_fraction:
            if rest > space and counts[i] > taken[i]:
                taken[i] += 1
                rest -= lengths[i]
        small = [i for i in by_fraction if lengths[i] < 2 * rest and counts[i] > taken[i]]
        extra = knapsack([lengths[i] for i in small], [counts[i] - taken[i] for i in small], rest)
        missed = abs(rest - sum(a * b for a, b in extra.items()))
        if missed <= unavoidable or not shared:
            return [t + extra.get(length, 0) for t, length in zip(taken, lengths)]
        space *= 4


def targets(sizes: DataFrame, passes: int = PASSES) -> DataFrame:
    """(source, source_size, target) of a table (source, source_size): weights 1, 2, 3, repeating by code point, null last.

    Targets share the total by weight and stop at `passes` times their source; the excess goes to the others by weight.
    The sources that stop are those with the smallest size for their weight, so running sums in that order find them.
    """
    name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", ((F.row_number().over(name) - 1) % 3 + 1).cast("double"))
    cap = F.col("source_size").cast("double") * passes
    ratio = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(ratio), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(ratio), F.lit(0.0)))
    leveled = weighed.withColumn("level", level).withColumn("fits", level * F.col("weight") <= cap)
    # the first source that doesn't stop sets the level of all that follow, and later ones only come out lower
    common = F.max(F.when(F.col("level") * F.col("weight") <= cap, F.col("level"))).over(every)
    leveled = weighed.withColumn("level", level).withColumn("common", F.coalesce(common, F.lit(0.0)))
    return leveled.select("source", "source_size", F.least(cap, F.col("common") * F.col("weight")).alias("target"))


def _plan(key: tuple, lengths: pd.DataFrame) -> pd.DataFrame:
    size, target = int(lengths.source_size.iloc[0]), float(lengths.target.iloc[0])
    passes = min(int(target // size), PASSES) if size else 0
    lengths = lengths.sort_values("size")
    counted = lengths[lengths["size"] > 0]
    budget = int(round(target)) - passes * size if passes < PASSES else 0
    extra = fit_counts([int(x) for x in counted["size"]], [int(x) for x in counted.n], max(budget, 0))
    return counted.assign(_passes=passes, _extra=extra)[["source", "size", "_passes", "_extra"]]


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", size: str = "size", seed: int = SEED) -> DataFrame:
    """docs with source_size, target and `times`, how often each row is taken (0 to 3).

    Rows of size 0 are never taken; null sources form the last source; equal rows are rows of their own; ids may be null.
    Columns named like an output are replaced. One task sees a source's distinct lengths, at most about the square root
    of twice its words, never its documents.
    """
    docs = docs.drop("source_size", "target", "times")
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("long").alias("source_size"))
    goals = written(targets(sizes), "targets")
    lengths = docs.groupBy(F.col(source).alias("source"), F.col(size).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    counted = lengths.alias("l").join(goals.alias("g"), on(lengths, goals, ["source"])).select("l.source", "l.size", "l.n", "g.source_size", "g.target")
    plan = written(counted.groupBy("source").applyInPandas(_plan, "source string, size long, _passes long, _extra long"), "plan")
    plan = plan.withColumnsRenamed({"source": source, "size": size})
    lot = F.xxhash64(F.lit(seed), F.col(doc_id))
    placed = ranked(docs.withColumn("_lot", lot), [source, size], F.pmod(lot, F.lit(256)).cast("int"), ["_lot", doc_id], "_place", plan)
    times = F.coalesce(F.col("_passes") + (F.col("_place") < F.col("_extra")).cast("long"), F.lit(0).cast("long"))
    taken = placed.withColumn("times", times).drop("_lot", "_place", "_passes", "_extra")
    return taken.alias("t").join(goals.alias("g"), taken[source].eqNullSafe(goals["source"])).select("t.*", "g.source_size", "g.target")
