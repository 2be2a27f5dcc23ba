"""Filter interaction audit: what each filter removes in every order of applying them, by forward-backward path counting.

A document's failures are a set of filters. The states of the audit are the subsets of filters applied so far, its edges
add one filter. The number of orders that reach a state (forward) and that lead on from it to the whole set (backward)
are counted over the lattice, so an edge is a step of forward * backward orders. Documents are counted by set of
failures once; each edge gets its removals from these counts. Shapley sums are the removals of a filter's edges weighed
by their orders, and the steps of every single order are read off the same edges.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canlake.llm.common import written

#: The lattice has 2^n states and n! orders of n filters; more filters than this are refused.
MOST_FILTERS = 8


def path_counts(n: int) -> tuple[list[int], list[int]]:
    """Orders that reach each subset of n filters (a bit for each), and orders that lead from it to the whole set."""
    forward, backward = [0] * (1 << n), [0] * (1 << n)
    forward[0] = backward[-1] = 1
    for state in range(1, 1 << n):
        forward[state] = sum(forward[state ^ (1 << f)] for f in range(n) if state >> f & 1)
    for state in reversed(range((1 << n) - 1)):
        backward[state] = sum(backward[state | (1 << f)] for f in range(n) if not state >> f & 1)
    return forward, backward


def edge_table(n: int) -> list[tuple[int, int, int]]:
    """(state before, filter, orders through it) of every edge of the lattice."""
    forward, backward = path_counts(n)
    return [(state, f, forward[state] * backward[state | (1 << f)]) for state in range(1 << n) for f in range(n) if not state >> f & 1]


def repeats_smaller(rows: DataFrame, doc_id: str, digest: str, out: str) -> DataFrame:
    """rows with `out`: whether a row of a smaller id has the same digest. A null id is neither smaller nor larger.

    Ids meet the smallest id of their digest by (digest, id), so the copies of one text don't meet in one task.
    """
    first = rows.groupBy(F.col(digest).alias("_digest")).agg(F.min(doc_id).alias("_first"))
    met = rows.alias("r").join(first.alias("f"), (F.col(f"r.{digest}") == F.col("f._digest")) & (F.col(f"r.{doc_id}") == F.col("f._first")), "left")
    return met.select("r.*", (F.col("f._first").isNull() & F.col(f"r.{doc_id}").isNotNull()).alias(out))


def failure_sets(docs: DataFrame, conditions: Mapping[str, Column], labels: DataFrame | None = None, duplicate: str | None = None, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, failed, good, toxic, n): documents counted by part, set of failed filters (a bit for each) and labels.

    `conditions` are failures told by a document's own columns; `duplicate` names a further filter, last in the set, that
    fails documents whose text a smaller id has, a null text being empty. `labels` has (doc_id, quality, toxic); a document
    is good or toxic if any of its labels says 1, and neither without a label. A null part is the empty string; equal rows
    and equal ids are documents of their own; a condition that is null is no failure. Other columns are not read.
    """
    failed = F.lit(0)
    for bit, condition in enumerate(conditions.values()):
        failed = failed.bitwiseOR(F.when(condition, 1 << bit).otherwise(0))
    plain = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), failed.alias("failed"),
        F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("digest"),
    )
    rows = plain.groupBy(*plain.columns).agg(F.count(F.lit(1)).alias("n"))
    if duplicate:
        rows = repeats_smaller(written(rows, "failures"), "doc_id", "digest", "repeats")
        rows = rows.withColumn("failed", F.col("failed").bitwiseOR(F.when(F.col("repeats"), 1 << len(conditions)).otherwise(0)))
    if labels is None:
        rows = rows.withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    else:
        told = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
        rows = rows.join(told, "doc_id", "left").withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("good", "toxic")})
    return rows.groupBy("part", "failed", "good", "toxic").agg(F.sum("n").alias("n"))


def lattice(sets: DataFrame, n: int) -> DataFrame:
    """(part, state, filter, orders, kept, removed, redundant, unique_fails, good_lost, toxic_lost) of every part and edge."""
    if not 0 < n <= MOST_FILTERS:
        raise ValueError(f"the audit takes 1 to {MOST_FILTERS} filters")
    known = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(f).alias("filter"), F.lit(1 << f).alias("bit"), F.lit(w).cast("long").alias("orders")) for s, f, w in edge_table(n)])
    cells = sets.select("*", F.explode(known).alias("e")).select("*", "e.*")
    fails, passed = F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("failed").bitwiseAND(F.col("state")) == 0
    counts = {
        "kept": passed & ~fails, "removed": passed & fails, "redundant": ~passed & fails, "unique_fails": F.col("failed") == F.col("bit"),
        "good_lost": passed & fails & F.col("good"), "toxic_lost": passed & fails & F.col("toxic"),
    }
    return cells.groupBy("part", "state", "filter", "orders").agg(*[F.sum(F.when(c, F.col("n")).otherwise(0)).alias(k) for k, c in counts.items()])


def orders_table(spark: SparkSession, names: list[str]) -> DataFrame:
    """(filter_order, step, state, filter) of every order of the filters: n! * n rows, whatever the table of documents."""
    rows = []
    for order in permutations(range(len(names))):
        state = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(names[i] for i in order), step, state, f))
            state |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, state int, filter int")


def audit(sets: DataFrame, names: list[str]) -> DataFrame:
    """One row for each part, order of the filters and step: the edge's counts and its filter's Shapley sum over all orders."""
    edges = written(lattice(sets, len(names)), "edges")  # 2^n * n / 2 rows a part
    shares = edges.groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    both = edges.join(shares.withColumnRenamed("part", "of"), (F.col("part") == F.col("of")) & (edges["filter"] == shares["filter"])).drop(shares["filter"], "of")
    steps = orders_table(sets.sparkSession, names)
    return both.join(F.broadcast(steps), ["state", "filter"]).drop("state", "filter", "orders")
