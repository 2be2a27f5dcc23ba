"""Exact top-k inner products by norm buckets.

Vectors are grouped by length (buckets of a constant ratio), and each bucket is dealt into blocks of bounded size. A
query's k-th best product over a bounded set of the longest vectors is a lower bound for its threshold; bucket by
bucket it gives a local cosine threshold. A bucket that can't reach the threshold isn't sent the query at all. Within a
block the query takes coordinate pruning (ranges of the query's largest coordinates that the cosine threshold leaves)
where the local threshold is high, else length pruning (the prefix of vectors that are long enough). What is left is
verified by exact products.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canlake.llm.common import written

#: Ratio of lengths in a bucket; vectors and queries of a block; vectors that give the first thresholds.
RATIO, BLOCK, QUERY_BLOCK, SEEDS = 1.1, 32768, 4096, 2048
#: Slices of a dimension's vectors in which the longest are looked for.
SLICES = 64
#: Local cosine threshold from which coordinates are pruned, and how many of them.
COSINE, FOCUS = 0.6, 3
_SLACK = 1e-9


def finite(vector: Column) -> Column:
    """True for a vector that isn't null, empty of nulls, NaN and infinity."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, bad), F.lit(False))


def _products(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows of p with the columns of q (both whole numbers kept as doubles)."""
    most = float(np.abs(p).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(p.shape[1], 1)
    if most < 2.0**53:
        return (p @ q).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return whole(p) @ whole(q) if p.size and q.size else np.zeros((len(p), q.shape[1]), object)


def _matrix(rows: pd.DataFrame, dim: int) -> np.ndarray:
    return np.array(rows.vector.tolist(), np.float64).reshape(len(rows), dim)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to the smaller id."""
    if len(scores) > 8 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= floor)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def _search(key: tuple, queries: pd.DataFrame, vectors: pd.DataFrame, k: int) -> pd.DataFrame:
    out: list[pd.DataFrame] = []
    if len(queries) and len(vectors):
        vectors = vectors.sort_values(["norm", "vec_id"], ascending=[False, True])
        p, ids, norms = _matrix(vectors, key[0]), vectors.vec_id.to_numpy(), vectors.norm.to_numpy()
        rows, same = vectors.row.to_numpy(), queries.row.to_numpy()
        q_all, q_norm, floor = _matrix(queries, key[0]), queries.norm.to_numpy(), queries.floor.to_numpy()
        unit = p / np.where(norms > 0, norms, 1)[:, None]
        local = np.where(q_norm > 0, floor / np.where(q_norm * norms[0] > 0, q_norm * norms[0], 1), -np.inf)
        steep, flat = np.flatnonzero(local >= COSINE), np.flatnonzero(local < COSINE)
        for i in steep:  # coordinate pruning: |x_f - q_f t| <= sqrt((1 - t^2)(1 - q_f^2)) on the unit sphere
            if local[i] > 1 + _SLACK:
                continue
            t, q = min(local[i], 1.0), q_all[i] / q_norm[i]
            focus = np.argsort(-np.abs(q))[:FOCUS]
            spread = np.sqrt((1 - t * t) * np.maximum(1 - q[focus] ** 2, 0)) + _SLACK
            far = np.where(q[focus] > 0, q[focus] * t - spread, -q[focus] * t - spread)
            facing = unit[:, focus] * np.sign(q[focus])
            near = np.flatnonzero((facing >= far).all(axis=1) & (rows != same[i]))
            out.append(_take(queries.iloc[i], _products(p[near], q_all[i][:, None])[:, 0], ids[near], k))
        for first in range(0, len(flat), 256):
            part = flat[first : first + 256]
            need = np.where(np.isfinite(floor[part]) & (q_norm[part] > 0), floor[part] / np.where(q_norm[part] > 0, q_norm[part], 1), -np.inf)
            long_enough = len(norms) - np.searchsorted(norms[::-1], need * (1 - _SLACK), side="left")
            products = _products(p[: long_enough.max(initial=0)], q_all[part].T)
            for j, i in enumerate(part):
                own = rows[: long_enough[j]] != same[i]
                out.append(_take(queries.iloc[i], products[: long_enough[j], j][own], ids[: long_enough[j]][own], k))
    if out:
        return pd.concat(out)
    return pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("query", "int64"), ("query_id", "int64"), ("vec_id", "int64"), ("score", "int64"), ("beyond", "object"))})


def _beyond(score: int) -> bytes:
    """Bytes that order scores with one clamped value as they are: those within a long between the two kinds that pass it."""
    if -(2**63) <= score < 2**63:
        return b"m"
    digits = str(abs(score))
    text = f"{len(digits):05d}{digits}"
    return f"z{text}".encode() if score > 0 else f"a{text.translate(_COMPLEMENT)}".encode()


_COMPLEMENT = str.maketrans("0123456789", "9876543210")


def _take(query: pd.Series, scores: np.ndarray, ids: np.ndarray, k: int) -> pd.DataFrame:
    top = _best(scores, ids, k)
    exact = [int(s) for s in scores[top]]
    values = np.array([min(max(s, -(2**63)), 2**63 - 1) for s in exact], np.int64)
    return pd.DataFrame({"query": query.row, "query_id": query.query_id, "vec_id": ids[top], "score": values, "beyond": [_beyond(s) for s in exact]})


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest integer inner products of each query with all other rows.

    Components become floor(scale * x). Rows whose vector is null or holds null or non-finite components (before or after
    scaling), and rows without an id, take no part. A query meets only vectors of its own dimension. Equal rows are rows of their own: a
    query never meets itself but meets its copies. Scores that pass a long are clamped to it after they are ranked. Ties go
    to the smaller id.
    """
    scaled = F.transform(vector, lambda v: F.lit(float(scale)) * v.cast("double"))
    rows = vectors.where(finite(F.col(vector)) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), scaled.alias("scaled"), is_query.alias("is_query"))
    whole = F.transform("scaled", lambda v: F.when(F.abs(v) < 2.0**62, F.floor(v).cast("double")).otherwise(v))
    rows = rows.where(finite(F.col("scaled"))).withColumn("vector", whole).drop("scaled").withColumn("dim", F.size("vector"))
    rows = rows.withColumn("most", F.aggregate("vector", F.lit(0.0), lambda a, v: F.greatest(a, F.abs(v))))
    length = F.col("most") * F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, v: a + (v / F.col("most")) * (v / F.col("most"))))
    rows = rows.withColumn("norm", F.when(F.col("most") > 0, F.least(length, F.lit(1.7e308))).otherwise(0.0)).drop("most")
    rows = rows.withColumn("bucket", F.when(F.col("norm") > 0, F.floor(F.log("norm") / F.log(F.lit(RATIO)))).otherwise(-1000000).cast("int"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")

    # the longest vectors of each dimension, a bounded number, give each query a first lower bound of its k-th best product
    # slices by hash give their longest first, so only these and no vectors are sorted for a dimension at once
    by_length = rows.select("dim", "row", "norm").withColumn("slice", F.pmod(F.xxhash64("row", F.lit(2)), F.lit(SLICES)))
    for by in (["dim", "slice"], ["dim"]):
        longest = Window.partitionBy(*by).orderBy(F.desc("norm"), "row")
        by_length = by_length.withColumn("at", F.row_number().over(longest)).where(F.col("at") <= SEEDS).drop("at")
    seeds = written(rows.select("dim", "row", "vector").join(written(by_length.select(F.col("row").alias("seed")), "longest"), F.col("row") == F.col("seed"), "left_semi"), "seeds")
    queries = rows.where("is_query").select("row", F.col("vec_id").alias("query_id"), "dim", "vector", "norm")
    blocks = queries.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERY_BLOCK)).cast("int").alias("query_blocks"))
    queries = queries.join(F.broadcast(blocks), "dim").withColumn("query_block", F.pmod(F.xxhash64("row", F.lit(1)), F.col("query_blocks")).cast("int"))
    shown = seeds.join(F.broadcast(blocks), "dim").withColumn("query_block", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)))
    floored = written(
        queries.drop("query_blocks").groupBy("dim", "query_block").cogroup(shown.select("dim", "query_block", "row", "vector").groupBy("dim", "query_block"))
        .applyInPandas(partial(_floors, k=k), "dim int, query_block int, row long, query_id long, vector array<double>, norm double, floor double"),
        "queries",
    )
    stats = written(rows.groupBy("dim", "bucket").agg(F.max("norm").alias("longest"), F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks")), "lengths")
    # queries that need vectors of about one length share their blocks, so few blocks of queries ask the buckets of short vectors
    floored = floored.withColumn("need", F.when((F.col("floor") > 0) & (F.col("norm") > 0), F.floor(F.log(F.col("floor") / F.col("norm")) / F.log(F.lit(RATIO)))).otherwise(-1000000).cast("int"))
    needs = written(floored.groupBy("dim", "need").agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERY_BLOCK)).cast("int").alias("query_blocks")), "needs")
    floored = floored.drop("query_block").join(F.broadcast(needs), ["dim", "need"])  # a row for each dimension and need, like stats
    floored = floored.withColumn("query_block", F.pmod(F.xxhash64("row", F.lit(1)), F.col("query_blocks")).cast("int"))
    reach = F.col("floor") <= F.col("norm") * F.col("longest") * (1 + _SLACK)
    asked = floored.join(F.broadcast(stats), "dim").where(reach).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["dim", "bucket", "block", "need", "query_block"]
    # a block of vectors goes to the blocks of queries that ask it, and to no others
    askers = asked.select(*keys).distinct().groupBy("dim", "bucket", "block").agg(F.collect_list(F.struct("need", "query_block")).alias("askers"))
    dealt = rows.join(F.broadcast(stats), ["dim", "bucket"]).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    dealt = dealt.select("dim", "bucket", "block", "row", "vec_id", "vector", "norm").join(askers, ["dim", "bucket", "block"]).withColumn("asker", F.explode("askers"))
    found = (
        asked.select(*keys, "row", "query_id", "vector", "norm", "floor").groupBy(*keys)
        .cogroup(dealt.select("dim", "bucket", "block", "asker.need", "asker.query_block", "row", "vec_id", "vector", "norm").groupBy(*keys))
        .applyInPandas(partial(_search, k=k), "query long, query_id long, vec_id long, score long, beyond binary")
    )
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _floors(key: tuple, queries: pd.DataFrame, seeds: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k-th best product of each query over the seeds, a lower bound of its k-th best over all rows."""
    floor = np.full(len(queries), -np.inf)
    if len(queries) and len(seeds):
        ids, p = seeds.row.to_numpy(), _matrix(seeds, key[0])
        for first in range(0, len(queries), 256):
            part = queries.iloc[first : first + 256]
            products = _products(p, _matrix(part, key[0]).T)
            for j, row in enumerate(part.row):
                other = products[ids != row, j]
                if len(other) >= k:
                    floor[first + j] = float(np.partition(other, len(other) - k)[len(other) - k]) if other.dtype != object else float(sorted(other)[-k]) * (1 - _SLACK)
    return queries.assign(floor=floor)[["dim", "query_block", "row", "query_id", "vector", "norm", "floor"]]
