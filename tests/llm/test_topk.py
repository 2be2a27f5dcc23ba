import math
import random

from pyspark.sql import functions as F

from canlake.llm import topk


def brute(rows, is_query, k):
    ok = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, v) in enumerate(ok):
        if is_query(i):
            found = sorted((-sum(a * b for a, b in zip(v, w)), j) for m, (j, w) in enumerate(ok) if m != n and len(w) == len(v))
            out += [(i, r + 1, j, max(min(-s, 2**63 - 1), -(2**63))) for r, (s, j) in enumerate(found[:k])]
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) * (1 + i % 7) for _ in range(8)]) for i in range(400)]
    rows += [(400 + i, rows[10][1]) for i in range(20)] + [(420 + i, [0.0] * 8) for i in range(4)]
    rows += [(500, None), (501, [1.0, None] + [0.0] * 6), (502, [float("nan")] * 8), (503, [float("inf")] * 8), (504, [1.0, 2.0]), (510, [3.0, 1.0]), (None, [1.0] * 8), (520, []), (530, [])]
    rows += [(540, [1e13, -1e13] + [0.0] * 6), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    for ratio, block, seeds in ((1.1, 32768, 2048), (1.5, 50, 12)):
        topk.RATIO, topk.BLOCK, topk.SEEDS, topk.QUERY_BLOCK = ratio, block, seeds, 7
        got = sorted(tuple(r) for r in topk.top_k(df, F.coalesce(F.col("vec_id") % 10 == 0, F.lit(False)), 10).collect())
        assert got == brute(rows, lambda i: i % 10 == 0, 10)


def test_empty(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert topk.top_k(empty, F.lit(True)).count() == 0
