import itertools
import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from canlake.llm import mixing, q_tables, sharding


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b, key = j, (key * sharding.MULTIPLIER + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_follows_the_published_loop(spark):
    keys = [0, 1, -1, 42, 2**63 - 1, -(2**63), 256, 10863919174838991, *range(1000, 1200)]
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)], "doc_id long")
    for n in (1, 2, 24, 57, 300):
        for r in sharding.assign_shards(df, "doc_id", n).collect():
            key = (r.doc_id or 0) % 2**64
            assert (r.shard, r.grown_shard) == (jump(key, n), jump(key, n + 1))


def test_sharding_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = q_tables.op1_sharding(spark, sf).collect()
    slots = defaultdict(list)
    for r in got:
        data = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 8, zlib.crc32(data), "key")
        slots[r.shard].append(r.slot)
    assert len(got) == len(docs) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_slots_of_repeats_and_nulls(spark):
    rows = [(None, "a")] * 5 + [(7, None)] * 3 + [(7, "b"), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("slot", F.lit("old"))
    got = sharding.number_slots(sharding.assign_shards(df, "doc_id", 3)).collect()
    per = defaultdict(list)
    for r in got:
        per[r.shard].append(r.slot)
    assert len(got) == 10 and all(sorted(s) == list(range(len(s))) for s in per.values())
    assert sharding.number_slots(sharding.assign_shards(df.limit(0), "doc_id", 3)).count() == 0


def test_knapsack_is_exact():
    rng = random.Random(3)
    for _ in range(60):
        lengths = sorted(rng.sample(range(1, 30), 4))
        left = [rng.randint(0, 3) for _ in lengths]
        budget = rng.randint(0, 80)
        best = min(abs(sum(a * b for a, b in zip(c, lengths)) - budget) for c in itertools.product(*[range(n + 1) for n in left]))
        got = mixing.knapsack(lengths, left, budget)
        assert abs(sum(k * v for k, v in got.items()) - budget) == best and all(v <= left[lengths.index(k)] for k, v in got.items())
    lengths, counts = list(range(1, 400)), [3] * 399
    for budget in (0, 1, 5000, 100_003, 239_399, 239_400):
        taken = mixing.fit_counts(lengths, counts, budget, room=1)
        assert sum(a * b for a, b in zip(lengths, taken)) == budget and all(0 <= t <= 3 for t in taken)


def test_remainder_below_every_length():
    assert mixing.fit_counts([100_000], [3], 70_000) == [1]
    assert mixing.fit_counts([100_000], [3], 40_000) == [0]
    assert mixing.fit_counts([100_000], [3], 50_000) == [0]
    rng = random.Random(8)
    for _ in range(40):
        lengths = sorted(rng.sample(range(50, 400), 5))
        budget = rng.randint(0, sum(lengths) - 1)
        for room in (1, 4):
            taken = mixing.fit_counts(lengths, [1] * 5, budget, room)
            total = sum(a * b for a, b in zip(lengths, taken))
            assert all(abs(total + n - budget) >= abs(total - budget) for n, t in zip(lengths, taken) if not t)


def test_long_documents_are_fitted_as_exactly_as_short_ones():
    assert mixing.fit_counts([60_000, 70_000, 100_000], [1, 1, 1], 130_000) == [1, 1, 0]
    assert mixing.fit_counts([3_000_000_000], [5], 7_000_000) == [0]
    rng = random.Random(9)
    for _ in range(40):
        unit = rng.choice((1, 1000))
        lengths = sorted(rng.sample(range(20_000, 400_000), 5))
        lengths = sorted({unit * (x // unit) for x in lengths})
        counts = [rng.randint(1, 3) for _ in lengths]
        budget = rng.randint(0, sum(a * b for a, b in zip(lengths, counts)))
        best = min(abs(sum(a * b for a, b in zip(c, lengths)) - budget) for c in itertools.product(*[range(n + 1) for n in counts]))
        for room in (1, 4):
            taken = mixing.fit_counts(lengths, counts, budget, room)
            assert abs(sum(a * b for a, b in zip(lengths, taken)) - budget) == best and all(0 <= t <= n for t, n in zip(taken, counts))


def test_documents_of_a_length_are_chosen_by_their_hash(spark, sf):
    rows = [(i, "ab"[i % 2], (i * 37) % 23) for i in range(600)] + [(7, "b", 5)] * 3
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.mix(df.withColumn("lot", F.xxhash64(F.lit(mixing.SEED), "doc_id"))).collect()
    groups = defaultdict(list)
    for r in got:
        groups[r.source, r["size"]].append((r.lot % 256, r.lot, r.doc_id, r.times))
    for members in groups.values():
        times = [t for *_, t in sorted(members, key=lambda m: (m[:3], -m[3]))]
        assert times == sorted(times, reverse=True) and max(times) - min(times) <= 1


def test_mixing_query_agrees_with_its_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    words = {r.doc_id: len([w for w in (r.text or "").encode().split()]) for r in docs}
    sizes = Counter()
    for r in docs:
        sizes[r.source] += words[r.doc_id]
    want, taken = shares(dict(sizes)), Counter()
    got = q_tables.op8_source_mixing(spark, sf).collect()
    source = {r.doc_id: r.source for r in docs}
    for r in got:
        s = source[r.doc_id]
        taken[s] += r.taken
        assert r["size"] == words[r.doc_id] and r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * want[s]
        assert r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
    assert len(got) == len(docs)
    for s in sizes:  # as near as any choice of further documents beside the whole passes
        passes, sums = min(int(want[s] // sizes[s]), 3), 1
        for r in docs:
            sums |= sums << words[r.doc_id] if r.source == s and passes < 3 else 0
        rest = round(want[s]) - passes * sizes[s]
        nearest = min(abs(n - rest) for n in range(sums.bit_length()) if sums >> n & 1)
        assert abs(abs(taken[s] - round(want[s])) - nearest) <= 1, (s, taken[s], want[s], nearest)


def shares(sizes):
    names = sorted(k for k in sizes if k is not None) + [None] * (None in sizes)
    weight = {k: i % 3 + 1 for i, k in enumerate(names)}
    target, open_, rest = {}, set(names), float(sum(sizes.values()))
    while open_:
        level = rest / sum(weight[k] for k in open_)
        over = {k for k in open_ if level * weight[k] > 3 * sizes[k]}
        if not over:
            return target | {k: level * weight[k] for k in open_}
        for k in over:
            target[k] = 3.0 * sizes[k]
            rest -= 3 * sizes[k]
        open_ -= over
    return target


def test_mixing(spark, sf):
    rows = [(i, "abcd"[i % 4] if i % 9 else None, (i * 37) % 91) for i in range(900)] + [(1000 + i, "tiny", 2) for i in range(3)] + [(5, "a", 30)] * 40 + [(None, "zero", 0)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("target", F.lit("clash")).withColumn("extra", F.lit("clash"))).collect()
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    want = shares(dict(sizes))
    taken = Counter()
    for r in got:
        taken[r.source] += r.times * r["size"]
        assert r.times <= 3 and r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    a, b = (sorted(map(str, q_tables.op8_source_mixing(spark, sf).collect())) for _ in range(2))
    assert a == b
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string, size long")).count() == 0
