import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from canlake.llm import jaccard, prefix_free, recompression
from canlake.llm.text_arrays import ONE

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, k=4):
    words = WORD.findall((text or "").encode().lower())
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def brute_components(rows, percent=85, k=4):
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                up[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), d if not sets[i] else min(ids, default=None)))
    return out


def key(r):
    return tuple(-1 if x is None else x for x in r)


def test_components(spark, sf):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for family in range(4):
        base = [rng.choice(vocabulary) for _ in range(220)]
        for i in range(40):
            words = list(base)
            for _ in range(rng.randint(0, 14)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((1000 + family * 100 + i, " ".join(words)))
    rows += [(5000, None), (5001, ""), (5002, "  \n"), (5003, "a b"), (5004, "A\tB"), (5005, "a b c"), (None, "a B c"), (None, "null id only"), (5003, "x y z q r s"), (5006, "a\x1cb c d e")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class", F.lit("clash"))
    got = jaccard.similar_components(df).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute_components(rows), key=key)


def test_components_of_small_sets(spark):
    # families of one text and the same text with words appended
    sizes = [(8, 9, 10), (9, 10), (8, 9), (5, 6), (16, 17)]
    rows = [(100 * f + n, " ".join(f"v{f}x{i}" for i in range(n))) for f, family in enumerate(sizes) for n in family]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, percent in ((4, 85), (5, 80), (1, 94)):
        got = jaccard.similar_components(df, words=k, percent=percent).collect()
        assert sorted(map(tuple, got), key=key) == sorted(brute_components(rows, percent, k), key=key)


def test_first_prefix_misses_no_pair():
    n = np.arange(1, 161)
    for percent in range(50, 101):
        upto, need = jaccard._first_prefix(n, percent)
        for size, u, k in zip(n, upto, need):
            overlap = np.maximum(-(-percent * (size + n) // (100 + percent)), 1)
            links = (overlap <= np.minimum(size, n)) & (size != n)
            # what both prefixes have of an overlap at the least: each loses its members outside it first
            common = np.minimum(u - (size - overlap), upto - (n - overlap))
            assert k >= 1 and (common[links] >= k).all()


def test_components_empty(spark):
    assert jaccard.similar_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_removed(rows, units, window, join):
    """rows: (doc_id, text); units(text) -> list. Order: id with nulls last, then the hash that Spark gives, then row."""
    seen, out = set(), []
    for d, t in rows:
        u = units(t)
        gone = [False] * len(u)
        for i in range(len(u) - window + 1):
            w = tuple(u[i : i + window])
            if w in seen:
                gone[i : i + window] = [True] * window
            seen.add(w)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = join([x for x, g in zip(u, gone) if not g])
        out.append((d, len(u), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def planted(rng, n, length=60):
    words = [f"{rng.choice('abcdefgh')}{i}é" for i in range(400)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(15, 45))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, length)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            cut = rng.randint(0, 30)
            parts += [p[cut:] if rng.random() < 0.5 else p, " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))]
        rows.append((i * 3, "\n".join(parts) if rng.random() < 0.5 else " ".join(parts)))
    rows += [(i * 3 + 1, rows[i][1]) for i in range(0, n, 7)]
    return rows


EDGES = [(2000, None), (2001, ""), (2002, "ab" * 300), (2003, "a" * 450), (2005, "a" * 99), (2006, "a" * 100), (2007, "b" * 99 + "é"), (2008, "x " * 90), (2009, "\0" * 120 + "z"), (2010, "\0" * 130)]


def test_repeated_strings(spark, sf):
    rng = random.Random(2)
    rows = sorted(planted(rng, 60) + EDGES + [(3000 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60").collect()], key=lambda r: r[0])
    want = sorted(brute_removed(rows, lambda t: list((t or "").encode()), 100, bytes))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc", F.lit("clash"))
    for group in (4096, 2):
        got = prefix_free.remove_repeated_strings(df, group=group).drop("kept", "kept_text", "extra").collect()
        assert sorted(map(tuple, got)) == want


def test_repeated_rows_and_null_ids(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(4, long), (4, long), (4, long), (None, long), (5, "q" + long), (6, "short"), (6, "short"), (None, None)]
    got = prefix_free.remove_repeated_strings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    gone = sorted(((r.doc_id or -1, r.n_removed, r.n_units) for r in got))
    n = len(long)
    assert gone == sorted([(4, 0, n), (4, n, n), (4, n, n), (-1, n, n), (5, n, n + 1), (6, 0, 5), (6, 0, 5), (-1, 0, 0)])
    assert prefix_free.remove_repeated_strings(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ties_of_ids(spark):
    # two texts that one 32-bit hash doesn't tell apart, without an id and with the largest one
    a, b = (" ".join(hashlib.md5(f"{n}/{i}".encode()).hexdigest() for i in range(30)) for n in (182042, 201152))
    last = 2**63 - 1
    rows = [(1, a), (None, a), (None, b), (last, b), (last, "z" * 150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(1, "a"): 0, (None, "a"): len(a), (None, "b"): len(b), (last, "b"): 0, (last, "z"): 50}
    got = prefix_free.remove_repeated_strings(df.withColumn("x", F.lit(1)), keep=["text"]).select("doc_id", "extra.text", "n_removed").collect()
    assert {(r.doc_id, "a" if r.text == a else "b" if r.text == b else "z"): r.n_removed for r in got} == {**want, (last, "z"): 149}
    words = recompression.remove_repeated_words(df, keep=["text"]).select("doc_id", "extra.text", "n_removed").collect()
    assert {(r.doc_id, r.text == a, r.text == b): r.n_removed for r in words} == {(1, True, False): 0, (None, True, False): 30, (None, False, True): 30, (last, False, True): 0, (last, False, False): 0}


def test_long_words_of_two_letters(spark):
    # words for which every polynomial modulo 2^64 with an odd base has one value
    one, two = "a", "b"
    for _ in range(12):
        one, two = one + two, two + one
    data = np.frombuffer((one + two).encode(), np.uint8)
    assert len(set(ONE.spans(ONE.prefix(ONE.bytes[data]), np.array([0, 4096]), np.array([4096, 8192])).tolist())) == 1
    other = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{one} {other}"), (2, f"{two} {other}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.n_removed for r in recompression.remove_repeated_words(df).collect()} == {0}
    short = spark.createDataFrame([(1, one), (2, two), (3, one)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard.similar_components(short).collect()) == [(1, 1), (2, 2), (3, 1)]
    got = prefix_free.remove_repeated_strings(spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")).drop("kept", "kept_text", "extra").collect()
    assert sorted(map(tuple, got)) == sorted(brute_removed([(1, one), (2, two)], lambda t: list(t.encode()), 100, bytes))


def test_cut_code_points_go_and_genuine_marks_stay(spark):
    shared = "".join(chr(0x100 + i) for i in range(60))
    rows = [(1, "\ufffd" + shared + " end"), (2, "a" + shared[:-1] + chr(0x100 + 60) + "\ufffd"), (3, None)]
    got = {r.doc_id: r for r in prefix_free.remove_repeated_strings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    kept = (rows[1][1]).encode()
    assert got[1].kept_text == rows[0][1] and got[3].kept_text == "" and got[2].n_removed == 119
    assert bytes(got[2].kept) == kept[:1] + kept[120:] and got[2].kept_text == "a\ufffd"


def test_repeated_words(spark, sf):
    rng = random.Random(4)
    edges = [(2000, None), (2001, ""), (2002, "ab " * 300), (2003, "x y " * 60), (2004, "b " * 19), (2005, "b " * 20), (2006, "c\x1cd " * 21), (2007, "ab " * 31 + "z")]
    rows = sorted(planted(rng, 90, 90) + edges + [(3000 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()], key=lambda r: r[0])
    want = sorted(brute_removed(rows, lambda t: WORD.findall((t or "").encode()), 20, b" ".join))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc", F.lit("clash"))
    got = recompression.remove_repeated_words(df).drop("kept", "kept_text", "extra").collect()
    assert sorted(map(tuple, got)) == want
    assert recompression.remove_repeated_words(df.limit(0)).count() == 0
    got = recompression.remove_repeated_words(spark.createDataFrame([(4, "w " + " ".join(map(str, range(30))))] * 3, "doc_id long, text string")).collect()
    assert sorted(r.n_removed for r in got) == [0, 31, 31]


def test_equal_windows_have_equal_triggers():
    import pyarrow as pa

    rng = random.Random(9)
    for unit, window, parser in ((lambda t: list(t.encode()), 100, prefix_free.phrases), (lambda t: WORD.findall(t.encode()), 20, recompression.phrases)):
        texts = [t or "" for _, t in planted(rng, 80, 90) + EDGES]
        p = parser(prefix_free.Texts(pa.array(texts)))
        seen = {}
        units = [unit(t) for t in texts]
        total = 0
        for text, first, n, trigger in zip(p.text, p.first - p.units.edges[p.text], p.windows, p.trigger):
            for i in range(first, first + n):
                assert seen.setdefault(tuple(units[text][i : i + window]), trigger) == trigger
                total += 1
        assert total == sum(max(len(u) - window + 1, 0) for u in units)
