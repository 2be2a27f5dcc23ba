import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from canlake.llm import language, line_rules, q_quality

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ODD = [
    (1, None, "a"), (2, "", None), (3, " \n\t ", "a"), (4, "one", "a"), (5, "x y z x y z x y z", "b"), (6, "é #1\né #1\n\n é #1", "b"),
    (6, "é #1\né #1\n\n é #1", "b"), (None, "a\x1cb c\x0bd e", None), (8, "w " * 5000 + "\n" + "v", "c"), (9, "a b c\nd a b c\nb c a b", "c"),
]


def base(text):
    data = (text or "").encode()
    words = WORD.findall(data)
    triples = Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for i in range(len(words) - 2):
        if triples[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in data.split(b"\n") if WORD.search(x)]
    return (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit))


def test_base_counts(spark, sf):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + ODD
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_words", line_rules.F.lit("clash"))
    got = line_rules.judge_lines(docs).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert Counter((r.doc_id, *[r[c] for c in names]) for r in got) == Counter((i, *base(t)) for i, t, _ in rows)


def test_line_limits(spark):
    rows = [(i, f"Page {i}  of the site\nown words {chr(97 + i % 26)} {chr(97 + i // 26)}", "h") for i in range(40)]
    rows += [(100 + i, "PAGE 7 of the site", "h") for i in range(3)] + [(200, "page 1 of the site", "other"), (201, None, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in line_rules.judge_lines(docs, limit_docs=10, limit_share=0.2).collect()}
    assert got[0].words_left == 4 and got[0].n_words == 9 and got[0].depleted
    assert got[100].words_left == 0 and got[100].depleted
    assert got[200].words_left == 5 and not got[200].depleted and not got[201].depleted
    loose = line_rules.judge_lines(docs, limit_docs=50, limit_share=0.2).where("depleted").count()
    assert loose == 0


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert line_rules.judge_lines(empty).count() == 0
    assert set(q_quality.QUERIES) >= {"op5_quality_rules"}


def test_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(9001, None, "en"), (9002, "", "en"), (9003, "12 345 !?", "de"), (None, "the and of", None), (9005, "é" * 40000, None)], "doc_id long, text string, lang string")
    got = q_quality.language.identify(docs.union(odd).withColumn("score", q_quality.F.lit("clash")), q_quality.language_model(docs.union(odd))).collect()
    assert len(got) == docs.count() + 5
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (9001, 9002, 9003))
    assert all(0 <= r.score <= 1 and r.lang_pred in {"en", "de", "fr", "es", "und"} for r in got)
    held = {r.doc_id for r in docs.where(q_quality.held_out()).collect()}
    right = [by_id[i].lang_pred == by_id[i].lang for i in held]
    assert 0 < len(right) < 200 and sum(right) >= 0.9 * len(right)
    empty = docs.limit(0)
    assert q_quality.language.identify(empty, q_quality.language_model(empty)).count() == 0


def test_presence_kernel():
    texts = ["ab ab", "", None, "Zebra é", "x" * 3]
    rows = q_quality.language.presence(q_quality.language.Texts(pa.array(texts)))
    for t, row in zip(texts, rows):
        data = bytes(q_quality.language._READ[b] for b in (t or "").encode())
        names = {(n, data[i : i + n]) for n in range(1, 5) for i in range(len(data) - n + 1)}
        assert len(names) - 2 <= row.sum() <= len(names)
    assert abs(q_quality.language.kernel(rows, rows)[0, 0] - 1) < 1e-6


def grams(text, n_most=language.LONGEST):
    """The set of names of a text's n-grams, by a loop."""
    low = text.encode().lower()
    read = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in low)
    out = set()
    for n in range(1, n_most + 1):
        for i in range(len(read) - n + 1):
            code = int.from_bytes(read[i : i + n], "big")
            out.add((((code ^ (n * 0x01000193 % 2**32)) * 0x9E3779B1) % 2**32) >> (32 - language.DIM.bit_length() + 1))
    return out


def test_kernel_values_by_sets():
    texts = ["The end, 12!", "the END", "Übermut tut gut", "x", "", "a" * 500, "la fin de l'été"]
    rows = language.presence(language.Texts(pa.array(texts)))
    sets = [grams(t) for t in texts]
    k = language.kernel(rows, rows)
    for i, a in enumerate(sets):
        assert set(np.flatnonzero(rows[i]).tolist()) == a
        for j, b in enumerate(sets):
            assert abs(k[i, j] - len(a & b) / math.sqrt(max(len(a), 1) * max(len(b), 1))) < 1e-5


def told_by_sets(text, model, marks):
    """(language, score) of a text by the definition: kernel values over sets of names, scores, and their softmax."""
    if not text or not any(map(str.isalpha, text)):
        return "und", 0.0
    own = grams(text)
    near = np.array([len(own & m) / math.sqrt(max(len(own), 1) * max(len(m), 1)) for m in marks])
    scores = near @ model.weights.astype(np.float64)
    e = np.exp(language.SHARPNESS * (scores - scores.max()))
    return model.languages[int(scores.argmax())], float(e.max() / e.sum())


def test_op3_query_by_sets(spark, sf, tmp_path):
    given = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(9001, None, "en"), (9002, "", "en"), (9003, "12 345 !?", "de"), (None, "the and of", None), (9005, "é" * 30000, None), (9006, "the and of", "en"), (9006, "der die das und", "en"), (9006, "der die das und", "en")]
    more = spark.createDataFrame(odd, "doc_id long, text string, lang string")
    docs = given.unionByName(more.select(*[(F.col(c) if c in more.columns else F.lit(None)).cast(given.schema[c].dataType).alias(c) for c in given.columns]))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    model = q_quality.language_model(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    marks = [set(np.flatnonzero(row).tolist()) for row in np.unpackbits(model.landmarks, axis=1)[:, : language.DIM]]
    want = []
    for r in docs.select("doc_id", "text").collect():
        name, score = told_by_sets(r.text, model, marks)
        want.append((str(r.doc_id), r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0, name, score))
    got = [(str(r.doc_id), r.held_out, r.lang_pred, r.score) for r in q_quality.op3_language_id(spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and sum(w[1] for w in want) > 20
    for a, b in zip(sorted(got), sorted(want)):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-3


def test_ridge_weights_are_optimal(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("lang is not null and text is not null")
    model = language.train(docs, per_language=40, landmarks=24)
    rows = docs.withColumn("lot", F.xxhash64(F.lit(3), "doc_id")).select("lang", "lot", "text").collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.lot)):
        by.setdefault(r.lang, []).append(r)
    assert model.languages == sorted(by)
    chosen = [r for lang in sorted(by) for r in by[lang][:40]]
    names = np.array([r.lang for r in chosen])
    marks = np.unpackbits(model.landmarks, axis=1)[:, : language.DIM].astype(np.float32)
    near = language.kernel(language.presence(language.Texts(pa.array([r.text for r in chosen]))), marks).astype(np.float64)
    among = language.kernel(marks, marks).astype(np.float64)
    weight = len(names) / len(by) / np.array([(names == n).sum() for n in names])

    def loss(weights, goal):
        return float((weight * (near @ weights - goal) ** 2).sum() + language.RIDGE * len(names) * weights @ (among + 1e-6 * np.eye(len(among))) @ weights)

    rng = np.random.default_rng(1)
    for i, lang in enumerate(model.languages):
        goal, own = np.where(names == lang, 1.0, -1.0), model.weights[:, i].astype(np.float64)
        least = loss(own, goal)
        for size in (0.3, 0.03, 0.01):
            assert all(loss(own + size * rng.standard_normal(len(own)), goal) > least - 1e-4 for _ in range(5))


def test_frequent_lines_deplete(spark):
    shared = "\n".join(f"Accept all {n} cookies of this site before you read on, please and thank you" for n in ("many", "some", "more", "most", "odd"))
    own = " ".join("xyz"[i % 3] * (i % 7 + 1) for i in range(40))
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    rows = [(i, f"{shared}\n{own} {name(i)}", "one") for i in range(60)] + [(100 + i, f"{own} {own} {name(i)}q", "one") for i in range(2000)]
    got = {r.doc_id: r for r in line_rules.judge_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i].depleted and got[i].words_left == 41 for i in range(60)) and not any(got[100 + i].depleted for i in range(2000))
