import re
import zlib
from collections import Counter

import corpus_pipeline as pipeline
from canlake.llm import jaccard
from test_repeats import brute_removed, shingles

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(9000, None, "en", "src1", None), (9001, "", None, None, 0), (9002, "12 34 !", "de", "src2", 7), (None, "the one with no id, of the and", None, "src3", 30), (9004, "ein Wort", "de", None, 8), (9004, "ein Wort", "de", None, 8)]
    more = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long").select(*docs.columns)
    return docs.union(more.select(*[more[c].cast(docs.schema[c].dataType) for c in docs.columns]))


def test_stages(spark, sf, tmp_path):
    docs = documents(spark, sf)
    kept = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{len(kept)}")
        out = spark.read.parquet(f"{tmp_path}/{len(kept)}")
        if len(kept) < len(pipeline.STAGES) - 1:
            assert out.dtypes == docs.dtypes
        kept[name] = (docs.collect(), out.collect())
        docs = out
    steps = list(kept.values())

    before, after = steps[0]
    letters = Counter((r.doc_id, r.text) for r in before if r.text and any(map(str.isalpha, r.text)))
    assert Counter((r.doc_id, r.text) for r in after) == letters

    before, after = steps[1]
    rows = [(r.doc_id, r.text) for r in before]
    sets = [shingles(t, 5) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append((d is None, d))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in after) == sorted((n, d or 0) for n, d in map(min, groups.values()))

    before, after = steps[2]
    rows = sorted(((r.doc_id if r.doc_id is not None else 2**63 - 1, r.text) for r in before), key=lambda x: x[0])
    gone = {d: (n, g) for d, n, g, _, _ in brute_removed(rows, lambda t: list(t.encode()), 100, bytes)}
    for r in after:
        n, g = gone.pop(r.doc_id if r.doc_id is not None else 2**63 - 1)
        assert n - g - 6 * 60 <= len(r.text.encode()) <= n - g and (g or r.n_chars is None or r.n_chars == len(r.text))
    assert all(n - g < 200 and g for n, g in gone.values())

    before, after = steps[3]
    assert {(r.doc_id, r.text) for r in after} <= {(r.doc_id, r.text) for r in before}
    assert max(Counter((r.doc_id, r.text) for r in after).values()) <= 3
    total = sum(len(WORD.findall(r.text.encode())) for r in before)
    assert abs(sum(len(WORD.findall(r.text.encode())) for r in after) - total) <= 0.02 * total

    before, after = steps[4]
    assert {r.doc_id for r in after} == {r.doc_id for r in before} and all(r.decodes for r in after)


def test_repeated_rows_leave_one(spark):
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (5, None), (5, None), (6, "z")]
    told = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class", jaccard.F.concat(jaccard.F.lit("x"), "doc_id")).withColumn("n_shingles", jaccard.F.lit(-1)).withColumn("Size", jaccard.F.lit(1.5)).withColumn("_id", jaccard.F.lit(0))
    got = jaccard.one_of_each(told)
    assert got.columns == told.columns and Counter(r.doc_id for r in got.collect()) == {2: 1, 5: 2, 6: 1}
    assert all((r["class"], r.n_shingles, r.Size) == (f"x{r.doc_id}", -1, 1.5) for r in got.collect())


def test_language_prediction_decides(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a, b, c, d = [i for i in range(20000, 20100) if zlib.crc32(str(i).encode()) % 5 == 0][:4]  # held out from learning
    texts = {a: ("en", "Быстрая коричневая лиса прыгает через ленивую собаку и убегает в лес"), b: ("fr", "敏捷的棕色狐狸跳过了懒狗然后跑进森林"), c: (None, "Η γρήγορη καφέ αλεπού πηδά πάνω από το τεμπέλικο σκυλί")}
    wrong = docs.where("lang = 'de' and n_chars > 500").orderBy("doc_id").limit(1).withColumn("doc_id", jaccard.F.lit(d).cast(docs.schema["doc_id"].dataType)).withColumn("lang", jaccard.F.lit("fr"))
    more = spark.createDataFrame([(i, t, lang, "src1", len(t)) for i, (lang, t) in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    added = docs.union(wrong).union(more.select(*[more[x].cast(docs.schema[x].dataType) for x in docs.columns]))
    out = {r.doc_id: r.lang for r in pipeline.language_id(spark, added, sf).collect()}
    assert not out.keys() & texts.keys() and out[d] == "de"
    clean = {r.doc_id: r.lang for r in docs.collect()}
    assert {i: out[i] for i in clean} == clean


def test_no_labels_keep_letters(spark, sf):
    docs = documents(spark, sf).withColumn("lang", jaccard.F.lit(None).cast("string"))
    out = pipeline.language_id(spark, docs, sf)
    assert out.dtypes == docs.dtypes
    letters = Counter((r.doc_id, r.text) for r in docs.collect() if r.text and any(map(str.isalpha, r.text)))
    assert Counter((r.doc_id, r.text) for r in out.collect()) == letters
