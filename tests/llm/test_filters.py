import re
from itertools import permutations

from pyspark.sql import functions as F

from canlake.llm import filter_audit, q_filters

WORD = r"[^\x20\x09-\x0D]+"


def brute(docs, labels):
    """Every order applied step by step to (doc_id, text, lang) rows."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    judged = []
    for i, text, lang in docs:
        text = text or ""
        words = re.findall(WORD, text)
        failed = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and first[text] < i,
        }
        judged.append((lang or "", i, {f for f, x in failed.items() if x}))
    out = {}
    for part in {p for p, _, _ in judged}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = [(i, f) for p, i, f in judged if p == part]
            everyone = list(left)
            for step, name in enumerate(order, 1):
                lost = [(i, f) for i, f in left if name in f]
                left = [(i, f) for i, f in left if name not in f]
                shapley[name] += len(lost)
                fails = sum(name in f for _, f in everyone)
                out[part, "".join(order), step] = [len(left), len(lost), fails - len(lost), sum(f == {name} for _, f in everyone), sum(i in good for i, _ in lost), sum(i in toxic for i, _ in lost), name]
        for key in [k for k in out if k[0] == part]:
            out[key][-1] = shapley[out[key][-1]]
    return out


def run(spark, docs, labels):
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("n", F.lit("clash")).withColumn("part", F.lit("clash")).withColumn("digest", F.lit(1))
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    sets = filter_audit.failure_sets(table, q_filters.conditions(), told, duplicate="E")
    rows = filter_audit.audit(sets, ["A", "B", "C", "D", "E"]).collect()
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = {(r.part, r.filter_order, r.step): [r[c] for c in names] for r in rows}
    assert len(got) == len(rows)
    return got


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(250))
    docs = [
        (1, None, None), (2, "", "en"), (3, "", ""), (3, "", "en"), (None, "", "en"), (None, long, "de"), (4, long, "de"), (5, long, None), (5, long, None),
        (6, "same " * 300, "de"), (7, "A B C", "de"), (8, long + " #", "en"), (9, long + " É\x0bé ABCDEFGHIJKLMNOPQRSTUVWXYZABCDEFGHIJKLMNOPQRSTUVWXYZ", "en"), (10, "x" * 200000, "fr"), (4, long, "de"),
    ]
    labels = [(1, 1, 0), (4, None, 1), (4, 1, None), (4, 0, 0), (5, 1, 1), (None, 1, 1), (99, 1, 1), (6, 0, 1)]
    assert run(spark, docs, labels) == brute(docs, labels)


def test_given_documents(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert run(spark, docs, labels) == brute(docs, labels)


def test_empty(spark):
    assert run(spark, [], []) == {}


def test_path_counts():
    forward, backward = filter_audit.path_counts(4)
    orders = list(permutations(range(4)))
    for state in range(16):
        members = {f for f in range(4) if state >> f & 1}
        reach = [o for o in orders if set(o[: len(members)]) == members]
        assert len(reach) == forward[state] * backward[state]
    for state, f, through in filter_audit.edge_table(4):
        members = {g for g in range(4) if state >> g & 1}
        assert through == sum(set(o[: len(members)]) == members and o[len(members)] == f for o in orders)
