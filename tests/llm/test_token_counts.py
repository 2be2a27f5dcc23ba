import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from canlake.llm import q_tokens, token_counts

FILES = [q_tokens.WORD_NAME, "byte_bpe_50k.json"]
ODD = [
    "", " ", "a", "hello<|endoftext|>World it's 123 <|ENDOFTEXT|> \x1c x", "<|startoftext|><|startoftext|>", "aaaaaaaaaaaaaaa aaa", "x́́ ́ é", "ΣΊΣΥΦΟΣ ΣΑΣ",
    "a b　c d", "你好吗 한국어 각", "\x00\x01\x85", "'S 'll don'T", "İstanbul ﬁ ǅ", "1234567890 ١٢٣", "🤷🏽‍♀️🤷🏽", "<|endoftext|", "é" * 5000, "ab" * 3000, "#" * 1000,
]


@pytest.fixture(scope="module", params=FILES)
def both(request):
    path = f"{q_tokens.TOKENIZERS}/{request.param}"
    return token_counts.Counter(token_counts.Merges.load(path)), Tokenizer.from_file(path)


def wanted(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_as_the_library(both):
    counter, library = both
    assert counter.count([t.encode() for t in ODD]) == wanted(library, ODD)
    assert counter.by_words == (counter.merges.size == 49406)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=30), max_size=5))
def test_any_text(texts):
    counter, library = _both()
    assert counter.count([t.encode() for t in texts]) == wanted(library, texts)


def _both(found=[]):  # noqa: B006
    if not found:
        path = f"{q_tokens.TOKENIZERS}/{q_tokens.WORD_NAME}"
        found += [token_counts.Counter(token_counts.Merges.load(path)), Tokenizer.from_file(path)]
    return found


def one_by_one(rank, symbols):
    """Merges of one sequence by the definition: always the leftmost pair of the lowest rank."""
    symbols = list(symbols)
    while True:
        found = [(rank[p][0], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in rank]
        if not found:
            return len(symbols)
        _, i = min(found)
        symbols[i : i + 2] = [rank[symbols[i], symbols[i + 1]][1]]


def test_merges_by_definition():
    # ranks as they come, where a merge may make a pair of lower rank, and ranks after those of both parts
    dice = random.Random(3)
    for together in (False, True):
        for _ in range(60):
            rank, top = {}, 3
            for r in range(12):
                pair = (dice.randrange(top), dice.randrange(top))
                if pair not in rank:
                    rank[pair] = [r, top]
                    top += 1
            if not together:
                shuffled = [v[0] for v in rank.values()]
                dice.shuffle(shuffled)
                for v, r in zip(rank.values(), shuffled):
                    v[0] = r
            pairs = sorted(rank.items(), key=lambda kv: kv[0][0] * top + kv[0][1])
            m = token_counts.Merges("", np.array([a * top + b for (a, b), _ in pairs]), np.array([v[0] for _, v in pairs]), np.array([v[1] for _, v in pairs]), top, None, None, together, [])
            rows = [[dice.randrange(3) for _ in range(dice.randrange(12))] for _ in range(30)]
            got = m.merge(np.array([s for r in rows for s in r], np.int64), np.array(list(map(len, rows))))
            assert got.tolist() == [one_by_one(rank, r) for r in rows]


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, None), (9001, ""), *[(9002, t) for t in ODD], (9002, "a"), (9002, "a")], "doc_id long, text string")
    rows = docs.union(odd).withColumn("n_bytes", F.lit("clash"))
    library = Tokenizer.from_file(f"{q_tokens.TOKENIZERS}/{q_tokens.WORD_NAME}")
    kept = [(r.doc_id, r.text or "") for r in rows.collect()]
    want = [(i, len(t.encode()), n, n > 50) for (i, t), n in zip(kept, wanted(library, [t for _, t in kept]))]
    got = [tuple(r) for r in token_counts.count_tokens(rows, f"{q_tokens.TOKENIZERS}/{q_tokens.WORD_NAME}", 50).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert token_counts.count_tokens(rows.limit(0), f"{q_tokens.TOKENIZERS}/{q_tokens.WORD_NAME}").count() == 0


def test_query(spark, sf):
    library = Tokenizer.from_file(f"{q_tokens.TOKENIZERS}/{q_tokens.WORD_NAME}")
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = q_tokens.op12_token_counts(spark, sf).collect()
    assert len(got) == len(docs)
    assert all((r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 2048) for r, n in ((r, wanted(library, [docs[r.doc_id]])[0]) for r in got))
