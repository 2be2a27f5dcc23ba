import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from canlake.llm import pieces, q_tokens


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load(q_tokens.MODEL)


def ways(text, vocabulary):
    """Every segmentation of the bytes with its log weight; bytes stand only where a character is no piece."""
    table = {p: i for i, p in enumerate(vocabulary.pieces) if p and i not in set(vocabulary.byte_piece.tolist())}
    data = b" " + text.encode()

    def from_(at):
        if at == len(data):
            return [((), 0.0)]
        out = []
        for end in range(at + 1, len(data) + 1):
            if data[at:end] in table and (end == len(data) or data[end] & 0xC0 != 0x80):
                i = table[data[at:end]]
                out += [((i, *rest), vocabulary.weight[i] + w) for rest, w in from_(end)]
        char_end = at + 1
        while char_end < len(data) and data[char_end] & 0xC0 == 0x80:
            char_end += 1
        if data[at:char_end] not in table:
            ids = tuple(int(vocabulary.byte_piece[b]) for b in data[at:char_end])
            out += [((*ids, *rest), sum(vocabulary.weight[i] for i in ids) + w) for rest, w in from_(char_end)]
        return out

    found = from_(0)
    total = math.log(sum(math.exp(w) for _, w in found))
    return {ids: w - total for ids, w in found}


def test_all_segmentations_without_replacement(vocabulary):
    texts = ["the end", "é▁", "a  b", "\nx", "你好吗", ""]
    batch = pieces.Texts(pa.array(texts))
    found = {}
    for t, rank, ids, log_p, perturbed, included in pieces.encode_batch(batch, np.arange(6, dtype=np.uint64), vocabulary, 5000):
        found.setdefault(t, []).append((tuple(ids.tolist()), log_p, perturbed, included))
    for t, text in enumerate(texts):
        want = ways(text, vocabulary)
        got = {i: p for i, p, _, _ in found[t]}
        assert len(got) == len(found[t]) and set(got) <= set(want)
        assert all(abs(p - want[i]) < 1e-9 for i, p in got.items())
        assert sum(map(math.exp, got.values())) > 1 - 1e-9
        values = [g for _, _, g, _ in found[t]]
        assert values == sorted(values, reverse=True)


def test_distribution_of_pairs(vocabulary):
    n = 4000
    want = ways("to be", vocabulary)
    first, second = Counter(), Counter()
    drawn = {}
    for t, rank, ids, *_ in pieces.encode_batch(pieces.Texts(pa.array(["to be"] * n)), pieces.mix(np.arange(n, dtype=np.uint64)), vocabulary, 2):
        drawn.setdefault(t, []).append(tuple(ids.tolist()))
    for a, b in drawn.values():
        assert a != b
        first[a] += 1
        second[a, b] += 1
    top = max(want, key=want.get)
    assert abs(first[top] / n - math.exp(want[top])) < 0.04
    for (a, b), k in second.most_common(3):
        p = math.exp(want[a]) * math.exp(want[b]) / (1 - math.exp(want[a]))
        assert abs(k / n - p) < 0.04


def test_inclusion_probabilities(vocabulary):
    # the published estimator: the sum of p / inclusion over a sample has the mean 1 for every function of the items
    n, want = 4000, ways("to be", vocabulary)
    ids_of = list(want)
    total, of_first = 0.0, 0.0
    for k in (2, 3):
        total = of_first = 0.0
        for t, rank, ids, log_p, _, included in pieces.encode_batch(pieces.Texts(pa.array(["to be"] * n)), pieces.mix(np.arange(n, dtype=np.uint64) + np.uint64(k * n)), vocabulary, k):
            share = math.exp(log_p - included)
            total += share / n
            of_first += share / n * (tuple(ids.tolist()) == ids_of[0])
        assert abs(total - 1) < 0.05 and abs(of_first - math.exp(want[ids_of[0]])) < 0.05


def test_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, "  two  blanks\t\n "), (9001, None), (9002, ""), (9003, "x" * 3000), (9004, "▁ \x00é😀"), (9004, "▁ \x00é😀")], "doc_id long, text string")
    rows = docs.union(odd)
    got = pieces.sample_encodings(rows, q_tokens.MODEL, samples=3)
    back = pieces.decode_texts(got, q_tokens.MODEL).collect()
    text = {r.doc_id: r.text or "" for r in rows.collect()}
    per = Counter(r.doc_id for r in back)
    assert all(r.decodes and r.text == text[r.doc_id] and r.n_pieces == len(r.ids) and r.log_inclusion <= 0 for r in back)
    assert per[9001] == per[9002] == 1 and per[9003] == 3 and per[9004] == 2 and len(per) == len(text)
    again = pieces.sample_encodings(rows.repartition(3), q_tokens.MODEL, samples=3).collect()
    assert sorted((str(r.doc_id), r["rank"], r.ids_crc32) for r in again) == sorted((str(r.doc_id), r["rank"], r.ids_crc32) for r in back)
    assert pieces.sample_encodings(rows.limit(0), q_tokens.MODEL).count() == 0
