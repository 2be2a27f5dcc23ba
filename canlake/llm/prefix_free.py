"""Removal of repeated byte strings by prefix-free parsing.

A rolling hash over GRAM bytes triggers phrase borders: of all the grams in a window, the one with the smallest hash is
its trigger, so equal windows have equal triggers. A phrase spans all windows of one trigger and overlaps its
neighbours by WINDOW - 1 bytes; every window therefore lies in exactly one phrase, and no order of windows ever
depends on what follows a phrase in the parse. The corpus becomes

- a parse: for each document, its phrases in order, by name;
- a dictionary: each distinct phrase once, with the place where it first occurs.

Phrases meet in Spark at their trigger gram. One whose gram occurs once in the corpus has only unique windows and isn't
looked at again. A phrase that isn't the first of its name is a repeat as a whole. The other repeats lie in the
dictionary, between phrases with one trigger gram: the suffix array of these phrases, built trigger by trigger and cut
at WINDOW bytes, brings equal windows together, and with the parse's places of the phrases each run of equal suffixes
comes in corpus order, the first of which stays. A trigger gram with more than GROUP distinct phrases isn't sorted in
one task: its windows are named one by one and Spark orders each name's places instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canlake.llm.common import batches
from canlake.llm.spans import BATCH, KEY, PLACE, Parsed, Units, bucketed, counted, entry_arrays, ints, later_phrases, later_windows, longs, marked, parse, placed, removed, runs, with_entries
from canlake.llm.text_arrays import ONE, Texts

WINDOW, GRAM = 100, 32
#: Distinct phrases of one trigger gram that a task sorts at once, and bytes of phrases in one suffix array.
GROUP, ARRAY_BYTES = 4096, 1 << 19
_HASH = np.uint64(0xFFFFFFFF80000000)  # 33 bits of hash before 31 bits of place, which hold any text


def byte_units(texts: Texts) -> Units:
    return Units(texts.data.tobytes(), texts.offsets)


def phrases(texts: Texts, window: int = WINDOW, gram: int = GRAM) -> Parsed:
    """The texts' bytes cut into phrases by their windows' triggers."""
    out = Parsed(byte_units(texts))
    if len(texts.data) < window:
        return out
    names = ONE.windows(ONE.prefix(ONE.bytes[texts.data]), gram)
    # smallest (hash, place) over each window's grams, by doubling; places decide ties, the first wins
    least = (names & _HASH) | np.arange(len(names), dtype=np.uint64)
    size, want = 1, window - gram + 1
    while 2 * size <= want:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < want:
        least = np.minimum(least[: len(least) - (want - size)], least[want - size :])
    place = (least & ~_HASH).astype(np.int64)
    new = np.ones(len(place), bool)
    new[1:] = place[1:] != place[:-1]
    sizes = np.diff(texts.offsets)
    edges = texts.offsets[:-1][sizes > 0]
    new[edges[edges < len(new)]] = True
    valid = np.zeros(len(place), np.int8)
    full = np.flatnonzero(sizes >= window)
    valid[texts.offsets[full]] = 1
    ends = texts.offsets[full] + sizes[full] - window + 1
    np.subtract.at(valid, ends[ends < len(valid)], 1)
    valid = np.cumsum(valid) > 0
    heads = np.flatnonzero(new)
    out.windows = np.add.reduceat(valid.astype(np.int64), heads)
    some = valid[heads]
    out.first, out.windows = heads[some], out.windows[some]
    out.text = np.searchsorted(texts.offsets, out.first, side="right") - 1
    out.trigger = names[place[out.first]]
    return out


def repeated_spans(texts: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(doc, tie, twin, start, length) spans of bytes that are covered by windows which start earlier as well. texts: of `placed`."""
    parsed = parse(texts, partial(phrases, window=window, gram=gram), window)
    entries = parsed.where("is_first").drop("is_first")

    def contents(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(found, BATCH):
            t = Texts(b.column(b.schema.get_field_index("text")))
            owner, trigger, start, windows = entry_arrays(b)
            first = t.offsets[owner] + start
            text = byte_units(t).contents(first, first + windows + window - 1)
            keys = [longs(b.column(b.schema.get_field_index(c)).to_numpy()[owner]) for c in KEY]
            yield pa.RecordBatch.from_arrays([longs(trigger), *keys, ints(start), pa.array(text, pa.binary())], ["trigger", *PLACE, "phrase"])

    def sorted_suffixes(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the last trigger's phrases, of which more may follow
        for b in found:
            new = pa.Table.from_batches([b])
            rows = new if held is None else pa.concat_tables([held, new]).combine_chunks()
            heads = np.flatnonzero(np.diff(rows.column("trigger").to_numpy())) + 1
            upto = np.cumsum(pa.compute.binary_length(rows.column("phrase")).to_numpy())
            first, last = 0, int(heads[-1]) if len(heads) else 0
            while first < last:
                full = np.searchsorted(upto, (upto[first - 1] if first else 0) + ARRAY_BYTES)
                end = int(heads[min(np.searchsorted(heads, max(full, first + 1)), len(heads) - 1)])
                yield _repeats(rows.slice(first, end - first).combine_chunks(), window)
                first = end
            held = rows.slice(last)
        if held is not None and held.num_rows:
            yield _repeats(held.combine_chunks(), window)

    few = with_entries(texts, entries.where(F.col("kin") <= group)).mapInArrow(contents, "trigger long, doc long, tie long, twin long, start int, phrase binary")
    parts = few.repartition("trigger").sortWithinPartitions("trigger").mapInArrow(sorted_suffixes, "doc long, tie long, twin long, start int, length int")
    spans = later_phrases(parsed, window).unionByName(parts)
    many = entries.where(F.col("kin") > group)
    if many.limit(1).count():
        spans = spans.unionByName(later_windows(texts, many, byte_units, window))
    return spans


def _repeats(phrases: pa.Table, window: int) -> pa.RecordBatch:
    """Spans of the phrases' windows that occur earlier in them, from the array of their suffixes cut at the window."""
    texts = Texts(phrases.column("phrase").cast(pa.binary()))
    doc, tie, twin, start = (phrases.column(c).to_numpy() for c in PLACE)
    size = np.diff(texts.offsets)
    n = size - window + 1
    of = np.repeat(np.arange(len(n)), n)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = texts.offsets[:-1][of] + step
    in_order = np.lexsort((start[of] + step, twin[of], tie[of], doc[of]))
    strings = np.ndarray((len(texts.data) - window + 1,), f"S{window}", buffer=np.ascontiguousarray(texts.data), strides=(1,))[at[in_order]]
    suffixes = np.argsort(strings, kind="stable")
    same = strings[suffixes][1:] == strings[suffixes][:-1]
    # a suffix is a repeat unless it is at the place of the first of its run, where equal keys may stand twice
    head = np.flatnonzero(np.concatenate(([True], ~same)))[np.cumsum(np.concatenate(([True], ~same))) - 1] if len(of) else suffixes
    one, first_one = in_order[suffixes], in_order[suffixes[head]]
    later = np.zeros(len(of), bool)
    later[one] = (start[of] + step)[one] != (start[of] + step)[first_one]
    for key in (doc, tie, twin):
        later[one] |= key[of[one]] != key[of[first_one]]
    # runs of repeated windows of one phrase become one span
    edges = np.zeros(len(of) + len(n), bool)
    edges[np.arange(len(of)) + of] = later
    first, length = runs(edges)
    owner = np.searchsorted(np.cumsum(n + 1), first, side="right")
    inside = first - (np.cumsum(n + 1) - n - 1)[owner]
    return pa.RecordBatch.from_arrays([*[longs(k[owner]) for k in (doc, tie, twin)], ints(start[owner] + inside), ints(length + window - 1)], [*PLACE, "length"])


def remove_repeated_strings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, group: int = GROUP, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, n_units, n_removed, n_spans, kept, kept_text, kept_sha256, extra) of each document, in bytes of its UTF-8 text.

    A byte goes if it lies in a string of `window` bytes that starts earlier as well: in a document of smaller id, or
    earlier in its own. Null texts are empty; null ids come last; documents of one id are ordered by two hashes of their
    texts, and of equal rows all but one are later copies. Matches never cross documents. Other columns are not read,
    except those to keep, which come in the struct extra. Phrases are named by a 128-bit hash, and a task's memory grows
    with its longest text. Cuts can fall inside a code point, so what is kept is binary; kept_text leaves such bytes out.
    """
    texts = bucketed(counted(placed(docs, doc_id, text, keep)))

    def cut(data: bytes, spans: np.ndarray | None) -> tuple[bytes, int, int, int]:
        n = len(data)
        gone = marked(spans[0], spans[1], n) if spans is not None else np.full(n, n >= window)
        return np.frombuffer(data, np.uint8)[~gone].tobytes(), n, int(gone.sum()), len(runs(gone)[0])

    return removed(texts, repeated_spans(texts, window, gram, group), cut)
