"""Removal of repeated word runs by recompression.

Rounds rewrite each document's words: runs of one symbol get a name made from symbol and length, then pairs whose left
symbol is on the left side and whose right symbol is on the right side (a bit of each name, drawn anew each round) get
a name made from both. Names are hashes, so all documents name alike without a table, and equal word runs come to have
equal interior symbols. With each symbol goes the interval of words that decided it and its borders: a symbol whose
interval lies in a window is there in every equal window.

A window's trigger is one of the symbols it decides, of the highest round that has any, with the smallest name. Shared
triggers reveal repeats: Spark brings the phrases, runs of windows with one trigger, together by trigger, and windows of
symbols that occur once aren't looked at again. Later phrases of a name are repeats, and where phrases share a trigger
without being equal, their windows are named and ordered one by one. Names are 128-bit hashes of the words themselves,
not of symbols.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame

from canlake.llm.spans import Parsed, Units, bucketed, counted, later_phrases, later_windows, marked, parse, placed, removed, runs
from canlake.llm.text_arrays import ONE, Texts, mix, word_names

#: Words of a window, and rounds: with two, a window decides about five symbols, so neighbouring windows mostly share their trigger.
WINDOW, ROUNDS = 20, 2
_K = np.uint64(0x9E3779B97F4A7C15)
_FAR = 1 << 40
_PLACE = np.uint64((1 << 31) - 1)  # the low bits of a packed name hold its place


class Symbols:
    """One round's symbols: name, text, first word and end, and the words [low, high) that decide them."""

    def __init__(self, name: np.ndarray, text: np.ndarray, first: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.name, self.text, self.first, self.end, self.low, self.high = name, text, first, end, low, high

    def merged(self, head: np.ndarray, name: np.ndarray, low: np.ndarray, high: np.ndarray) -> Symbols:
        """Neighbours joined: a symbol begins at each head. low and high decide, for each old symbol, its part and its borders."""
        last = np.append(head[1:], len(self.name)) - 1
        return Symbols(name, self.text[head], self.first[head], self.end[last], np.minimum.reduceat(low, head), np.maximum.reduceat(high, head))

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether each symbol has a predecessor and a successor in its text."""
        same = self.text[1:] == self.text[:-1]
        return np.concatenate(([False], same)), np.concatenate((same, [False]))

    def runs_named(self) -> Symbols:
        """Runs of equal symbols joined; a run's borders are decided by the symbols beside it, a text's end by no window."""
        has_left, has_right = self.neighbours()
        equal = np.concatenate(([False], (self.name[1:] == self.name[:-1]) & has_left[1:]))
        head = np.flatnonzero(~equal)
        n = np.diff(np.append(head, len(self.name)))
        name = np.where(n > 1, mix(self.name[head] * _K + n.astype(np.uint64)), self.name[head])
        low = np.where(has_left, np.concatenate(([0], self.low[:-1])), -_FAR)
        high = np.where(has_right, np.concatenate((self.high[1:], [0])), _FAR)
        return self.merged(head, name, low, high)

    def pairs_named(self, round_: int) -> Symbols:
        """Left-side symbols joined with right-side successors; a left symbol depends on what follows, a right one on what precedes."""
        has_left, has_right = self.neighbours()
        right = (mix(self.name + np.uint64((round_ + 1) * int(_K) % 2**64)) & np.uint64(1)) > 0
        joined = np.concatenate(([False], ~right[:-1] & right[1:] & has_left[1:]))
        head = np.flatnonzero(~joined)
        pair = np.diff(np.append(head, len(self.name))) > 1
        following = self.name[np.minimum(head + 1, len(self.name) - 1)]
        name = np.where(pair, mix((self.name[head] + np.uint64(1)) * _K + mix(following)), self.name[head])
        low = np.where(right, np.where(has_left, np.concatenate(([0], self.low[:-1])), -_FAR), self.low)
        high = np.where(right, self.high, np.where(has_right, np.concatenate((self.high[1:], [0])), _FAR))
        return self.merged(head, name, np.minimum(low, self.low), np.maximum(high, self.high))


def _least(names: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Place of the smallest name (by its upper bits) in each range [first, end), which isn't empty; the first of equal ones."""
    packed = (names & ~_PLACE) | np.arange(len(names), dtype=np.uint64)
    level = np.frexp((end - first).astype(np.float64))[1] - 1
    best = np.empty(len(first), np.uint64)
    table = packed
    for k in range(int(level.max(initial=-1)) + 1):
        at = np.flatnonzero(level == k)
        best[at] = np.minimum(table[first[at]], table[end[at] - (1 << k)])
        if len(table) > 1 << k:
            table = np.minimum(table[: -(1 << k)], table[1 << k :])
    return (best & _PLACE).astype(np.int64)


def word_units(texts: Texts, first: np.ndarray | None = None, end: np.ndarray | None = None, of: np.ndarray | None = None) -> Units:
    """The words of the texts, laid out with one space between them so that equal runs of words are equal bytes."""
    if first is None or end is None or of is None:
        first, end, of = texts.words()
    size = end - first + 1
    finish = np.cumsum(size)
    at = np.repeat(first - finish + size, size) + np.arange(finish[-1] if len(finish) else 0)
    flat = np.append(texts.data, np.uint8(32))[at]
    flat[finish - 1] = 32
    edges = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=texts.n))))
    return Units(flat.tobytes(), edges, finish - size, finish - 1)


def phrases(texts: Texts, window: int = WINDOW, rounds: int = ROUNDS) -> Parsed:
    """The texts' words cut into phrases by the triggers of their windows."""
    first, end, of = texts.words()
    out = Parsed(word_units(texts, first, end, of))
    if len(of) < window:
        return out
    start = np.flatnonzero(of[window - 1 :] == of[: len(of) - window + 1])
    if not len(start):
        return out
    trigger, owner = np.zeros(len(start), np.uint64), np.full(len(start), -1, np.int64)
    place = np.arange(len(of))
    words = word_names(texts.data, first, end)
    symbols = Symbols(words, of, place, place + 1, place, place + 1)
    levels = [symbols]
    for r in range(rounds):
        symbols = symbols.runs_named().pairs_named(r)
        levels.append(symbols)
    prefix = ONE.prefix(words)
    open_ = np.arange(len(start))
    for r in range(rounds, -1, -1):
        s = levels[r]
        some = np.flatnonzero((s.low >= 0) & (s.high <= len(of)))  # those that a text's border doesn't decide
        if not len(some) or not len(open_):
            continue
        low, high = s.low[some], s.high[some]
        name = mix(ONE.spans(prefix, low, high) + (s.first[some] - low).astype(np.uint64) * _K + np.uint64(r))
        a, b = np.searchsorted(low, start[open_]), np.searchsorted(high, start[open_] + window, side="right")
        seen = b > a
        at = _least(name, a[seen], b[seen])
        trigger[open_[seen]], owner[open_[seen]] = name[at], (some[at] << 4) | r
        open_ = open_[~seen]
    new = np.ones(len(start), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)
    heads = np.flatnonzero(new)
    out.first, out.windows = start[heads], np.diff(np.append(heads, len(start)))
    out.text, out.trigger = of[out.first], trigger[heads]
    return out


def repeated_spans(texts: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """(doc, tie, twin, start, length) spans of words that are covered by windows which start earlier as well. texts: of `placed`."""
    parsed = parse(texts, partial(phrases, window=window, rounds=rounds), window)
    return later_phrases(parsed, window).unionByName(later_windows(texts, parsed.where("is_first"), word_units, window))


def remove_repeated_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, rounds: int = ROUNDS, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, n_units, n_removed, n_spans, kept, kept_text, kept_sha256, extra) of each document, in words; kept words are joined by one space.

    A word goes if it lies in a run of `window` words that starts earlier as well: in a document of smaller id, or
    earlier in its own. Null texts have no words; null ids come last; documents of one id are ordered by two hashes of
    their texts, and of equal rows all but one are later copies. Runs never cross documents. Other columns are not read,
    except those to keep, which come in the struct extra. Phrases and windows are named by a 128-bit hash, and a task's
    memory grows with its longest text.
    """
    texts = bucketed(counted(placed(docs, doc_id, text, keep)))

    def cut(data: bytes, spans: np.ndarray | None) -> tuple[bytes, int, int, int]:
        words = data.split()
        n = len(words)
        gone = marked(spans[0], spans[1], n) if spans is not None else np.full(n, n >= window)
        return b" ".join([w for w, g in zip(words, gone.tolist()) if not g]), n, int(gone.sum()), len(runs(gone)[0])

    return removed(texts, repeated_spans(texts, window, rounds), cut)
