"""Token counts by rank-synchronous array merging.

The pre-tokens of a batch are one flat array of symbols with the first place of each. In a round every pre-token finds
the lowest rank among its neighbouring pairs and applies it at all its places at once; pre-tokens without a pair that
merges leave with the number of their symbols. A batch's distinct words are merged together, once each, and a text counts
the tokens of its words.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from canlake.llm.common import batches

#: Words whose counts a task remembers between batches, and the longest of them in bytes.
REMEMBERED, LONGEST = 1 << 18, 256
_NONE = np.int64(1 << 40)
_PROBE = ("a", "b's", "12", "é!")


def _ascii_pattern(data: dict) -> str | None:
    """What a file's pre-tokens match in printable ASCII without blanks, where only case is normalised and bytes stand for themselves."""
    normal = [n["type"] for n in (data["normalizer"] or {}).get("normalizers", [])]
    steps = (data["pre_tokenizer"] or {}).get("pretokenizers", [])
    if set(normal) != {"NFC", "Replace", "Lowercase"} or [s["type"] for s in steps] != ["Split", "ByteLevel"]:
        return None
    blanks = [n["pattern"] for n in data["normalizer"]["normalizers"] if n["type"] == "Replace"]
    plain = blanks == [{"Regex": r"\s+"}] and (steps[0]["behavior"], steps[0]["invert"]) == ("Removed", True) and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
    return steps[0]["pattern"].get("Regex") if plain else None


@dataclass
class Merges:
    """A BPE model's merges as arrays, with its library's normaliser and pre-tokeniser; of fixed size."""

    definition: str
    keys: np.ndarray
    ranks: np.ndarray
    result: np.ndarray
    size: int
    first: np.ndarray
    last: np.ndarray
    together: bool
    specials: list[str]
    pattern: str | None = None
    _library: tuple | None = field(default=None, repr=False)

    @classmethod
    def load(cls, path: str) -> Merges:
        """From a tokenizers file with a BPE model over bytes. Options that change the merging are refused."""
        with open(path, encoding="utf-8") as f:
            definition = f.read()
        data = json.loads(definition)
        model = data["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd:
            raise ValueError(f"not a plain BPE model: {model['type']}, {odd}")
        added = data["added_tokens"]
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in added):
            raise ValueError("added tokens must match raw text as it stands, and hold no white space")
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        size = max(vocab.values()) + 1
        rank = {}
        for r, (a, b) in enumerate(pairs):  # of a pair that is listed twice, the later rank holds
            rank[vocab[a], vocab[b]] = (r, vocab[a + b])
        keys = np.array([a * size + b for a, b in rank], np.int64)
        order = np.argsort(keys)
        ranks, result = (np.array([v[i] for v in rank.values()], np.int64)[order] for i in (0, 1))
        # the chars that stand for bytes, alone and at the end of a pre-token
        chars = [c for c in vocab if len(c) == 1]
        first = np.full(max(map(ord, chars)) + 1, -1, np.int64)
        last = first.copy()
        for c in chars:
            first[ord(c)], last[ord(c)] = vocab[c], vocab.get(c + end, -1)
        made = {}
        for r, to in rank.values():
            made[to] = max(r, made.get(to, -1))
        together = all(made.get(s, -1) < r for (a, b), (r, _) in rank.items() for s in (a, b))
        return cls(definition, keys[order], ranks, result, size, first, last, together, [t["content"] for t in added], _ascii_pattern(data))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_library": None}

    def pre_tokens(self, text: str) -> list[str]:
        """The library's pre-tokens of a text without special strings, a char for each byte."""
        if self._library is None:
            made = Tokenizer.from_str(self.definition)
            self._library = (made.normalizer.normalize_str if made.normalizer else str, made.pre_tokenizer.pre_tokenize_str, regex.compile(self.pattern or "").findall)
        normal, split, find = self._library
        if self.pattern and text.isascii() and text.isprintable() and " " not in text:
            return find(text.lower())
        return [p for p, _ in split(normal(text))]

    def splits_at_space(self) -> bool:
        """Whether white space ends pre-tokens and is dropped, so that words can be counted apart from each other."""
        return self.pre_tokens(" \n".join(_PROBE) + "\t\r ") == [p for w in _PROBE for p in self.pre_tokens(w)]

    def count(self, pre_tokens: list[str]) -> np.ndarray:
        """Symbols that survive in each pre-token."""
        size = np.fromiter(map(len, pre_tokens), np.int64, len(pre_tokens))
        chars = np.frombuffer("".join(pre_tokens).encode("utf-32-le"), np.uint32)
        symbols = self.first[chars]
        ends = np.cumsum(size)
        filled = size > 0
        symbols[ends[filled] - 1] = self.last[chars[ends[filled] - 1]]
        if (symbols < 0).any():
            raise ValueError("the vocabulary lacks a byte")
        return self.merge(symbols, size)

    def merge(self, symbols: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Symbols left of each ragged row of `symbols`, of lengths `size`, after all merges."""
        left = size.copy()
        rows = np.flatnonzero(size > 1)
        symbols = symbols[np.repeat(size > 1, size)]
        size = size[rows]
        while len(rows):
            starts = np.cumsum(size) - size
            keys = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            rank = np.append(np.where(self.keys[at] == keys, self.ranks[at], _NONE), _NONE)
            rank[starts + size - 1] = _NONE  # the last symbol of a row has no neighbour
            least = np.minimum.reduceat(rank, starts)
            active = least < _NONE
            left[rows[~active]] = size[~active]
            hit = (rank == np.repeat(least, size)) & (rank < _NONE)
            place = np.flatnonzero(hit)
            if self.together:  # of places that overlap, as in aaa, every other one from the left
                begins = np.ones(len(place), bool)
                begins[1:] = place[1:] != place[:-1] + 1
                run = np.maximum.accumulate(np.where(begins, np.arange(len(place)), 0))
                place = place[(np.arange(len(place)) - run) % 2 == 0]
            else:  # a merge may make a pair of lower rank: one place of a row at a time
                of = np.searchsorted(starts, place, side="right")
                place = place[np.unique(of, return_index=True)[1]]
            symbols[place] = self.result[at[place]]
            stay = np.repeat(active, size)
            stay[place + 1] = False
            merged = np.bincount(np.searchsorted(starts, place, side="right") - 1, minlength=len(size))
            symbols, rows, size = symbols[stay], rows[active], (size - merged)[active]
            done = size == 1
            if done.any():
                left[rows[done]] = 1
                symbols, rows, size = symbols[np.repeat(~done, size)], rows[~done], size[~done]
        return left


class Counter:
    """Counts tokens of texts, with a bounded memory of words."""

    def __init__(self, merges: Merges) -> None:
        self.merges, self.known = merges, {}
        self.by_words = merges.splits_at_space()
        self.special = re.compile("|".join(map(re.escape, sorted(merges.specials, key=len, reverse=True))))

    def _parts(self, text: str) -> list[str]:
        parts = self.special.split(text) if self.merges.specials else [text]
        return [p for part in parts if part for p in self.merges.pre_tokens(part)]

    def learn(self, words: set[bytes]) -> None:
        """The counts of new words, all merged together."""
        fresh = list(words)
        texts = [w.decode() for w in fresh]
        parts = [self._parts(t) for t in texts]
        flat = list({p for part in parts for p in part})
        symbols = dict(zip(flat, self.merges.count(flat).tolist()))
        for word, text, part in zip(fresh, texts, parts):
            self.known[word] = sum(map(symbols.__getitem__, part)) + (len(self.special.findall(text)) if self.merges.specials else 0)

    def count(self, texts: list[bytes]) -> list[int]:
        split = [t.split() if self.by_words else [t] if t else [] for t in texts]
        new = set().union(*split).difference(self.known)
        if new:
            self.learn(new)
        out = [sum(map(self.known.__getitem__, words)) for words in split]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        else:
            for w in new:
                if len(w) > LONGEST:
                    del self.known[w]
        return out


def count_tokens(docs: DataFrame, path: str, limit: int | None = None, text: str = "text") -> DataFrame:
    """docs without its text, with n_bytes, n_tokens and over_limit (n_tokens above `limit`; null without one).

    Tokens are those that the library gives for the file at `path`, which only the driver reads, without added special
    tokens; special strings inside a text count as one token each. A null text is empty. Rows stay as they are; columns
    named like an output are replaced. A task holds 1 MB of texts, or its longest text.
    """
    merges = docs.sparkSession.sparkContext.broadcast(Merges.load(path))
    keep = [c for c in docs.columns if c not in (text, "n_bytes", "n_tokens", "over_limit")]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(merges.value)
        for b in batches(rows, column=text):
            texts = [t or b"" for t in b.column(b.schema.get_field_index(text)).cast(pa.large_binary()).to_pylist()]
            tokens = np.array(counter.count(texts), np.int64)
            over = pa.nulls(len(texts), pa.bool_()) if limit is None else pa.array(tokens > limit)
            made = [pa.array(list(map(len, texts)), pa.int64()), pa.array(tokens), over]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in keep], *made], [*keep, "n_bytes", "n_tokens", "over_limit"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema], "n_bytes long, n_tokens long, over_limit boolean"])
    return docs.select(*keep, text).mapInArrow(run, schema)
