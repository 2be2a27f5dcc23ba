"""Texts of an Arrow batch as flat numpy arrays: words, lines and hashes of spans without a Python loop over them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

# The constants of the published splitmix64 finaliser.
_M1, _M2, _GAMMA = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)

#: Byte tables: white space as `bytes.split()` has it, what starts a code point, and bytes read as others.
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
STARTS = (np.arange(256) & 0xC0) != 0x80
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
FOLDED = np.where(np.isin(np.arange(256), np.frombuffer(b"0123456789", np.uint8)), 48, LOWER).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Polynomial hashes modulo 2^64 of spans of a sequence, finished by a mix with the span's length."""

    def __init__(self, seed: int) -> None:
        self.seed = np.uint64(seed)
        ids = np.arange(256, dtype=np.uint64) + np.uint64(seed) * np.uint64(1000)
        self.bytes = mix(ids * _GAMMA + np.uint64(1))
        self.base = int(mix(np.array([seed + 77], np.uint64) * _GAMMA)[0]) | 5
        self.up = self.down = np.ones(1, np.uint64)

    def __reduce__(self) -> tuple:
        return _hasher, (int(self.seed),)  # tasks use their own module's, with its tables

    def _grow(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 2 * len(self.up), 1 << 16)
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                powers = np.full(n, base, np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """Sums of value * base^place before each place."""
        self._grow(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (prefix[end] - prefix[first]) * self.down[first]
        return mix(raw + (end - first).astype(np.uint64) * _GAMMA)

    def windows(self, prefix: np.ndarray, length: int) -> np.ndarray:
        """Hashes of all spans of this length, by their first place."""
        n = max(len(prefix) - length, 0)
        return mix((prefix[length:] - prefix[:n]) * self.down[:n] + np.uint64(length * int(_GAMMA) % 2**64))


_HASHERS = {seed: Hasher(seed) for seed in (1,)}


def _hasher(seed: int) -> Hasher:
    return _HASHERS[seed]


ONE = _HASHERS[1]

#: Longest word that a polynomial names: modulo 2^64 some long texts of two letters have equal hashes whatever the base.
_PLAIN = 64


def word_names(data: np.ndarray, first: np.ndarray, end: np.ndarray, prefix: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit name of each word data[first:end], by ONE, or for long ones by a hash of another kind."""
    names = ONE.spans(ONE.prefix(ONE.bytes[data]) if prefix is None else prefix, first, end)
    long = np.flatnonzero(end - first > _PLAIN)
    if len(long):
        names[long] = [xxhash.xxh3_64_intdigest(data[a:b].tobytes()) for a, b in zip(first[long].tolist(), end[long].tolist())]
    return names


class Texts:
    """The texts of an Arrow string array; a null is an empty text."""

    def __init__(self, array: pa.Array) -> None:
        if isinstance(array, pa.ChunkedArray):
            array = array.combine_chunks()
        array = array.cast(pa.large_binary())
        offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
        data = array.buffers()[2] if len(array) else None
        self.data = (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        self.n = len(array)

    def per_text(self, marks: np.ndarray) -> np.ndarray:
        """Sum over each text of one value for each byte."""
        total = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(marks, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte, end and text number of each word."""
        space = SPACE[self.data]
        inside = np.concatenate(([False], ~space, [False]))
        opens = inside[1:-1] & ~inside[:-2]
        closes = inside[1:-1] & ~inside[2:]
        edges = self.offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(space))]
        opens[edges] |= ~space[edges]
        closes[edges - 1] |= ~space[edges - 1]
        first, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        return first, end, np.searchsorted(self.offsets, first, side="right") - 1

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte, end and text number of each line that isn't empty."""
        cuts = np.flatnonzero(self.data == 10)
        first = np.unique(np.concatenate((self.offsets[:-1], cuts + 1)))
        first = first[first < len(self.data)]
        end = np.append(first[1:], len(self.data))
        number = np.searchsorted(self.offsets, first, side="right") - 1
        newline = self.data[np.maximum(end - 1, 0)] == 10
        end = end - (newline & (end > first))
        whole = end > first
        return first[whole], end[whole], number[whole]


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur more than once, and which occur before in the array."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order][1:] == keys[order][:-1]
    more, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    more[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return more, later


def covered(first: np.ndarray, length: int, size: int) -> np.ndarray:
    """Places below size in a span of this length that starts at one of `first`."""
    step = np.bincount(first, minlength=size + length + 1) - np.bincount(first + length, minlength=size + length + 1)
    return np.cumsum(step)[:size] > 0
