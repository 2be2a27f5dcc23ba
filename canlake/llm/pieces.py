"""SentencePiece encoding and decoding with distinct sampled segmentations (Gumbel top-k without replacement).

A text's lattice has all its segmentations into pieces; a piece's weight gives the segmentations a distribution. Sampling
without replacement perturbs every segmentation with a Gumbel variable and takes the largest. The perturbed A-star
search gets them without listing the segmentations: the frontier holds sets of segmentations with a common prefix,
with their total probability from a backward pass as exact heuristic and the perturbed maximum of the set as priority.
A set is popped, its best member is drawn piece by piece, and the sets that branch off its path join the frontier.

A perturbed value G is kept as the time exp(-G) of an exponential race, in which the maximum of a set with probability p
arrives after an exponential time of rate p. The sets that branch off one path form one race of their joint rate, whose
next arrival is drawn when it is needed; that has the same distribution as drawing each set's own.

Lattices don't cross the borders of words (a piece holds blanks in front only), so they are built once for each distinct word
of a batch, for all words at a time: a walk through a trie of pieces from every byte, a backward pass by distance from the
word's end, and a forward walk of all words of all texts, which draws one piece of each word in a step.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canlake.llm.common import batches
from canlake.llm.text_arrays import STARTS, Texts, mix, word_names

#: Segmentations of a text, and the exponent that sharpens (above 1) or flattens the distribution.
SAMPLES, SHARPNESS = 2, 1.0
BATCH_BYTES = 1 << 20
_GAMMA = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_BLANK = "▁"


@dataclass
class Vocabulary:
    """Pieces as bytes (blanks as spaces), their log weights, and a trie over classes of bytes; of fixed size, so it can be broadcast."""

    pieces: list[bytes]
    weight: np.ndarray
    byte_piece: np.ndarray
    classes: np.ndarray
    move: np.ndarray
    final: np.ndarray
    longest: int

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a SentencePiece model with byte fallback. A merge's score is its negated rank; it is weighed by Zipf's law."""
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        pieces = [b"" if model.is_control(i) or model.is_unknown(i) else bytes([int(model.id_to_piece(i)[1:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace(_BLANK, " ").encode() for i in ids]
        usable = [i for i in ids if pieces[i] and not model.is_byte(i)]
        if any(b" " in pieces[i].lstrip(b" ") for i in usable):
            raise ValueError("a piece has a blank after another character")
        byte_piece = np.full(256, -1, np.int64)
        for i in ids:
            if model.is_byte(i):
                byte_piece[pieces[i][0]] = i
        if (byte_piece < 0).any():
            raise ValueError("the model has no byte fallback")
        # characters that merges start from have a very low score; they and bytes rank behind all merges
        scores = np.array([max(model.get_score(i), -float(len(pieces))) for i in ids])
        rank = np.where(np.isin(ids, usable), -scores, len(pieces))
        weight = SHARPNESS * -np.log(2.0 + rank)
        used = sorted({b for i in usable for b in pieces[i]})
        classes = np.full(256, len(used), np.int64)
        classes[used] = np.arange(len(used))
        nodes: list[dict[int, int]] = [{}]
        ends = {}
        for i in usable:
            at = 0
            for b in pieces[i]:
                if b not in nodes[at]:
                    nodes[at][b] = len(nodes)
                    nodes.append({})
                at = nodes[at][b]
            ends[at] = i
        move = np.full((len(nodes), len(used) + 1), -1, np.int32)
        for at, children in enumerate(nodes):
            for b, to in children.items():
                move[at, classes[b]] = to
        final = np.full(len(nodes), -1, np.int32)
        final[list(ends)] = list(ends.values())
        return cls(pieces, weight, byte_piece, classes, move, final, max(len(pieces[i]) for i in usable))


@dataclass
class Lattice:
    """Arcs by their first node: node n has arcs[head[n]:head[n + 1]]; an arc's share is the log of its chance at its node."""

    head: np.ndarray
    target: np.ndarray
    piece: np.ndarray
    source: np.ndarray
    share: np.ndarray
    chance: np.ndarray


def lattice(data: np.ndarray, edges: np.ndarray, vocabulary: Vocabulary) -> Lattice:
    """The lattices of words data[edges[i]:edges[i + 1]]. Word i has a node before each of its bytes and one at its end."""
    n, words = len(data), len(edges) - 1
    size = np.diff(edges)
    word = np.repeat(np.arange(words), size)
    left = (np.repeat(edges[1:], size) - np.arange(n)).astype(np.int32)  # bytes to the word's end
    node = (np.arange(n) + word).astype(np.int32)
    codes, boundary = vocabulary.classes[data].astype(np.int32), np.append(STARTS[data], True)
    boundary[edges[:-1]] = True
    sources, lengths, names = [], [], []
    at = np.flatnonzero(boundary[:-1]).astype(np.int32)
    state = np.zeros(len(at), np.int32)
    for k in range(vocabulary.longest):
        inside = left[at] > k
        at, state = at[inside], state[inside]
        state = vocabulary.move[state, codes[at + k]]
        alive = state >= 0
        at, state = at[alive], state[alive]
        if not len(at):
            break
        done = vocabulary.final[state]
        hit = (done >= 0) & (boundary[at + k + 1] | (left[at] == k + 1))
        sources.append(at[hit])
        lengths.append(np.full(int(hit.sum()), k + 1, np.int32))
        names.append(done[hit])
    # characters that aren't pieces go byte by byte
    starts = np.flatnonzero(boundary[:-1])
    char = np.diff(np.append(starts, n))
    pieces_from = np.concatenate(sources) if sources else np.zeros(0, np.int32)
    piece_len = np.concatenate(lengths) if lengths else np.zeros(0, np.int32)
    char_at = np.zeros(n, np.int64)
    char_at[starts] = char
    lone = np.ones(n, bool)
    lone[pieces_from[piece_len == char_at[pieces_from]]] = False
    spread = (np.flatnonzero(lone[np.repeat(starts, char)]) if n else starts).astype(np.int32)
    source = np.concatenate((pieces_from, spread))
    length = np.concatenate((piece_len, np.ones(len(spread), np.int32)))
    piece = np.concatenate((*names, vocabulary.byte_piece[data[spread]])).astype(np.int32)
    order = np.argsort(source, kind="stable")
    source, length, piece = source[order], length[order], piece[order]

    nodes = n + words
    head = np.zeros(nodes + 1, np.int64)
    np.cumsum(np.bincount(node[source], minlength=nodes), out=head[1:])
    target, gain = node[source] + length, vocabulary.weight[piece]
    value, share = np.full(nodes, -np.inf), np.empty(len(source))
    value[edges[1:] + np.arange(words)] = 0.0
    far = left[source]
    by_distance = np.argsort(far.astype(np.uint16) if far.max(initial=0) < 65536 else far, kind="stable")
    groups = np.flatnonzero(np.diff(far[by_distance], prepend=-1))
    for a, b in zip(groups, np.append(groups[1:], len(by_distance))):
        arcs = by_distance[a:b]
        total = gain[arcs] + value[target[arcs]]
        heads = np.flatnonzero(np.diff(source[arcs], prepend=-1))
        most = np.maximum.reduceat(total, heads)
        spans = np.diff(np.append(heads, len(arcs)))
        sums = most + np.log(np.add.reduceat(np.exp(total - np.repeat(most, spans)), heads))
        value[node[source[arcs[heads]]]] = sums
        share[arcs] = total - np.repeat(sums, spans)
    return Lattice(head, target, piece, node[source], share, np.exp(share))


def _uniform(key: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from mixed counters."""
    return ((mix(key) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def walk(lat: Lattice, start: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A drawn way from each start node to its word's end: walker and arc of each step, by walker and step."""
    walker, at, counter = np.arange(len(start)), start, key
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        first, last = lat.head[at], lat.head[at + 1] - 1
        going = last >= first
        if not going.all():
            walker, counter, first, last = walker[going], counter[going], first[going], last[going]
        if not len(walker):
            break
        counter = counter + _GAMMA
        arc = first
        open_ = np.flatnonzero(last > first)  # the first arc is the only one elsewhere
        rest, most = _uniform(counter[open_]), last[open_]
        while len(open_):
            rest = rest - lat.chance[arc[open_]]
            more = (rest > 0) & (arc[open_] < most)
            open_, rest, most = open_[more], rest[more], most[more]
            arc[open_] += 1
        steps.append((walker, arc))
        at = lat.target[arc]
    if not steps:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    walkers, arcs = (np.concatenate(x) for x in zip(*steps))
    order = np.argsort(walkers, kind="stable")
    return walkers[order], arcs[order]


class Path:
    """A segmentation: word and arc of each step, and the log probability of the prefix before each step and of the whole."""

    def __init__(self, lat: Lattice, word: np.ndarray, arc: np.ndarray) -> None:
        self.word, self.arc = word, arc
        self.upto = np.zeros(len(arc) + 1)
        np.cumsum(lat.share[arc], out=self.upto[1:])


class Race:
    """The sets that branch off a path at its steps from `first` on, without those that have arrived.

    Their joint rate is a difference of prefix probabilities. Once most of it has arrived, what is left is listed and
    summed, so that rare sets aren't lost to rounding; sets whose probability underflows never arrive.
    """

    def __init__(self, path: Path, first: int) -> None:
        self.path, self.first, self.gone = path, first, set()
        self.below = -np.exp(path.upto[first:])  # ascending
        self.rate = self.whole = float(self.below[-1] - self.below[0])
        self.listed: list[tuple[int, int, float]] | None = None

    def settle(self, lat: Lattice) -> None:
        if self.listed is None and self.rate > 1e-3 * self.whole and self.rate > -1e-3 * float(self.below[0]):
            return
        if self.listed is None:
            self.listed = []
            for step in range(self.first, len(self.path.arc)):
                node, taken = lat.source[self.path.arc[step]], self.path.arc[step]
                self.listed += [(step, arc, float(np.exp(self.path.upto[step] + lat.share[arc]))) for arc in range(int(lat.head[node]), int(lat.head[node + 1])) if arc != taken and (step, arc) not in self.gone]
        self.rate = sum(m for _, _, m in self.listed)

    def branch(self, lat: Lattice, draw: Callable[[], float]) -> tuple[int, int]:
        """The next set, by its probability: its step and first arc. One that has gone, or a step without a choice, is drawn again."""
        if self.listed is not None:
            left = draw() * self.rate
            for i, (step, arc, mass) in enumerate(self.listed):
                left -= mass
                if left <= 0 or i == len(self.listed) - 1:
                    del self.listed[i]
                    return step, arc
        while True:
            u = self.below[0] + draw() * (self.below[-1] - self.below[0])
            step = min(max(int(np.searchsorted(self.below, u)) - 1, 0), len(self.below) - 2) + self.first
            taken = self.path.arc[step]
            node = lat.source[taken]
            left = draw() * (1.0 - lat.chance[taken])
            for arc in range(int(lat.head[node]), int(lat.head[node + 1])):
                left -= lat.chance[arc] if arc != taken else 0.0
                if left <= 0 and arc != taken:
                    if (step, arc) in self.gone:
                        break
                    self.gone.add((step, arc))
                    self.rate -= float(np.exp(self.path.upto[step] + lat.share[arc]))
                    return step, arc


class Search:
    """The perturbed A-star search of one text."""

    def __init__(self, lat: Lattice, seed: int, first: Path) -> None:
        self.lat, self.state = lat, seed
        self.frontier: list[tuple[float, int, Race]] = []
        self.found = [(first, -np.log(self.draw()))]
        self.push(Race(first, 0), self.found[0][1])

    def draw(self) -> float:
        """The next number of the row's own splitmix sequence."""
        self.state = (self.state + 0x9E3779B97F4A7C15) % 2**64
        x = self.state
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) % 2**64
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) % 2**64
        return (((x ^ (x >> 31)) >> 11) + 0.5) * 2.0**-53

    def push(self, race: Race, now: float) -> None:
        """The race's next arrival joins the frontier."""
        race.settle(self.lat)
        if race.rate > 0:
            heapq.heappush(self.frontier, (now - np.log(self.draw()) / race.rate, len(self.frontier), race))

    def pop(self) -> tuple[float, Path, int, int] | None:
        """The next set to arrive: its time, the path it branches off, the step and the arc."""
        if self.frontier:
            now, _, race = heapq.heappop(self.frontier)
            branch = race.branch(self.lat, self.draw)
            self.push(race, now)
            return now, race.path, *branch
        return None

    def results(self, threshold: float) -> Iterator[tuple[np.ndarray, float, float, float]]:
        """Arcs, log probability, perturbed log probability and log inclusion probability of what was found.

        The last is the chance to pass the perturbed value of the next segmentation; it is 1 if there is none.
        """
        for path, time in self.found:
            log_p = float(path.upto[-1])
            hit = log_p + np.log(threshold) if np.isfinite(threshold) else np.inf
            included = 0.0 if hit == np.inf else hit if hit < -30 else float(np.log(-np.expm1(-np.exp(min(hit, 700.0)))))
            yield path.arc, log_p, float(-np.log(time)), min(included, 0.0)


def encode_batch(texts: Texts, keys: np.ndarray, vocabulary: Vocabulary, samples: int) -> Iterator[tuple[int, int, np.ndarray, float, float, float]]:
    """(text number, rank from 1, piece ids, log probability, perturbed value, log inclusion) of each text's samples."""
    # a blank in front of every text, as the model's own encoder has it
    data = np.insert(texts.data, texts.offsets[:-1], 32)
    offsets = texts.offsets + np.arange(texts.n + 1)
    space = data == 32
    opens = np.concatenate(([True], space[1:] & ~space[:-1])) if len(data) else np.zeros(0, bool)
    opens[offsets[:-1]] = True
    first = np.flatnonzero(opens)
    end = np.append(first[1:], len(data))
    of = np.searchsorted(offsets, first, side="right") - 1
    names = word_names(data, first, end)
    _, where, kind = np.unique(names, return_index=True, return_inverse=True)
    length = (end - first)[where]
    edges = np.concatenate(([0], np.cumsum(length)))
    flat = data[np.repeat(first[where] - edges[:-1], length) + np.arange(edges[-1])]
    lat = lattice(flat, edges, vocabulary)
    start = (edges[:-1] + np.arange(len(where)))[kind]
    word_at = np.searchsorted(of, np.arange(texts.n + 1))
    spread = np.arange(len(first), dtype=np.uint64) - word_at[of].astype(np.uint64)
    walker, arcs = walk(lat, start, mix(keys[of] + spread * _STEP))
    bounds = np.searchsorted(walker, word_at)
    searches = [Search(lat, int(keys[t]), Path(lat, walker[a:b] - word_at[t], arcs[a:b])) for t, (a, b) in enumerate(zip(bounds[:-1], bounds[1:]))]
    open_ = list(range(texts.n))
    for rank in range(2, samples + 1):  # all texts' next segmentations are drawn in one walk
        branches = [(t, b) for t in open_ if (b := searches[t].pop())]
        open_ = [t for t, _ in branches]
        if not open_:
            break
        parts, salts = [], []
        for t, (_, path, step, arc) in branches:
            part = np.append(lat.target[arc], start[word_at[t] + path.word[step] + 1 : word_at[t + 1]])
            parts.append(part)
            salts.append(keys[t] + np.arange(len(part), dtype=np.uint64) * _STEP)
        walker, arcs = walk(lat, np.concatenate(parts), mix(np.concatenate(salts) ^ (np.uint64(rank * 0x1000003))))
        base = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        bounds = np.searchsorted(walker, base)
        for i, (t, (now, path, step, arc)) in enumerate(branches):
            a, b, inside = bounds[i], bounds[i + 1], path.word[step]
            new = Path(lat, np.concatenate((path.word[:step], [inside], walker[a:b] - base[i] + inside)), np.concatenate((path.arc[:step], [arc], arcs[a:b])))
            searches[t].found.append((new, now))
            searches[t].push(Race(new, step + 1), now)
    for t, search in enumerate(searches):
        after = search.pop()
        for rank, (ids, *values) in enumerate(search.results(after[0] if after else np.inf), 1):
            yield t, rank, lat.piece[ids], *values


def decode(ids: np.ndarray, vocabulary: Vocabulary) -> bytes:
    """The text of piece ids, without the blank in front."""
    return b"".join([vocabulary.pieces[i] for i in ids.tolist()])[1:]


_COLUMNS = "rank int, n_pieces int, log_prob double, perturbed double, log_inclusion double, ids_crc32 long, decodes boolean"


def sample_encodings(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text", samples: int = SAMPLES, with_ids: bool = True) -> DataFrame:
    """docs' ids with up to `samples` distinct segmentations of each whole text, ordered by perturbed value (rank from 1).

    Each has its number of pieces, log probability, perturbed log probability, log inclusion probability, a CRC-32 of
    its ids (32-bit little-endian), whether it decodes to the text, and the ids if asked for. Draws depend on the row's
    id and text only. A null or empty text has one segmentation, a blank; a null id counts as 0; equal rows get equal samples; texts
    with fewer segmentations than asked for give all of them. Other columns are not read.
    """
    told = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path))  # the vocabulary's size is fixed

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = told.value
        for b in batches(rows, BATCH_BYTES):
            texts = Texts(b.column(1))
            ids = b.column(0).to_pylist()
            keys = mix(np.array([(i or 0) % 2**64 for i in ids], np.uint64) * _GAMMA + np.uint64(samples))
            out: list[tuple] = []
            kept: list[np.ndarray] = []
            for t, rank, pieces, log_p, perturbed, included in encode_batch(texts, keys, vocabulary, samples):
                same = decode(pieces, vocabulary) == texts.data[texts.offsets[t] : texts.offsets[t + 1]].tobytes()
                small = pieces.astype("<i4")
                out.append((ids[t], rank, len(pieces), log_p, perturbed, included, zlib.crc32(small.tobytes()), same))
                if with_ids:
                    kept.append(small)
            table = [pa.array(c, k) for c, k in zip(zip(*out), [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_()])]
            names = ["doc_id", "rank", "n_pieces", "log_prob", "perturbed", "log_inclusion", "ids_crc32", "decodes"]
            if with_ids:
                ends = np.concatenate(([0], np.cumsum([len(k) for k in kept]))).astype(np.int32)
                table.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(table, names)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {_COLUMNS}" + (", ids array<int>" if with_ids else ""))


def decode_texts(encoded: DataFrame, model_path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """encoded with the text of its piece ids; null ids give a null text, and bytes that aren't UTF-8 are replaced."""
    told = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path))
    keep = [c for c in encoded.columns if c != out]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            lists = b.column(b.schema.get_field_index(ids)).to_pylist()
            texts = [None if x is None else decode(np.array(x, np.int64), told.value).decode("utf-8", "replace") for x in lists]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*keep, out])

    encoded = encoded.select(*keep)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema], f"`{out}` string"])
    return encoded.mapInArrow(run, schema)
