"""What the two operators that remove long repeats share: the order of documents, the parse and its dictionary, and the removal itself.

The texts are written once in buckets of their key. Phrases meet at their trigger in one shuffle; what is looked at
again, the contents of some phrases and the final removal, comes back to the texts by key, so only small rows move.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canlake.llm.common import batches, shared_dir, written
from canlake.llm.text_arrays import Texts, mix

#: Bytes of text that a task handles at once, and windows that it names at once.
BATCH, WINDOWS = 1 << 20, 1 << 18
_LAST, _SIGN = (1 << 63) - 1, -(1 << 63)
KEY = ["doc", "tie", "twin"]
PLACE = [*KEY, "start"]


def placed(docs: DataFrame, doc_id: str, text: str, keep: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """(doc_id, doc, tie, twin, text, extra): documents are ordered by id, nulls last, and documents of one id by two hashes.

    The hashes are those of the text, or of the columns `by`; the first one's sign tells null ids from all others.
    extra is a struct of the columns to keep, or null.
    """
    known, of = F.col(doc_id).isNotNull(), [F.col(c) for c in by] if by else [F.coalesce(F.col(text), F.lit(""))]
    first = F.xxhash64(*of)
    tie = F.when(known, first.bitwiseOR(F.lit(_SIGN))).otherwise(first.bitwiseAND(F.lit(_LAST)))
    order = [F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias("doc"), tie.alias("tie"), F.xxhash64(F.lit("twin"), *of).alias("twin")]
    extra = F.struct(*keep) if keep else F.lit(None).cast("int")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), *order, F.coalesce(F.col(text), F.lit("")).alias("text"), extra.alias("extra"))


def counted(rows: DataFrame) -> DataFrame:
    """The distinct rows of `placed` with their number n; only repeated rows are shuffled."""
    repeats = written(rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*KEY), "copies")
    if not repeats.limit(1).count():
        return rows.withColumn("n", F.lit(1).cast("long"))
    alone = rows.join(repeats, KEY, "left_anti").withColumn("n", F.lit(1).cast("long"))
    return alone.unionByName(rows.join(repeats, KEY, "left_semi").groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")))


def bucketed(rows: DataFrame) -> DataFrame:
    """The rows written in buckets of their key, so that later joins by key don't shuffle them. The table is left to no catalogue."""
    spark = rows.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"texts_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    rows.repartition(n, *KEY).write.bucketBy(n, *KEY).option("compression", "zstd").option("path", path).saveAsTable(name)
    out = spark.table(name)
    out.schema  # noqa: B018  resolved before the name goes
    spark.sql(f"DROP TABLE {name}")
    return out


class Units:
    """The units of a batch of texts, bytes or words: unit i is data[begin[i]:finish[i]], and `edges` has each text's first unit.

    A span of units is named by a 128-bit hash of its bytes, which must be alike wherever the same units stand.
    """

    def __init__(self, data: bytes, edges: np.ndarray, begin: np.ndarray | None = None, finish: np.ndarray | None = None) -> None:
        self.data, self.edges, self.begin, self.finish = data, edges, begin, finish

    def contents(self, first: np.ndarray, end: np.ndarray) -> list[bytes]:
        if self.begin is not None and self.finish is not None and len(first):
            first, end = self.begin[first], self.finish[end - 1]
        data = self.data
        return [data[a:b] for a, b in zip(first.tolist(), end.tolist())]

    def names(self, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        digests = b"".join([xxhash.xxh3_128_digest(x) for x in self.contents(first, end)])
        both = np.frombuffer(digests, np.uint64).reshape(-1, 2)
        return both[:, 0].copy(), both[:, 1].copy()


class Parsed:
    """A batch's units, cut into phrases: runs of windows with one trigger.

    A phrase has its text, its first window's unit, its number of windows, and its trigger's name. Equal windows must
    have equal triggers.
    """

    def __init__(self, units: Units) -> None:
        self.units = units
        self.text = self.first = self.windows = np.zeros(0, np.int64)
        self.trigger = np.zeros(0, np.uint64)


Parser = Callable[[Texts], Parsed]


def _keys(b: pa.RecordBatch) -> list[np.ndarray]:
    return [b.column(b.schema.get_field_index(c)).to_numpy() for c in KEY]


def _order(keys: list[np.ndarray]) -> np.ndarray:
    """The rank of each row by its key, equal keys alike."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), np.int64)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def seen_before(name: np.ndarray, other: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which of the names stand at a smaller place in the same batch as well."""
    order = np.lexsort((place, name))
    head = np.ones(len(order), bool)
    head[1:] = (name[order][1:] != name[order][:-1]) | (other[order][1:] != other[order][:-1])
    out = np.zeros(len(order), bool)
    if len(order):
        out[order] = place[order] != place[order][np.flatnonzero(head)][np.cumsum(head) - 1]
    return out


def _joined(text: np.ndarray, first: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Heads of runs of spans that go on from each other in one text, and the windows of each run."""
    head = np.ones(len(text), bool)
    head[1:] = (text[1:] != text[:-1]) | (first[1:] != first[:-1] + windows[:-1])
    at = np.flatnonzero(head)
    return at, np.add.reduceat(windows, at) if len(at) else windows


def _candidates(columns: dict[str, np.ndarray], own: np.ndarray, keys: list[np.ndarray], text: np.ndarray, first: np.ndarray, windows: np.ndarray, edges: np.ndarray) -> pa.RecordBatch:
    """Rows of spans: those that may be the first of their name, and joined runs of those whose batch has them before (own).

    Names of the latter are replaced by numbers that spread them, so that many copies don't meet in one task.
    """
    first_own, windows_own = first[own], windows[own]
    heads, joined = _joined(text[own], first_own, windows_own)
    of = np.concatenate((text[~own], text[own][heads]))
    start = np.concatenate((first[~own], first_own[heads])) - edges[of]
    spread = mix(keys[1][of[len(of) - len(heads) :]].view(np.uint64) + start[len(of) - len(heads) :].astype(np.uint64))
    names = [longs(np.concatenate((v[~own], spread))) for v in columns.values()]
    n = np.concatenate((windows[~own], joined))
    flag = np.concatenate((np.zeros(len(of) - len(heads), bool), np.ones(len(heads), bool)))
    return pa.RecordBatch.from_arrays([*names, *[longs(k[of]) for k in keys], ints(start), ints(n), pa.array(flag)], [*columns, *PLACE, "windows", "own"])


def parse(texts: DataFrame, parser: Parser, window: int) -> DataFrame:
    """A written row for each phrase that is to be looked at: later ones of their name, and first ones whose trigger others share.

    (trigger, doc, tie, twin, start, windows, is_first, kin); kin counts the distinct phrases of a first one's trigger.
    """

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(found, BATCH):
            p = parser(Texts(b.column(b.schema.get_field_index("text"))))
            keys = _keys(b)
            name, other = p.units.names(p.first, p.first + p.windows + window - 1)
            own = seen_before(name, other, (_order(keys)[p.text] << 32) | (p.first - p.units.edges[p.text]))
            yield _candidates({"trigger": p.trigger, "name": name, "other": other}, own, keys, p.text, p.first, p.windows, p.units.edges)

    phrases = texts.select(*KEY, "text").mapInArrow(run, "trigger long, name long, other long, doc long, tie long, twin long, start int, windows int, own boolean")
    same = Window.partitionBy("trigger", "own", "name", "other").orderBy(*PLACE)
    told = phrases.repartition("trigger").withColumn("is_first", ~F.col("own") & (F.rank().over(same) == 1))
    told = told.withColumn("kin", F.count_if("is_first").over(Window.partitionBy("trigger", "own")))
    kept = told.where(~F.col("is_first") | (F.col("kin") > 1))
    return written(kept.select(F.when(F.col("is_first"), F.col("trigger")).alias("trigger"), *PLACE, "windows", "is_first", "kin"), "parse")


def later_phrases(phrases: DataFrame, window: int) -> DataFrame:
    """Spans of the phrases that aren't the first of their name: all their windows are repeats."""
    return phrases.where("not is_first").select(*PLACE, (F.col("windows") + (window - 1)).alias("length"))


def with_entries(texts: DataFrame, entries: DataFrame) -> DataFrame:
    """(doc, tie, twin, text, entries) of the texts that have dictionary phrases, which are listed as (trigger, start, windows)."""
    lists = entries.groupBy(*KEY).agg(F.collect_list(F.struct("trigger", "start", "windows")).alias("entries"))
    return texts.select(*KEY, "text").join(lists, KEY)


def entry_arrays(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, trigger, start and windows of each entry of a batch of `with_entries`."""
    lists = b.column(b.schema.get_field_index("entries"))
    items = lists.flatten()
    owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    return owner, *[items.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)]


def later_windows(texts: DataFrame, entries: DataFrame, units: Callable[[Texts], Units], window: int) -> DataFrame:
    """Spans of the windows of dictionary phrases that start earlier in another one: Spark orders the places of each window's name."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(found, BATCH):
            u = units(Texts(b.column(b.schema.get_field_index("text"))))
            keys = _keys(b)
            rank = _order(keys)
            owner, _, start, windows = entry_arrays(b)
            order = np.lexsort((start, owner))
            owner, start, windows = owner[order], start[order], windows[order]
            upto = np.cumsum(windows)
            for low in range(0, int(upto[-1]) if len(upto) else 0, WINDOWS):
                n = np.minimum(upto, low + WINDOWS) - np.maximum(upto - windows, low)
                some = np.flatnonzero(n > 0)
                skipped = np.maximum(low - (upto - windows)[some], 0)
                n = n[some]
                text = np.repeat(owner[some], n)
                at = np.repeat(u.edges[owner[some]] + start[some] + skipped - (np.cumsum(n) - n), n) + np.arange(n.sum())
                name, other = u.names(at, at + window)
                own = seen_before(name, other, (rank[text] << 32) | (at - u.edges[text]))
                yield _candidates({"name": name, "other": other}, own, keys, text, at, np.ones(len(at), np.int64), u.edges)

    named = with_entries(texts, entries).mapInArrow(run, "name long, other long, doc long, tie long, twin long, start int, windows int, own boolean")
    same = Window.partitionBy("name", "other", "own").orderBy(*PLACE)
    return named.withColumn("at", F.rank().over(same)).where("own or at > 1").select(*PLACE, (F.col("windows") + (window - 1)).alias("length"))


def longs(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def ints(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.int32))


def marked(starts: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """Places below size in one of the spans."""
    step = np.bincount(starts, minlength=size + 1)[: size + 1] - np.bincount(np.minimum(starts + lengths, size), minlength=size + 1)[: size + 1]
    return np.cumsum(step)[:size] > 0


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of each run of set flags."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    first = np.flatnonzero(edge == 1)
    return first, np.flatnonzero(edge == -1) - first


def removed(texts: DataFrame, spans: DataFrame, cut: Callable[[bytes, np.ndarray], tuple[bytes, int, int, int]]) -> DataFrame:
    """One row for each document: (doc_id, n_units, n_removed, n_spans, kept, kept_text, kept_sha256, extra).

    kept is binary; kept_text is without the bytes of code points that were cut through. texts: counted rows. spans: (doc, tie, twin, start, length) in units of a document. cut(data, spans) gives the kept
    bytes, the units, those removed and the removed runs; it gets None for a further copy of an equal row, all of whose
    windows start earlier.
    """
    found = spans.groupBy(*KEY).agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy")
    joined = texts.join(found, KEY, "left").select("doc_id", "text", copies, "spans", "extra")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows, BATCH):
            out = []
            for doc, text, copy, items in zip(*b.columns[:4]):
                of = np.zeros((2, 0), np.int64)
                if items.is_valid:
                    of = np.array([items.values.field(0).to_numpy(), items.values.field(1).to_numpy()], np.int64)
                out.append((doc.as_py(), *cut(text.as_py().encode(), None if copy.as_py() else of)))
            ids, kept, units, gone, n_spans = zip(*out)
            arrays = [pa.array(ids, pa.int64()), pa.array(units, pa.int64()), pa.array(gone, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary()), pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), b.column(4)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_units", "n_removed", "n_spans", "kept", "kept_text", "kept_sha256", "extra"])

    return joined.mapInArrow(run, f"doc_id long, n_units long, n_removed long, n_spans long, kept binary, kept_text string, kept_sha256 string, extra {texts.schema['extra'].dataType.simpleString()}")
