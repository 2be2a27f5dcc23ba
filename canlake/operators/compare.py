"""Comparison of two logs; a log is a frames table, and swapping logs is swapping arguments.

Spark counts each ID's histograms of bytes, steps and lengths in both logs; what they mean is judged for each ID from these
small tables (see judging). The cells of frames are counted by numpy over Arrow batches, in the tasks that have the frames.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canlake import schema
from canlake.functions import frames as ff
from canlake.operators import judging
from canlake.operators.history import spans_of, with_index, with_previous
from canlake.operators.judging import FORMAT_SCORE, MIN_FRAMES, RATE_TOLERANCE, RATE_WEIGHT, SIGNIFICANT, STRETCHES
from canlake.operators.stats import bit_flips, byte_histogram
from canlake.operators.stored import stored

#: Bytes of a payload that are compared.
COMPARED = 64
_RESULT = "score int, reason string, bytes array<struct<byte:int,score:int,reason:string,bits:array<double>,new_values:array<int>,only_in_a:array<int>,counter:int,checksum:int>>, too_few boolean, payloads_differ boolean, within_a boolean"


def _profile(log: DataFrame, name: str) -> DataFrame:
    return log.groupBy("channel", "id").agg(F.count(F.lit(1)).alias(f"n_{name}"), F.max("len").alias(f"len_{name}"), F.max(F.col("flags").bitwiseAND(F.lit(1))).alias(f"fd_{name}"))


def duration_ns(log: DataFrame) -> int:
    """The log's own span, which rates refer to."""
    return log.agg(F.max("ts_ns") - F.min("ts_ns")).first()[0] or 0


def rate_score(n_a: Column, n_b: Column, span_a: int, span_b: int) -> Column:
    """0 within the tolerance, which is wider for few frames, RATE_WEIGHT from twice the rate on, and in proportion between.

    Logs without a duration have no rates, and score 0.
    """
    if min(span_a, span_b) <= 0:
        return F.lit(0.0)
    a, b = n_a / F.lit(span_a), n_b / F.lit(span_b)
    ratio = F.greatest(a / b, b / a)
    tolerance = F.lit(RATE_TOLERANCE) + F.lit(2.0) / F.least(n_a, n_b)
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (ratio - tolerance) / (F.lit(2.0) - tolerance)))
    return F.when(tolerance < 2, share * RATE_WEIGHT).otherwise(0.0)


def compare_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    """(channel, id, n_a, n_b, rate_score, format_score, verdict) of every ID of either log.

    verdict: onlyA, onlyB, tooFew, different or same, by the larger of rate and format scores; compare_logs looks at payloads too.
    """
    both = _profile(a, "a").join(_profile(b, "b"), ["channel", "id"], "full_outer")
    rate = rate_score(F.col("n_a"), F.col("n_b"), duration_ns(a), duration_ns(b))
    form = F.when((F.col("len_a") != F.col("len_b")) | (F.col("fd_a") != F.col("fd_b")), FORMAT_SCORE).otherwise(0.0)
    shared = F.col("n_a").isNotNull() & F.col("n_b").isNotNull()
    scored = both.withColumn("rate_score", F.when(shared, rate)).withColumn("format_score", F.when(shared, form))
    few = F.least("n_a", "n_b") < MIN_FRAMES
    best = F.round(F.greatest("rate_score", "format_score") * 100) >= SIGNIFICANT * 100
    verdict = F.when(F.col("n_b").isNull(), "onlyA").when(F.col("n_a").isNull(), "onlyB").when(few, "tooFew").when(best, "different").otherwise("same")
    return scored.select("channel", "id", F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"), "rate_score", "format_score", verdict.alias("verdict"))


def matched_buses(a: DataFrame, b: DataFrame) -> DataFrame:
    """(bus_b, bus): what B's buses are called for matching: by A's names in their order, if both have as many and share none (or have one)."""
    data = F.col("id").bitwiseAND(F.lit(schema.ERROR_ID).cast("long")) == 0
    place = F.row_number().over(Window.orderBy("bus"))  # over a row for each bus
    of_a, of_b = (log.where(data).select("bus").distinct().withColumn("place", place) for log in (a, b))
    n, m = of_a.count(), of_b.count()
    names = b.select(F.col("bus").alias("bus_b")).distinct()
    if n != m or (n > 1 and of_a.join(of_b, "bus").limit(1).count()):
        return names.withColumn("bus", F.col("bus_b"))
    pairs = of_b.withColumnRenamed("bus", "bus_b").join(of_a, "place").drop("place")
    return names.join(pairs, "bus_b", "left").withColumn("bus", F.coalesce("bus", "bus_b"))


#: Kinds of cells that are counted over frames, by the number that names them in a task.
_HISTS = ["value", "xor", "step", "high", "first sum", "last sum", "all xor", "fd", "length"]
_CELLS = "part string, bus string, id long, hist string, byte int, x int, n long, mask long"
#: Cells that a task gathers before it adds them up, and keeps at most afterwards.
_GATHERED, _KEPT = 1 << 21, 1 << 20


def _frame_cells(b: pa.RecordBatch, group: np.ndarray) -> np.ndarray:
    """The cells of a batch of frames, each as one number: group, histogram, byte, x and stretch. group: each frame's number."""

    def flat(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All payloads' bytes in a row, where each begins, and their lengths."""
        column = b.column(name).cast(pa.large_binary())
        at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
        held = column.buffers()[2]
        return np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8), at[:-1], np.diff(at)

    def cell(hist: str, row: np.ndarray, byte: np.ndarray | int, x: np.ndarray | int, stretch: np.ndarray | int = 0) -> np.ndarray:
        return (((group[row] * len(_HISTS) + _HISTS.index(hist)) * COMPARED + byte) * 256 + x) * STRETCHES + stretch

    of = lambda name: b.column(name).to_numpy(zero_copy_only=False)
    values, start, length = flat("data")
    earlier, earlier_start, earlier_length = flat("before")
    every = np.arange(len(length))
    row = np.repeat(every, length)
    byte = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
    v = values[start[row] + byte].astype(np.int64)
    out = [cell("value", row, byte, v, of("stretch").astype(np.int64)[row])]
    both = byte < earlier_length[row]
    row2, byte2, v2 = row[both], byte[both], v[both]
    u2 = earlier[earlier_start[row2] + byte2].astype(np.int64)
    out += [cell("xor", row2, byte2, u2 ^ v2), cell("step", row2, byte2, (v2 - u2) & 255), cell("high", row2, byte2, ((v2 >> 4) - (u2 >> 4)) & 15)]
    full = np.flatnonzero((length == of("size")) & (length > 0))
    sums = np.concatenate(([0], np.cumsum(v)))
    ends = np.cumsum(length)
    total = sums[ends] - sums[ends - length]
    some = np.flatnonzero(length > 0)
    folded = np.zeros(len(length), np.int64)
    if len(some):
        folded[some] = np.bitwise_xor.reduceat(v, (ends - length)[some])
    out += [cell("first sum", full, 0, (v[(ends - length)[full]] * 2 - total[full]) & 255), cell("last sum", full, 0, (v[ends[full] - 1] * 2 - total[full]) & 255), cell("all xor", full, 0, folded[full])]
    known = b.column("data").is_valid().to_numpy(zero_copy_only=False)
    out += [cell("fd", np.flatnonzero(of("fd").astype(bool)), 0, 0), cell("length", every, 0, np.where(known, np.minimum(length, 127), 127))]
    return np.concatenate(out)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cells of frames, counted over a task as far as they fit: a cell may come several times."""
    groups: dict[tuple, int] = {}
    cells_, counts, held = [], [], 0

    def added() -> tuple[np.ndarray, np.ndarray]:
        codes, n = np.concatenate(cells_), np.concatenate(counts)
        order = np.argsort(codes, kind="stable")
        codes, n = codes[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        return codes[first], np.add.reduceat(n, first)

    def told(codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        rest, stretch = np.divmod(codes, STRETCHES)
        rest, x = np.divmod(rest, 256)
        rest, byte = np.divmod(rest, COMPARED)
        group, hist = np.divmod(rest, len(_HISTS))
        mask = np.where(hist == 0, np.uint64(1) << stretch.astype(np.uint64), np.uint64(0)).view(np.int64)
        names = list(groups)
        pick = lambda i, kind: pa.array([g[i] for g in names], kind).take(pa.array(group))
        columns = [pick(0, pa.string()), pick(1, pa.string()), pick(2, pa.int64()), pa.array(_HISTS).take(pa.array(hist)), pa.array(byte, pa.int32()), pa.array(x, pa.int32()), pa.array(n, pa.int64()), pa.array(mask)]
        return pa.RecordBatch.from_arrays(columns, ["part", "bus", "id", "hist", "byte", "x", "n", "mask"])

    for b in batches:
        if not b.num_rows:
            continue
        keys = pd.DataFrame({name: b.column(name).dictionary_encode().indices.to_numpy(zero_copy_only=False) for name in ("part", "bus", "id")})
        found = keys.groupby(["part", "bus", "id"], sort=False, dropna=False)
        number = found.ngroup().to_numpy()
        _, firsts = np.unique(number, return_index=True)
        own = [groups.setdefault(tuple(b.column(name)[int(i)].as_py() for name in ("part", "bus", "id")), len(groups)) for i in firsts]
        codes, n = np.unique(_frame_cells(b, np.array(own, np.int64)[number]), return_counts=True)
        cells_.append(codes)
        counts.append(n)
        held += len(codes)
        if held > _GATHERED:
            codes, n = added()
            if len(codes) > _KEPT:
                yield told(codes, n)
                groups, cells_, counts, held = {}, [], [], 0
            else:
                cells_, counts, held = [codes], [n], len(codes)
    if cells_:
        yield told(*added())


def cells(log: DataFrame) -> DataFrame:
    """(part, bus, id, hist, byte, x, n, mask): histograms of the payloads of each ID and part; log has part and size.

    Kinds of cells: value (mask has the stretches that show it), xor, step and high of neighbouring frames of one kind,
    last value, sums and XORs of whole payloads, length, fd, frames. Payloads are cut at the ID's size.
    """
    by = ["part", "bus", "id"]
    counted = log.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).select(*by, F.lit("frames").alias("hist"), F.lit(0).alias("byte"), F.lit(0).alias("x"), "n", F.lit(0).cast("long").alias("mask"))
    plain = log.where("kind in ('data', 'reassembled')").select(*by, "seq", "ts_ns", "kind", "flags", "size", F.substring("data", F.lit(1), F.col("size")).alias("data"))
    ends = plain.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.max_by("data", F.struct(*schema.ORDER)).alias("end"))
    last = ends.select(*by, F.lit("last").alias("hist"), F.posexplode(ff.payload_bytes(F.col("end"))).alias("byte", "x")).withColumns({"n": F.lit(1).cast("long"), "mask": F.lit(0).cast("long")})
    spans = spans_of(plain.select("ts_ns", "seq"))
    rows = with_index(with_previous(plain, [*by, "kind"], {"data": "before"}, spans=spans), by, "at", spans=spans).join(ends.select(*by, "total"), by)
    stretch = F.floor(F.col("at") * F.least("total", F.lit(STRETCHES)) / F.col("total")).cast("int").alias("stretch")
    fd = (F.col("flags").bitwiseAND(F.lit(schema.FD)) != 0).alias("fd")
    # cells are counted in their tasks first, so a few for each ID leave one
    counts = rows.select(*by, "size", stretch, fd, "data", "before").mapInArrow(_counted, _CELLS).groupBy(*by, "hist", "byte", "x").agg(F.sum("n").alias("n"), F.bit_or("mask").alias("mask"))
    columns = [*by, "hist", "byte", "x", "n", "mask"]
    return counted.select(*columns).unionByName(last.select(*columns)).unionByName(counts.select(*columns))


def compare_logs(a: DataFrame, b: DataFrame, ignore_counters: bool = False, ignore_changes_within_a: bool = False) -> DataFrame:
    """One row for each (bus, id) of either log, error frames aside: presence, frames, rates, score (0 to 100), reason and bytes.

    bytes has each payload byte's score, reason, bits, new values and values only in A, and its bits that were left out as
    counters and checksums. Scores of what changes within A alone are taken off if asked for.
    """
    data = F.col("id").bitwiseAND(F.lit(schema.ERROR_ID).cast("long")) == 0
    keep = ["bus", "id", "seq", "ts_ns", "kind", "flags", "data"]
    logs = stored(a.select(F.lit("a").alias("part"), *keep).unionByName(b.select(F.lit("b").alias("part"), *keep)), "logs")
    a, b = (logs.where(F.col("part") == part).drop("part") for part in ("a", "b"))
    buses = matched_buses(a, b)
    b = b.withColumnRenamed("bus", "bus_b").join(buses, "bus_b").drop("bus_b")
    spans, first = [duration_ns(a), duration_ns(b)], a.agg(F.min("ts_ns")).first()[0] or 0
    whole = a.where(data).select(*keep, F.lit("a").alias("part")).unionByName(b.where(data).select(*keep, F.lit("b").alias("part")))
    sizes = whole.groupBy("bus", "id").agg(F.least(F.max(F.length("data")), F.lit(COMPARED)).alias("size"))
    if ignore_changes_within_a:
        half = F.when(F.col("ts_ns") < first + spans[0] // 2, "a1").otherwise("a2")
        whole = whole.unionByName(a.where(data).select(*keep, half.alias("part")))
    found = cells(whole.join(sizes, ["bus", "id"])).join(sizes, ["bus", "id"])
    seconds = {"a": spans[0] / 1e9, "b": spans[1] / 1e9, "a1": spans[0] / 2e9, "a2": spans[0] / 2e9}

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        profiles = {part: judging.Profile(int(rows["size"].iloc[0]), s) for part, s in seconds.items()}
        for part, of in rows.groupby("part"):
            profiles[part].take(*[of[c].to_numpy() for c in ("hist", "byte", "x", "n", "mask")])
        one, two = profiles["a"], profiles["b"]
        if one.frames and two.frames:
            told = judging.judge(one, two, (profiles["a1"], profiles["a2"]) if ignore_changes_within_a else None, ignore_counters)
        else:
            told = {"score": 100, "reason": f"Appears only in {'A' if one.frames else 'B'}", "bytes": [], "too_few": False, "payloads_differ": False, "within_a": False}
        out = {"bus": key[0], "id": key[1], "frames_a": one.frames, "frames_b": two.frames, **told}
        return pd.DataFrame({k: [v] for k, v in out.items()})

    judged = found.groupBy("bus", "id").applyInPandas(run, f"bus string, id long, frames_a long, frames_b long, {_RESULT}")
    rate = lambda n, ns: (F.col(n) / F.lit(ns / 1e9) if ns > 0 else F.lit(None).cast("double"))
    presence = F.when(F.col("frames_b") == 0, "onlyA").when(F.col("frames_a") == 0, "onlyB").otherwise("both")
    named = judged.join(buses, "bus", "left").withColumn("bus_b", F.when(F.col("frames_b") > 0, F.col("bus_b")))
    return named.select("bus", "bus_b", "id", presence.alias("presence"), "frames_a", "frames_b", rate("frames_a", spans[0]).alias("rate_a"), rate("frames_b", spans[1]).alias("rate_b"), "score", "reason", "bytes", "too_few", "payloads_differ", "within_a")


def different_bytes(compared: DataFrame) -> DataFrame:
    """compare_logs' rows with the numbers of the bytes that differ significantly, most different first."""
    some = F.filter("bytes", lambda b: b["score"] >= int(SIGNIFICANT * 100))
    order = F.array_sort(F.transform(some, lambda b: F.struct((-b["score"]).alias("s"), b["byte"].alias("byte"))))
    return compared.withColumn("bytes", F.transform(order, lambda b: b["byte"]))


def grouped(compared: DataFrame) -> DataFrame:
    """compare_logs' rows with the group that a report lists them in: different, onlyA, onlyB, same or tooFew."""
    both = F.when(F.col("too_few"), "tooFew").when(F.col("score") >= int(SIGNIFICANT * 100), "different").otherwise("same")
    return compared.withColumn("group", F.when(F.col("presence") == "both", both).otherwise(F.col("presence")))


def compare_csv(compared: DataFrame) -> DataFrame:
    """One line for each row of compare_logs as columns of text, in the order of score, for a CSV writer."""
    rows = grouped(different_bytes(compared)).orderBy(F.desc("score"), "bus", "id")
    return rows.select("bus", F.hex(F.col("id").bitwiseAND(F.lit(0x1FFFFFFF).cast("long"))).alias("id"), "group", "score", "reason", F.array_join(F.transform("bytes", lambda b: b.cast("string")), " ").alias("bytes"), "frames_a", "frames_b", "rate_a", "rate_b")


def new_values(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, byte, value, frames): values of A's bytes that the same byte of the same ID never has in B, for IDs of both."""
    in_b = byte_histogram(b)
    known = in_b.select("key", "byte").distinct()
    return byte_histogram(a).join(known, ["key", "byte"], "left_semi").join(in_b, ["key", "byte", "value"], "left_anti").select("key", F.col("byte").cast("long"), F.col("value").cast("long"), "frames")


def first_showing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per ID and byte, the first time that A shows a value that B never has."""
    fresh = new_values(a, b).select("key", "byte", "value")
    shown = a.where("kind in ('data', 'reassembled')").select("key", "ts_ns", F.posexplode(ff.payload(a).numbers()).alias("byte", "value"))
    return shown.join(fresh, ["key", "byte", "value"], "left_semi").groupBy("key", "byte").agg(F.min("ts_ns").alias("first_ns"))


def compare_bits(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, byte, bit, set_a, set_b, toggle_a, toggle_b): how often each bit is set, and changes, in both logs."""
    def shares(log: DataFrame, name: str) -> DataFrame:
        set_ = byte_histogram(log).select("key", F.col("byte").cast("long"), "value", "frames", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit"))
        share = F.sum(F.when(F.getbit("value", F.col("bit")) == 1, F.col("frames")).otherwise(0)) / F.sum("frames")
        counted = set_.groupBy("key", "byte", F.col("bit").cast("long").alias("bit")).agg(share.alias(f"set_{name}"))
        toggles = bit_flips(log).select("key", "byte", "bit", F.when(F.col("pairs") > 0, F.col("flips") / F.col("pairs")).alias(f"toggle_{name}"))
        return counted.join(toggles, ["key", "byte", "bit"])

    return shares(a, "a").join(shares(b, "b"), ["key", "byte", "bit"])
