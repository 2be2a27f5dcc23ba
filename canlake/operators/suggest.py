"""Suggested signals: what the ranges of bits of unknown messages look like, from counts over the whole log.

1. Each ID's bits get their change rates, and runs of falling rates give the ranges to look at: whole runs, neighbouring
   runs together, their pieces between steep drops, 8 to 32 bits from each piece's start, widened over constant bits; and
   whole bytes and words.
2. Pairs of neighbouring frames meet the ranges of their ID in parts of about PART pairs, whose values numpy counts; the
   sums decide between readings: counter, enumeration, smoothly changing value (signed or not), 32-bit float; flags and
   toggles come from single bits, checksums from whole bytes.
3. Ranges that change smoothly are fitted to a reference series, if one is given.
4. Only a row for each candidate reaches the greedy choice of ranges that don't overlap.
5. A counter of a few values may select pages: the frames of each value become messages of their own and go through 1, 2
   and 4 again, within the bytes that change with the page.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from canlake.functions import bits
from canlake.functions.frames import payload, payload_bytes
from canlake.operators.history import with_index, with_previous
from canlake.operators.series import as_of, line
from canlake.operators.stats import bit_flips
from canlake.operators.stored import stored

# Thresholds and weights of the readings.
MIN_SCORE, MOST, FLAG_RATE, TOGGLE_RATE, ENUM_RATE, SMALL_STEP, WRAP, LENGTH_SHARE = 0.35, 16, 0.05, 0.3, 0.2, 0.2, 0.75, 0.99
RATE_TOLERANCE, CUT_RATIO, MAX_CUTS, MAX_JOINED, SMALL_SHARE, WRAP_SHARE = 1.25, 3.0, 3, 3, 0.85, 0.02
HIGH, MEDIUM = 0.85, 0.6
# Polynomials of 8-bit checksums, and the window and weights of markers.
POLYNOMIALS = [0x1D, 0x2F, 0x07, 0x9B]
MARKER_NS, MARKER_WEIGHT, MARKER_MOST = 1_000_000_000, 0.15, 0.25
# Scores about as good as each other, pages of a selector at most, and what a page's signal must score.
CLOSE, MOST_PAGES, PAGE_SCORE, CELL_BITS = 0.03, 8, 0.6, 1.5
# Points and correlation that a fit to a reference needs, and round factors.
LEAST_POINTS, LEAST_FIT, ROUND_FACTORS = 10, 0.8, [1.0, 2.0, 2.5, 5.0, 10.0]
#: Bits of the widest range, and places from which a wide one's low bits are judged apart.
WIDEST, SPLITS = 32, (8, 16, 24)
#: Pairs of one ID that a task looks at at a time; and distinct values from which on their number tells no more.
PART, MANY = 250_000, 4096
_PAYLOAD = "kind in ('data', 'reassembled')"


def lengths(frames: DataFrame) -> DataFrame:
    """Per ID the longest payload length that nearly all data frames have."""
    counts = frames.where(f"{_PAYLOAD} and length(data) > 0").groupBy("key", F.length("data").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    longer = Window.partitionBy("key").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = F.sum("n").over(longer) / F.sum("n").over(Window.partitionBy("key"))
    return counts.withColumn("share", share).where(F.col("share") >= LENGTH_SHARE).groupBy("key").agg(F.max("size").alias("size"))


def _runs(rates: np.ndarray, order: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of each run of bits, from the least significant on, whose rates fall or stay about level."""
    out, at = [], 0
    while at < len(order):
        first = at
        if rates[order[at]] > 0:
            while at + 1 < len(order) and 0 < rates[order[at + 1]] <= rates[order[at]] * RATE_TOLERANCE:
                at += 1
            out.append((first, at))
        at += 1
    return out


def ranges_of(rates: np.ndarray) -> set[tuple[int, int, str]]:
    """(start, size, order) of the ranges of 2 to WIDEST bits to look at in a payload whose bits change at these rates."""
    size, found = len(rates), set()
    for name in (bits.LITTLE, bits.BIG):
        order = np.arange(size) if name == bits.LITTLE else np.arange(size).reshape(-1, 8)[::-1].reshape(-1)
        runs = _runs(rates, order)
        joined = [(runs[i][0], runs[j][1]) for i in range(len(runs)) for j in range(i, min(i + MAX_JOINED, len(runs))) if all(runs[k][1] + 1 == runs[k + 1][0] for k in range(i, j))]
        for low, high in joined:
            drops = sorted(((-rates[order[k]] / rates[order[k + 1]], k + 1) for k in range(low, high) if rates[order[k + 1]] > 0 and rates[order[k]] / rates[order[k + 1]] > CUT_RATIO))
            bounds = sorted({low, high + 1, *(k for _, k in drops[:MAX_CUTS])})
            spans = {(a, b - 1) for i, a in enumerate(bounds) for b in bounds[i + 1 :]} | {(a, a + w - 1) for a in bounds[:-1] for w in (8, 16, 32) if a + w - 1 <= high}
            for a, b in list(spans):
                while a % 8 == 0 and (b - a + 1) % 8 and b + 1 < size and rates[order[b + 1]] == 0:
                    b += 1
                if (b - a + 1) % 8 == 0:
                    spans.add((a, b))
            for a, b in spans:
                if 2 <= b - a + 1 <= WIDEST:
                    inside = order[a] // 8 == order[b] // 8
                    found.add((int(min(order[a], order[b])), b - a + 1, bits.LITTLE) if name == bits.LITTLE or inside else (int(order[b]), b - a + 1, bits.BIG))
    # whole bytes and words beside random bits, whose rates tell no border, and words that may be floats
    for byte in range(size // 8):
        for width in (8, 16, 32):
            if 8 * byte + width <= size and rates[8 * byte : 8 * byte + width].any():
                found |= {(8 * byte, width, bits.LITTLE)} | ({(8 * byte + 7, width, bits.BIG)} if width > 8 else set())
    return found


def mask_of(start: int, size: int, order: str) -> int:
    """A range's bits as a number with bit byte * 8 + bit set for each."""
    return sum(1 << (8 * b + bit) for b, bit in bits.positions(start, size, order))


def _ranges(rates: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """(key, start, width, order, first, count, shift, range, flips) of each ID's ranges; rates: (key, bit, rate, size, flips).

    `flips` are those of the range's bit that changes least often. within: (key, cells, taken) keeps the ranges that
    touch the bytes `cells`, change in no other bits, and leave the bits `taken` alone.
    """

    def run(rows: pd.DataFrame, only: pd.DataFrame | None = None) -> pd.DataFrame:
        out = []
        if len(rows):
            table, flips = np.zeros(int(rows["size"].iloc[0]) * 8), np.zeros(int(rows["size"].iloc[0]) * 8, np.int64)
            rows = rows[rows.bit < len(table)]
            table[rows.bit], flips[rows.bit] = rows.rate, rows.flips
            cells, taken = (set(only.cells.iloc[0]), set(only.taken.iloc[0])) if only is not None and len(only) else (None, set())
            for n, (start, size, order) in enumerate(sorted(ranges_of(table))):
                at = bits.positions(start, size, order)
                own, places = [8 * b + bit for b, bit in at], [b for b, _ in at]
                if cells is not None and (taken.intersection(own) or not cells.intersection(places) or any(table[o] > 0 and b not in cells for o, b in zip(own, places))):
                    continue
                out.append((rows.key.iloc[0], n, start, size, order, min(places), max(places) - min(places) + 1, at[0][1], min((int(flips[o]) for o in own if flips[o]), default=0)))
        return pd.DataFrame(out, columns=["key", "range", "start", "width", "order", "first", "count", "shift", "flips"])

    kinds = "key long, range int, start int, width int, order string, first int, count int, shift int, flips long"
    if within is None:
        return rates.groupBy("key").applyInPandas(lambda rows: run(rows), kinds)
    return rates.groupBy("key").cogroup(within.groupBy("key")).applyInPandas(lambda rows, only: run(rows, only), kinds)


def _value(payload: str) -> Column:
    """A range's bits in an array of payload bytes."""
    part = lambda i: F.when(F.col("count") > i, F.call_function("shiftleft", F.get(F.col(payload), F.col("first") + i).cast("long"), F.when(F.col("order") == bits.LITTLE, 8 * i).otherwise(8 * (F.col("count") - 1 - i))))
    word = part(0)
    for i in range(1, 5):
        word = word + F.coalesce(part(i), F.lit(0).cast("long"))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("width")) - 1
    return F.call_function("shiftright", word, F.col("shift")).bitwiseAND(mask)


def _rates(frames: DataFrame) -> DataFrame:
    flips = bit_flips(frames).select("key", (F.col("byte") * 8 + F.col("bit")).cast("int").alias("bit"), F.when(F.col("pairs") > 0, F.col("flips") / F.col("pairs")).otherwise(0.0).alias("rate"), "flips", "pairs")
    return flips.join(lengths(frames), "key").where(F.col("bit") < 8 * F.col("size"))


def _pairs(frames: DataFrame) -> DataFrame:
    """(key, size, seq, ts_ns, then_ns, data, before, now, then) of neighbouring data frames of an ID's length, as bytes and as arrays of them."""
    rows = frames.where(_PAYLOAD).select("seq", "ts_ns", "key", "data").join(lengths(frames), "key").where(F.length("data") >= F.col("size"))
    both = with_previous(rows, ["key"], {"data": "before", "ts_ns": "then_ns"}).where("before is not null")
    return both.select("key", "size", "seq", "ts_ns", "then_ns", "data", "before", payload_bytes(F.col("data")).alias("now"), payload_bytes(F.col("before")).alias("then"))


def crc8(polynomial: int) -> np.ndarray:
    """The table of an 8-bit checksum with this polynomial."""
    table = np.arange(256, dtype=np.uint16)
    for _ in range(8):
        table = np.where(table & 0x80, (table << 1) ^ polynomial, table << 1) & 0xFF
    return table.astype(np.uint8)


def _rules(body: np.ndarray, own: np.ndarray) -> dict[str, np.ndarray]:
    """What a byte differs by from each rule over the others (frames x bytes); a checksum differs by a constant."""
    out = {}
    for polynomial in POLYNOMIALS:
        table, state = crc8(polynomial), np.zeros(len(body), np.uint8)
        for column in body.T:
            state = table[state ^ column]
        out[f"CRC-8 0x{polynomial:02X}"] = own ^ state
    total = body.sum(axis=1, dtype=np.uint64).astype(np.uint8)
    return out | {"XOR": own ^ np.bitwise_xor.reduce(body, axis=1), "sum": own - total, "complement": own + total}


def checksums(frames: DataFrame, random_bytes: DataFrame) -> DataFrame:
    """(key, byte, rule, share): bytes that follow from the others by a rule and a constant, with the best rule's share of frames.

    random_bytes: (key, byte) to look at. Differences are counted in their batches first, so a few rows for each leave a task.
    """
    rows = frames.where(_PAYLOAD).join(lengths(frames), "key").where((F.length("data") == F.col("size")) & (F.col("size") >= 2)).select("key", "data")
    wanted = random_bytes.groupBy("key").agg(F.collect_list("byte").alias("bytes"))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            out: list[pd.DataFrame] = []
            for key, of in b.to_pandas().groupby("key"):
                data = np.frombuffer(b"".join(of["data"]), np.uint8).reshape(len(of), -1)
                for byte in of["bytes"].iloc[0]:
                    for rule, left in _rules(np.delete(data, byte, axis=1), data[:, byte]).items():
                        counts = np.bincount(left, minlength=256)
                        seen = np.flatnonzero(counts)
                        out.append(pd.DataFrame({"key": key, "byte": byte, "rule": rule, "constant": seen, "n": counts[seen]}))
            if out:
                yield pa.RecordBatch.from_pandas(pd.concat(out), schema=pa.schema([("key", pa.int64()), ("byte", pa.int32()), ("rule", pa.string()), ("constant", pa.int32()), ("n", pa.int64())]), preserve_index=False)

    counted = rows.join(wanted, "key").mapInArrow(run, "key long, byte int, rule string, constant int, n long").groupBy("key", "byte", "rule", "constant").agg(F.sum("n").alias("n"))
    shares = counted.groupBy("key", "byte", "rule").agg((F.max("n") / F.sum("n")).alias("share"))
    return shares.groupBy("key", "byte").agg(F.max_by("rule", "share").alias("rule"), F.max("share").alias("share"))


#: What tells why a candidate reads as it does; null where it doesn't apply.
REASON = "step long, wraps_at long, share double, low double, high double, distinct long, flips long, rule string, markers int, r double, factor double, offset double"


def _reason(**known: Column) -> Column:
    return F.struct(*[known.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in (part.split() for part in REASON.split(", "))])


def flags(frames: DataFrame, rates: DataFrame, pairs: DataFrame) -> DataFrame:
    """(key, start, score, reason) of single bits that switch seldom, or toggle at a steady pace, and don't move with a neighbour."""
    some = rates.where((F.col("flips") > 0) & (F.col("rate") < TOGGLE_RATE)).select("key", "bit", "rate")
    near = F.array(*[F.struct(F.lit(d).alias("step"), on.alias("on")) for d, on in ((-1, F.lit(True)), (1, F.lit(True)), (15, F.col("bit") % 8 == 0), (-15, F.col("bit") % 8 == 7))])
    beside = some.select("key", "bit", "rate", F.explode(near).alias("n")).where("n.on").select("key", "bit", "rate", (F.col("bit") + F.col("n.step")).alias("other"))
    beside = beside.join(rates.select("key", F.col("bit").alias("other"), F.col("rate").alias("other_rate")), ["key", "other"]).where("other_rate > 0")
    lists = some.join(beside.groupBy("key", "bit").agg(F.collect_list(F.struct("other", "other_rate")).alias("others")), ["key", "bit"], "left")
    numbered = with_index(pairs.select("key", "seq", "ts_ns", "now", "then"), ["key"], "at")
    flipped = lambda bit: F.getbit(F.get("now", (bit / 8).cast("int")).bitwiseXOR(F.get("then", (bit / 8).cast("int"))), bit % 8) == 1
    changes = numbered.join(lists, "key").where(flipped(F.col("bit")))
    was = F.getbit(F.get("then", (F.col("bit") / 8).cast("int")), F.col("bit") % 8)
    changes = changes.select("key", "bit", "rate", "at", was.alias("was"), F.transform("others", lambda o: F.struct(o["other"].alias("other"), o["other_rate"].alias("rate"), flipped(o["other"]).alias("too"))).alias("others"))
    together = changes.select("key", "bit", F.explode("others").alias("o")).groupBy("key", "bit", "o.other").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("o.too").cast("int")).alias("share"), F.first("o.rate").alias("other_rate"))
    moves = together.where((F.col("share") > 0.4) & (F.col("share") > F.col("other_rate") + 0.3) & ((F.col("n") >= 3) | (F.col("other_rate") < FLAG_RATE))).select("key", "bit").distinct()
    # runs of a toggling bit, on and off, against the typical one
    length = F.col("at") - F.lag("at").over(Window.partitionBy("key", "bit").orderBy("at"))
    lasting = changes.where(F.col("rate") >= FLAG_RATE).withColumn("run", length).where("run is not null")
    typical = lasting.groupBy("key", "bit", "was").agg(F.percentile("run", 0.5).alias("typical"))
    steady = lasting.join(typical, ["key", "bit", "was"]).groupBy("key", "bit", "was").agg(F.count(F.lit(1)).alias("runs"), F.avg((F.abs(F.col("run") - F.col("typical")) <= F.greatest(F.floor(F.col("typical") / 4), F.lit(1))).cast("int")).alias("near"))
    paced = steady.where("runs >= 4 and near >= 0.6").groupBy("key", "bit").agg(F.count(F.lit(1)).alias("sides")).where("sides = 2").select("key", "bit")
    seldom = some.where(F.col("rate") < FLAG_RATE).withColumn("score", 0.5 + 0.2 * (1 - F.col("rate") / FLAG_RATE))
    often = some.where(F.col("rate") >= FLAG_RATE).join(paced, ["key", "bit"], "left_semi").withColumn("score", F.lit(0.5))
    found = seldom.unionByName(often).join(moves, ["key", "bit"], "left_anti").join(rates.select("key", "bit", "flips"), ["key", "bit"])
    return found.select("key", F.col("bit").alias("start"), "score", _reason(flips=F.col("flips"), share=F.col("rate")).alias("reason"))


def _folded(pairs: DataFrame, ranges: DataFrame, run: Callable, columns: str) -> DataFrame:
    """run(range, now, before) of every range and part of its ID's pairs: the rows, as dicts, that it makes of a range's values.

    ranges: as _ranges gives them, and what else run reads. A part has about PART pairs, dealt by hash.
    """
    parts = pairs.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"))
    dealt = pairs.select("key", "seq", "data", "before").join(parts, "key").select("key", F.pmod(F.xxhash64("seq"), F.col("parts")).alias("part"), "data", "before")
    asked = ranges.join(parts, "key").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    kinds = to_arrow_schema(T._parse_datatype_string(columns))

    def of(payloads: pa.ChunkedArray, size: int) -> np.ndarray:
        """The first bytes of payloads, a row for each byte."""
        flat = pc.binary_slice(payloads, 0, size).combine_chunks()
        return np.frombuffer(b"".join(flat.to_pylist()), np.uint8).reshape(-1, size).T.astype(np.int64)

    def value(bytes_: np.ndarray, r: dict) -> np.ndarray:
        word = np.zeros(bytes_.shape[1], np.int64)
        for i in range(r["count"]):
            word += bytes_[r["first"] + i] << (8 * i if r["order"] == bits.LITTLE else 8 * (r["count"] - 1 - i))
        return (word >> r["shift"]) & ((1 << r["width"]) - 1)

    def fold(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        out: list[dict] = []
        wanted = wanted.to_pylist()
        if len(rows) and wanted:
            size = max(r["first"] + r["count"] for r in wanted)
            now, before = of(rows["data"], size), of(rows["before"], size)
            for r in wanted:
                out += [{"key": r["key"], "range": r["range"], **found} for found in run(r, value(now, r), value(before, r))]
        return pa.Table.from_pylist(out, schema=kinds)

    return dealt.groupBy("key", "part").cogroup(asked.groupBy("key", "part")).applyInArrow(fold, columns)


def _signed(x: np.ndarray, width: int) -> np.ndarray:
    return np.where(x >= 1 << (width - 1), x - (1 << width), x)


def _real(x: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return x.astype(np.uint32).view(np.float32).astype(np.float64)


_ENDS = ", ".join(f"{n}_{c} {kind}" for c, kind in (("now", "long"), ("snow", "long"), ("fnow", "double")) for n in ("min", "max"))
_SPREAD = f"key long, range int, n long, changes long, varying long, together long, plausible long, least_exponent long, most_exponent long, {_ENDS}, many boolean, values array<long>"


def _spread(r: dict, now: np.ndarray, before: np.ndarray) -> list[dict]:
    """Counts and ends of a range's values, and the values themselves, if they are few."""
    moved, signed, seen = now ^ before, _signed(now, r["width"]), np.unique(now)
    exponent = (now >> 23) & 255
    found = {"n": len(now), "changes": int(np.count_nonzero(moved)), "varying": int(np.bitwise_or.reduce(moved)), "together": int(np.count_nonzero(moved & (moved - 1)))}
    found |= {"least_exponent": int(exponent.min()), "most_exponent": int(exponent.max()), "many": len(seen) >= MANY, "values": seen.tolist() if len(seen) < MANY else []}
    found |= {"min_now": int(now.min()), "max_now": int(now.max()), "min_snow": int(signed.min()), "max_snow": int(signed.max())}
    if r["width"] == 32:
        real = _real(now)
        size = np.abs(real)
        found |= {"plausible": int(np.count_nonzero((real == 0) | ((size >= 1e-6) & (size <= 1e6)))), "min_fnow": float(np.fmin.reduce(real)), "max_fnow": float(real.max())}
    return [found]


_MOVES = ["now", "snow", "fnow"]
_CARRIES = [*(f"split_{s}" for s in SPLITS), "mantissa"]
_STEPS = ", ".join([*(f"{w}_{c} long" for c in _MOVES for w in ("moved", "near", "around")), *(f"{w}_{c} long" for c in _CARRIES for w in ("stepped", "same", "low", "calm"))])
_SMOOTH = f"key long, range int, {_STEPS}, step long, narrow_step long"


def _steps_of(r: dict, now: np.ndarray, before: np.ndarray, narrow: bool) -> np.ndarray | None:
    """Steps modulo the range's width, or if narrow modulo its values from 0 to the highest, where these are fewer."""
    modulus = 1 << r["width"]
    if not narrow:
        return (now - before) & (modulus - 1)
    return np.mod(now - before, r["max_now"] + 1) if 1 <= r["max_now"] < modulus - 1 else None


def _smooth(r: dict, now: np.ndarray, before: np.ndarray) -> list[dict]:
    """Counts of small and of wide steps of a range, and of its carries; and the step by which nearly all pairs go on."""
    found: dict = {}
    count = lambda which: int(np.count_nonzero(which))
    readings_ = {"now": (now, before), "snow": (_signed(now, r["width"]), _signed(before, r["width"]))}
    if r["width"] == 32:
        readings_["fnow"] = (_real(now), _real(before))
    with np.errstate(invalid="ignore", over="ignore"):
        for c, (x, y) in readings_.items():
            size, width, moved = np.abs(x - y), r[f"max_{c}"] - r[f"min_{c}"], x != y
            found |= {f"moved_{c}": count(moved), f"near_{c}": count(moved & (size <= max(SMALL_STEP * width, 1.0))), f"around_{c}": count(moved & (size > WRAP * width)) if width >= 4 else 0}
    mantissa = lambda x: x & 0x7FFFFF
    for name, x, y, split in (*((f"split_{s}", now, before, s) for s in SPLITS), ("mantissa", mantissa(now), mantissa(before), 16)):
        low, old, up = x & ((1 << split) - 1), y & ((1 << split) - 1), (x >> split) - (y >> split)
        same = ((up == 1) & (low < old)) | ((up == -1) & (low > old))
        around = (low - old) & ((1 << split) - 1)
        small, moved = np.minimum(around, (1 << split) - around) <= 1 << (split - 3), low != old
        found |= {f"stepped_{name}": count(np.abs(up) == 1), f"same_{name}": count(same), f"low_{name}": count(moved), f"calm_{name}": count(moved & small)}
    for narrow, name in ((False, "step"), (True, "narrow_step")):
        steps = _steps_of(r, now, before, narrow) if r["changes"] >= 0.9 * r["n"] else None
        if steps is not None:
            # a step of nine tenths of all pairs has as many of some part's, and is its middle one
            middle = int(np.partition(steps, len(steps) // 2)[len(steps) // 2])
            found[name] = middle if middle and 10 * count(steps == middle) >= 8 * len(steps) else None
    return [found]


def _same_steps(r: dict, now: np.ndarray, before: np.ndarray) -> list[dict]:
    steps = _steps_of(r, now, before, r["narrow"] == 1)
    return [{"narrow": r["narrow"], "step": r["step"], "k": int(np.count_nonzero(steps == r["step"]))}]


def readings(pairs: DataFrame, ranges: DataFrame, markers_ns: list[int] | None = None) -> DataFrame:
    """(key, range, start, size, order, kind, score, reason) of every range that reads as a counter, an enumeration or a value."""
    by = ["key", "range", "start", "width", "order", "flips"]
    modulus = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("width"))
    parts = stored(_folded(pairs, ranges, _spread, _SPREAD), "spread")
    ends = [f(f"{n}_{c}").alias(f"{n}_{c}") for c in _MOVES for n, f in (("min", F.min), ("max", F.max))]
    # MANY distinct values and more read alike
    values = parts.select("key", "range", F.explode("values").alias("value")).distinct().groupBy("key", "range").agg(F.count(F.lit(1)).alias("distinct"))
    merged = parts.groupBy("key", "range").agg(
        *[F.sum(c).alias(c) for c in ("n", "changes", "together")], F.bit_or("varying").alias("varying"), (F.sum("plausible") / F.sum("n")).alias("plausible"),
        (F.min("least_exponent") != F.max("most_exponent")).alias("exponents"), F.max("many").alias("many"), *ends,
    )
    distinct = F.when(F.col("many"), F.greatest("distinct", F.lit(MANY))).otherwise(F.col("distinct"))
    spread = merged.join(values, ["key", "range"], "left").withColumn("distinct", distinct).join(ranges, ["key", "range"])
    spread = stored(spread.select(*by, "first", "count", "shift", *[c for c in merged.columns if c not in ("key", "range", "many")], "distinct"), "spread")
    smooth_parts = stored(_folded(pairs, spread.where("changes > 0"), _smooth, _SMOOTH), "smooth")
    tried = F.explode(F.array(*[F.struct(F.lit(i).alias("narrow"), F.col(c).alias("step")) for i, c in enumerate(("step", "narrow_step"))])).alias("s")
    tried = smooth_parts.select("key", "range", tried).select("key", "range", "s.*").where("step is not null").distinct()
    same = _folded(pairs, spread.join(tried, ["key", "range"]), _same_steps, "key long, range int, narrow int, step long, k long")
    commonest = same.groupBy("key", "range", "narrow", "step").agg(F.sum("k").alias("k")).join(spread.select("key", "range", "n"), ["key", "range"]).where(F.col("k") / F.col("n") >= 0.9)
    of = lambda narrow, c: F.max(F.when(F.col("narrow") == narrow, c))
    share = F.col("k") / F.col("n")
    counters = commonest.groupBy("key", "range").agg(of(0, share).alias("share"), of(1, share).alias("narrow_share"), of(0, F.col("step")).alias("step"), of(1, F.col("step")).alias("narrow_step"))
    total = lambda c: F.sum(c)

    def moves(c: str) -> list[Column]:
        count = F.greatest(total(f"moved_{c}"), F.lit(1))
        return [(total(f"near_{c}") / count).alias(f"small_{c}"), (total(f"around_{c}") / count).alias(f"wraps_{c}")]

    def carries(c: str) -> Column:
        """Of steps by one of the bits above a place, those in which the bits below wrapped the same way; and small steps of these."""
        agree = F.when(total(f"stepped_{c}") >= 5, total(f"same_{c}") / total(f"stepped_{c}") >= 0.8)
        calm = F.coalesce(total(f"calm_{c}") / F.nullif(total(f"low_{c}"), F.lit(0)) >= 0.6, F.lit(True))
        return F.coalesce(agree, calm).alias(c)

    smooth = smooth_parts.groupBy("key", "range").agg(*[m for c in _MOVES for m in moves(c)], *[carries(c) for c in _CARRIES])
    # floats of very small values beside large ones are none; only ranges that may be floats are looked at
    may_float = spread.where((F.col("width") == 32) & (F.col("plausible") >= 0.99) & (F.col("distinct") >= 16)).select("key", "range", "order", "first", "count", "shift", "width")
    size = F.abs(bits.float32(F.col("x")))
    lows = pairs.select("key", "now").join(may_float, "key").select("key", "range", _value("now").alias("x"))
    lows = lows.groupBy("key", "range").agg(F.percentile_approx(F.when(size != 0, size), 0.05, 1000).alias("low"))
    spread = spread.drop("first", "count", "shift").join(lows, ["key", "range"], "left")
    stats = spread.join(smooth, ["key", "range"]).join(counters, ["key", "range"], "left")
    rate = F.col("changes") / F.col("n")
    best = F.greatest(F.coalesce("share", F.lit(0.0)), F.coalesce("narrow_share", F.lit(0.0)))
    is_narrow = F.coalesce("narrow_share", F.lit(0.0)) > F.coalesce("share", F.lit(0.0))
    narrower = F.when(is_narrow, 0.03).otherwise(0.0)
    # but for floats, a range begins with a bit that changes, and so does its last byte
    proper = (F.col("varying").bitwiseAND(F.lit(1).cast("long")) != 0) & (F.call_function("shiftright", F.col("varying"), F.greatest(F.col("width") - 8, F.lit(0))) != 0)
    counter = F.when(proper & (F.col("n") >= 8) & (best >= 0.9), 0.6 + 0.38 * (best - 0.9) / 0.1 - narrower)
    # bits that each change several times and hardly ever together are flags of their own
    separate = (F.col("flips") >= 6) & (F.col("together") * 20 <= F.col("changes"))
    enum = F.when(proper & F.col("distinct").between(2, 16) & (rate <= ENUM_RATE) & (F.bit_count("varying") >= 2) & ~separate, 0.55 + 0.25 * (1 - rate / ENUM_RATE))
    whole = F.lit(True)
    for split in SPLITS:
        whole = whole & ((F.col("width") <= split) | F.col(f"split_{split}"))
    aligned = F.when((F.col("width") % 8 == 0) & (F.col("start") % 8 == F.when(F.col("order") == bits.BIG, 7).otherwise(0)), 0.03).otherwise(0.0)

    def value(c: str) -> Column:
        ok = proper & whole & (F.col("width") >= 4) & (F.col("distinct") >= 12) & (F.col(f"small_{c}") >= SMALL_SHARE) & (F.col(f"wraps_{c}") <= WRAP_SHARE)
        return F.when(ok, 0.45 + 0.3 * (F.col(f"small_{c}") - SMALL_SHARE) / 0.15 + 0.15 * F.least(F.log2("distinct") / 12, F.lit(1.0)) - 15 * F.col(f"wraps_{c}") + aligned)

    crosses = (F.col("min_snow") < 0) & (F.col("max_snow") > 0)
    plain, both_signs = value("now"), F.when(crosses, value("snow"))
    use_signed = both_signs.isNotNull() & (plain.isNull() | (F.col("wraps_snow") < F.col("wraps_now")) | (F.col("small_snow") > F.col("small_now") + 0.05))
    is_float = (F.col("width") == 32) & (F.col("plausible") >= 0.99) & (F.col("distinct") >= 16) & (F.col("exponents") | F.col("mantissa")) & (F.col("small_fnow") >= SMALL_SHARE) & (F.col("wraps_fnow") <= WRAP_SHARE) & (F.greatest(F.abs("min_fnow"), F.abs("max_fnow")) <= F.col("low") * 1e6)
    floating = F.when(is_float & (F.col("max_fnow") > F.col("min_fnow")), 0.65 + 0.3 * (F.col("small_fnow") - SMALL_SHARE) / 0.15 - 15 * F.col("wraps_fnow") - F.when(F.col("exponents"), 0.0).otherwise(0.05))
    read_as = F.array_compact(F.array(*[F.when(s.isNotNull(), F.struct(s.alias("score"), F.lit(k).alias("kind"))) for k, s in (("counter", counter), ("enum", enum), ("signed", F.when(use_signed, both_signs)), ("continuous", F.when(~use_signed, plain)), ("float", floating))]))
    read = stats.withColumn("rate", rate).withColumn("r", F.array_max(read_as)).where("r is not null")
    if markers_ns:
        met = pairs.join(ranges, "key").select("key", "range", "ts_ns", "then_ns", _value("now").alias("now"), _value("then").alias("before"))
        read = read.join(_near_markers(met, read.select("key", "range", "rate"), markers_ns), ["key", "range"], "left")
        read = read.withColumn("markers", F.coalesce("markers", F.lit(0)))
    else:
        read = read.withColumn("markers", F.lit(0))
    boost = F.least(MARKER_WEIGHT * F.col("markers"), F.lit(MARKER_MOST))
    is_a = lambda *kinds: F.col("r.kind").isin(*kinds)
    top = F.when(is_narrow, F.col("max_now") + 1).otherwise(modulus)
    stepped = F.when(is_narrow, F.col("narrow_step")).otherwise(F.col("step"))
    end = lambda name: F.when(is_a("signed"), F.col(f"{name}_snow")).when(is_a("float"), F.col(f"{name}_fnow")).when(is_a("continuous", "enum"), F.col(f"{name}_now"))
    reason = _reason(
        step=F.when(is_a("counter"), F.when(stepped * 2 > top, stepped - top).otherwise(stepped)), wraps_at=F.when(is_a("counter"), top - 1), share=F.when(is_a("counter"), best),
        low=end("min"), high=end("max"), distinct=F.when(is_a("enum"), F.col("distinct")), markers=F.col("markers"),
    )
    return read.select("key", "range", "start", F.col("width").alias("size"), "order", "r.kind", (F.col("r.score") + boost).alias("score"), reason.alias("reason"))


def _checksum_readings(frames: DataFrame, rates: DataFrame, pairs: DataFrame) -> DataFrame:
    """(key, start, score, reason) of bytes that read as checksums."""
    # bytes that change on most frames may be checksums
    bytes_ = pairs.select("key", "size", F.posexplode("now").alias("byte", "now"), "then").select("key", "size", "byte", "now", F.get("then", "byte").alias("was")).where("byte < size")
    busy = bytes_.groupBy("key", "size", "byte").agg(F.avg((F.col("now") != F.col("was")).cast("int")).alias("moving"), F.count_distinct("now").alias("values")).where("moving >= 0.5 and values >= 16")
    found = checksums(frames, busy.select("key", "byte"))
    even = rates.groupBy("key", F.floor(F.col("bit") / 8).cast("int").alias("byte")).agg(F.min("rate").alias("least"), F.max("rate").alias("most"))
    told = busy.join(even, ["key", "byte"]).join(found, ["key", "byte"], "left")
    unknown = F.when((F.col("byte") == F.col("size") - 1) & (F.col("least") >= 0.3) & (F.col("most") <= 0.7) & (F.col("values") >= 64), 0.4)
    score = F.when(F.col("share") >= 0.995, 0.97).when(F.col("share") >= 0.9, 0.6 + 1.5 * (F.col("share") - 0.9)).otherwise(unknown)
    return told.withColumn("score", score).where("score is not null").select("key", (F.col("byte") * 8).cast("int").alias("start"), "score", _reason(rule=F.when(F.col("share") >= 0.9, F.col("rule")), share=F.col("share")).alias("reason"))


def candidates(frames: DataFrame, markers_ns: list[int] | None = None, within: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every candidate that has a reading, as (key, range, start, size, order, kind, score, reason), and the ranges and rates they come from.

    within: parts of messages to look at, as _ranges takes them; no checksum is looked for there.
    """
    rates, pairs = stored(_rates(frames), "rates"), stored(_pairs(frames), "pairs")
    ranges = stored(_ranges(rates.select("key", "bit", "rate", "size", "flips"), within), "ranges")
    # single bits and checksums have numbers below 0, which name their first bit
    one = lambda rows, kind, size: rows.select("key", (-1 - F.col("start")).alias("range"), "start", F.lit(size).alias("size"), F.lit(bits.LITTLE).alias("order"), F.lit(kind).alias("kind"), "score", "reason")
    found = readings(pairs, ranges, markers_ns).unionByName(one(flags(frames, rates, pairs), "flag", 1))
    if within is None:
        found = found.unionByName(one(_checksum_readings(frames, rates, pairs), "checksum", 8))
    return found, ranges, rates


def scored(frames: DataFrame, markers_ns: list[int] | None = None) -> DataFrame:
    """(key, start, size, order, kind, score) of every candidate that has a reading."""
    return candidates(frames, markers_ns)[0].select("key", "start", "size", "order", "kind", "score")


def _near_markers(met: DataFrame, rates: DataFrame, markers_ns: list[int]) -> DataFrame:
    """(key, range, markers): for ranges that change unusually often within a second of some markers (a few tens at most)."""
    marks = F.broadcast(met.sparkSession.createDataFrame([(i, m - MARKER_NS, m + MARKER_NS) for i, m in enumerate(markers_ns)], "marker long, low long, high long"))
    near = met.join(marks, (F.col("then_ns") >= F.col("low")) & (F.col("ts_ns") <= F.col("high"))).groupBy("key", "range", "marker").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("now") != F.col("before")).alias("moved"))
    hit = near.join(rates, ["key", "range"]).where((F.col("moved") >= 1) & (F.col("moved") >= 3.0 * F.col("rate") * F.col("pairs") + 0.5))
    return hit.groupBy("key", "range").agg(F.count(F.lit(1)).cast("int").alias("markers"))


def nice(x: float) -> float:
    """x to three significant digits, or a round factor within 3% of it."""
    if x == 0 or not math.isfinite(x):
        return 0.0
    unit = 10.0 ** math.floor(math.log10(abs(x)))
    near = next((f for f in ROUND_FACTORS if abs(abs(x) / unit - f) / f < 0.03), None)
    return math.copysign(float(f"{near * unit:.12g}"), x) if near else float(f"{x:.2e}")


def reference_sums(frames: DataFrame, ranges: DataFrame, reference: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(key, range, n, r, slope, mx, my) of each range against a reference series (ts_ns, seq, value).

    Every frame takes the last reference value at or before it, once for all ranges; sums of the pairs are kept for each
    range. ranges: as _ranges gives them, with `signed`. Payloads may be arrays of numbers, with ranges of three places.
    sizes: (key, size), where a frame of an ID has to have another length than lengths tells.
    """
    sizes = lengths(frames) if sizes is None else sizes
    rows = frames.where(_PAYLOAD).select("seq", "ts_ns", "key", "data").join(sizes, "key").where(payload(frames).length() >= F.col("size"))
    met = as_of(rows.withColumn("value", F.lit(0.0)), reference, keep=["key", "data"]).where("reference is not null and not isnan(reference)")
    raw = met.withColumn("now", payload(met).numbers(24)).join(ranges, "key").select("key", "range", "width", "signed", F.col("reference").alias("y"), _value("now").alias("raw"))
    modulus = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("width"))
    x = F.when(F.col("signed") & (F.col("raw") * 2 >= modulus), F.col("raw") - modulus).otherwise(F.col("raw")).cast("double")
    r, slope = line("x", "y")
    return raw.withColumn("x", x).groupBy("key", "range").agg(F.count(F.lit(1)).alias("n"), r.alias("r"), slope.alias("slope"), F.avg("x").alias("mx"), F.avg("y").alias("my"))


def reference_fits(frames: DataFrame, ranges: DataFrame, reference: DataFrame) -> DataFrame:
    """(key, range, n, r, factor, offset): ranges that follow a reference series, |r| 0.8 or more over 10 points at least.

    The factor is rounded to three digits or a round number; an offset below one step of the raw value is rounding in the
    reference and becomes 0.
    """
    found = reference_sums(frames, ranges, reference).where((F.col("n") >= LEAST_POINTS) & (F.abs("r") >= LEAST_FIT))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            factor = p.slope.map(nice)
            offset = p.my - factor * p.mx
            yield p[["key", "range", "n", "r"]].assign(factor=factor, offset=[0.0 if abs(o) <= abs(f) else nice(o) for o, f in zip(offset, factor)])

    return found.mapInPandas(run, "key long, range int, n long, r double, factor double, offset double")


def _with_fits(found: DataFrame, frames: DataFrame, ranges: DataFrame, reference: DataFrame) -> DataFrame:
    smooth = found.where("kind in ('continuous', 'signed')").select("key", "range", (F.col("kind") == "signed").alias("signed"))
    fits = reference_fits(frames, ranges.join(smooth, ["key", "range"]), reference).drop("n")
    both = found.join(fits, ["key", "range"], "left")
    score = F.when(F.col("r").isNotNull(), F.col("score") + 0.05 + 0.1 * (F.abs("r") - LEAST_FIT) / 0.2).otherwise(F.col("score"))
    told = both.withColumn("score", score).withColumn("reason", F.col("reason").withField("r", F.col("r")).withField("factor", F.col("factor")).withField("offset", F.col("offset")))
    return told.drop("r", "factor", "offset")


def moving_pages(frames: DataFrame, ranges: DataFrame, selectors: DataFrame) -> DataFrame:
    """(key, range) of ranges that move much more from frame to frame than from one frame of a page to its next.

    selectors: (key, pages). A frame meets the one before it and the one `pages` before it by its number in its ID.
    """
    rows = frames.where(_PAYLOAD).join(selectors.select("key", "pages"), "key").join(lengths(frames), "key").where(F.length("data") >= F.col("size"))
    numbered = with_index(rows.select("seq", "ts_ns", "key", "pages", "data"), ["key"], "at")
    for_whom = F.array(*[F.struct((F.col("at") + by).alias("at"), F.lit(i).alias("side")) for i, by in enumerate((F.lit(0), F.lit(1), F.col("pages")))])
    shared = numbered.select("key", "data", F.explode(for_whom).alias("w")).groupBy("key", "w.at")
    met = shared.agg(*[F.max(F.when(F.col("w.side") == i, F.col("data"))).alias(name) for i, name in enumerate(("now", "then", "page"))]).where("now is not null and then is not null and page is not null")
    met = met.select("key", *[payload_bytes(F.col(c)).alias(c) for c in ("now", "then", "page")]).join(ranges, "key")
    values = met.select("key", "range", *[_value(c).alias(c) for c in ("now", "then", "page")])
    step = lambda c: F.sum(F.least(F.abs(F.col("now") - F.col(c)), F.lit((1 << 32) - 1))).alias(f"by_{c}")
    sums = values.groupBy("key", "range").agg(F.count(F.lit(1)).alias("steps"), step("then"), step("page"))
    return sums.where(F.col("by_then") > 3 * F.col("by_page") + F.col("steps") / 20).select("key", "range")


def selectors_of(found: DataFrame) -> DataFrame:
    """(key, pages, selector): each ID's best counter through at most MOST_PAGES values, which may select pages."""
    counts = (F.col("kind") == "counter") & (F.col("size") > 1) & (F.col("score") >= 0.9) & (F.col("reason.wraps_at") < MOST_PAGES) & (F.col("reason.share") >= 0.995)
    best = F.max_by(F.struct("start", "size", "order", "reason.wraps_at"), F.struct("score", -F.col("start"), -F.col("size"), "order")).alias("s")
    return found.where(counts).groupBy("key").agg(best).select("key", (F.col("s.wraps_at") + 1).cast("int").alias("pages"), F.struct("s.start", "s.size", "s.order").alias("selector"))


def pages_of(found: DataFrame, frames: DataFrame, ranges: DataFrame, rates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, pages, selector, cells) of IDs with a possible selector, and the ranges that change with the page.

    Cells are whole bytes, many of whose bits change with the page; an ID may have none.
    """
    selectors = stored(selectors_of(found), "selectors")
    single = _placed(found.where("kind = 'flag'").join(selectors.select("key"), "key")).select("key", "range", "start", "width", "order", "first", "count", "shift")
    moving = stored(moving_pages(frames, ranges.select(*single.columns).unionByName(single), selectors), "moving")
    busy = rates.groupBy("key", F.floor(F.col("bit") / 8).cast("int").alias("byte")).agg(F.sum("rate").alias("changed")).where(F.col("changed") > CELL_BITS)
    whole = moving.join(ranges.where(f"width = 8 and order = '{bits.LITTLE}' and start % 8 = 0"), ["key", "range"]).select("key", (F.col("start") / 8).cast("int").alias("byte"))
    cells = whole.join(busy, ["key", "byte"]).groupBy("key").agg(F.array_sort(F.collect_list("byte")).alias("cells"))
    return selectors.join(cells, "key", "left").withColumn("cells", F.coalesce("cells", F.array().cast("array<int>"))), moving


def pick(rows: list[dict], taken: int, most: int) -> list[dict]:
    """The best rows that overlap neither each other nor the bits taken.

    A range gives way to a range inside it if that one and a neighbour over the border both score about as well.
    """
    order = sorted(rows, key=lambda r: (-r["score"], r["start"], r["size"], r["order"] == bits.BIG))
    masks = [mask_of(r["start"], r["size"], r["order"]) for r in order]
    kept: list[dict] = []
    for i, r in enumerate(order):
        if len(kept) >= most or r["score"] < MIN_SCORE:
            break
        if masks[i] & taken:
            continue
        close = []
        for j in range(i + 1, len(order)):
            if order[j]["score"] < max(r["score"] - CLOSE, MIN_SCORE):
                break
            if not masks[j] & taken:
                close.append(masks[j])
        inner = [m for m in close if not m & ~masks[i]]
        if any(m & masks[i] and m & ~masks[i] and any(not m & a for a in inner) for m in close):
            continue
        taken |= masks[i]
        kept.append(r)
    return kept


def widened(start: int, size: int, order: str, rates: np.ndarray, first: bytes, claimed: int) -> tuple[int, int] | None:
    """(start, size) of an unsigned range with the bits above it that are 0 throughout and claimed by no other range.

    It grows to a whole nibble, or on to a whole byte if it begins with one; within one byte it never leaves it. None if
    there is nothing to gain.
    """
    n = len(rates)
    line = np.arange(n) if order == bits.LITTLE else np.arange(n).reshape(-1, 8)[::-1].reshape(-1)
    b, bit = bits.positions(start, size, order)[0]
    low = int(np.flatnonzero(line == 8 * b + bit)[0])
    if bit % 4:
        return None
    goal = -(-size // (4 if bit else 8)) * (4 if bit else 8)
    inside = len({line[low + i] // 8 for i in range(size)}) == 1
    grown = size
    while grown < min(goal, 64) and low + grown < n:
        at = int(line[low + grown])
        if rates[at] or first[at // 8] >> (at % 8) & 1 or claimed >> at & 1 or (inside and at // 8 != b):
            break
        grown += 1
    grown -= grown % 4
    return (int(line[low + grown - 1]) if order == bits.BIG else start, grown) if grown > size else None


_SUGGESTED = "key long, start int, size int, order string, kind string, score double, added int, reason struct<" + REASON.replace(" ", ":").replace(",:", ",") + ">"


def _choose(rows: pd.DataFrame, about: pd.DataFrame, page: bool) -> pd.DataFrame:
    """The choice of one ID (or page of it): candidates without what only moves with the page, best first, widened."""
    names = [part.split()[0] for part in _SUGGESTED.split(", reason")[0].split(", ")] + ["reason"]
    if not (len(rows) and len(about)):
        return pd.DataFrame(columns=names)
    a = about.iloc[0]
    size = int(a["size"])
    rates = np.zeros(8 * size)
    for r in a.rates:
        if r["bit"] < len(rates):
            rates[r["bit"]] = r["rate"]
    found, taken = rows.to_dict("records"), 0
    cells = sum(0xFF << (8 * int(c)) for c in a.cells) if a.cells is not None else 0
    if page:
        taken = sum(1 << int(b) for b in a.taken)
    elif a.selector is not None:
        selector = mask_of(a.selector["start"], a.selector["size"], a.selector["order"])
        stays = lambda m, r: r["kind"] in ("checksum", "float") or m & selector or (not m & cells and (r["kind"] == "counter" or not r["moving"]))
        found = [r for r in found if stays(mask_of(r["start"], r["size"], r["order"]), r)]
    kept = pick(found, taken, max(MOST, size))
    masks = [mask_of(r["start"], r["size"], r["order"]) for r in kept]
    for i, r in enumerate(kept):
        r["added"] = 0
        others = sum(m for j, m in enumerate(masks) if j != i)
        more = widened(r["start"], r["size"], r["order"], rates, a["first"], others) if r["kind"] == "continuous" else None
        if more:
            r["added"], r["start"], r["size"] = more[1] - r["size"], *more
    if page:  # a page's signal takes in the whole of each cell that it touches
        whole = lambda m: all(m >> (8 * int(c)) & 0xFF in (0, 0xFF) for c in a.cells)
        kept = [r for r in kept if r["score"] >= PAGE_SCORE and whole(mask_of(r["start"], r["size"], r["order"]))]
    return pd.DataFrame(kept, columns=names)


def _about(frames: DataFrame, rates: DataFrame) -> DataFrame:
    """(key, size, first, rates): an ID's length, first payload and change rates of bits."""
    rows = frames.where(_PAYLOAD).join(lengths(frames), "key").where(F.length("data") >= F.col("size"))
    first = rows.groupBy("key", "size").agg(F.min_by("data", F.struct("ts_ns", "seq")).alias("first"))
    return first.join(rates.groupBy("key").agg(F.collect_list(F.struct("bit", "rate")).alias("rates")), "key")


def _bits_of() -> Column:
    """The bits of a row's start, size and order."""
    little = F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)
    # the bits of a big-endian range follow each other when each byte's are counted from the top
    top = F.floor(F.col("start") / 8) * 8 + 7 - F.col("start") % 8
    big = F.transform(F.sequence(top, top + F.col("size") - 1), lambda p: F.floor(p / 8) * 8 + 7 - p % 8)
    return F.when(F.col("order") == bits.LITTLE, little.cast("array<long>")).otherwise(big.cast("array<long>"))


def _placed(rows: DataFrame, places: int | None = None) -> DataFrame:
    """rows with first, count, shift and width of their start, size and order, as _value reads them.

    places: so many are read for each range, where what passes a byte in one adds to the next.
    """
    last = F.when(F.col("order") == bits.LITTLE, F.col("start") + F.col("size") - 1).otherwise(F.col("start") - F.col("start") % 8 + 7 - F.col("start") % 8 + F.col("size") - 1)
    first = F.floor(F.col("start") / 8).cast("int")
    count = F.floor(last / 8) - first + 1 if places is None else F.lit(places)
    shift = F.when(F.col("order") == bits.LITTLE, F.col("start") % 8).otherwise(8 * (first + count) - 1 - last)
    return rows.withColumns({"first": first, "count": count.cast("int"), "shift": shift.cast("int"), "width": F.col("size")})


def _multiplexed(frames: DataFrame, base: DataFrame, paging: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """The IDs whose selector is proven by its pages, as (key, pages, cells, start, size, order), and their pages' signals.

    The frames of each value of the selector are a message of their own, with a negative number for a key. At least half
    of the pages must have a good signal: a counter beside bytes that merely change with it stays a counter.
    """
    selector = paging.where(F.size("cells") > 0).select("key", "pages", "cells", "selector.*")
    chosen = base.where("kind = 'counter'").join(selector, ["key", "start", "size", "order"], "left_semi").select("key")
    taken = base.select("key", F.explode(_bits_of()).alias("bit")).groupBy("key").agg(F.collect_set("bit").alias("taken"))
    number = F.row_number().over(Window.orderBy("key", "page"))  # over a row for each page of each such ID
    some = selector.join(chosen, "key", "left_semi").join(taken, "key").withColumn("page", F.explode(F.sequence(F.lit(0), F.col("pages") - 1)))
    pages = stored(some.withColumn("message", -number.cast("long")), "pages")
    if pages.isEmpty():
        return None
    where = _placed(pages.select("key", "start", "size", "order").distinct()).drop("start", "size")
    rows = frames.where(_PAYLOAD).join(where, "key").join(lengths(frames), "key").where(F.length("data") >= F.col("size"))
    rows = rows.withColumn("now", payload_bytes(F.col("data"))).withColumn("page", _value("now"))
    own = rows.select("key", "page", "seq", "ts_ns", "kind", "data").join(pages.select("key", F.col("page").cast("long").alias("page"), "message"), ["key", "page"])
    own = own.drop("key", "page").withColumnRenamed("message", "key")
    parts = pages.select(F.col("message").alias("key"), "cells", "taken")
    found, _, rates = candidates(own, within=parts)
    found = stored(found, "page-candidates")
    about = _about(own, rates).join(parts, "key")
    signals = found.groupBy("key").cogroup(about.groupBy("key")).applyInPandas(lambda rows, about: _choose(rows, about, True), _SUGGESTED)
    named = pages.select(F.col("message"), F.col("key").alias("of"), "page", "pages")
    signals = stored(signals.join(named, F.col("key") == F.col("message")).drop("key", "message").withColumnRenamed("of", "key"), "signals")
    good = signals.groupBy("key", "pages").agg(F.count_distinct("page").alias("found")).where(2 * F.col("found") >= F.col("pages")).select("key")
    return selector.join(good, "key", "left_semi"), signals.drop("pages").join(good, "key", "left_semi")


def _named(rows: pd.DataFrame, proven: pd.DataFrame, about: pd.DataFrame) -> pd.DataFrame:
    """One ID's suggestions with its selector as a multiplexor, widened where no page's byte is."""
    p, a = proven.iloc[0], about.iloc[0]
    rates = np.zeros(8 * int(a["size"]))
    for r in a.rates:
        if r["bit"] < len(rates):
            rates[r["bit"]] = r["rate"]
    own = (rows.start == p.start) & (rows["size"] == p["size"]) & (rows.order == p.order)
    claimed = sum(0xFF << (8 * int(c)) for c in p.cells)
    for r in rows[~own].itertuples(index=False):
        claimed |= mask_of(r.start, r.size, r.order)
    more = widened(int(p.start), int(p["size"]), p.order, rates, a["first"], claimed)
    at = rows.index[own][0]
    rows.loc[at, "kind"] = "multiplexor"
    if more:
        rows.loc[at, ["start", "size", "added"]] = [more[0], more[1], more[1] - int(p["size"])]
    return rows


def suggest(frames: DataFrame, markers_ns: list[int] | None = None, reference: DataFrame | None = None) -> DataFrame:
    """(key, page, start, size, order, kind, score, level, added, pages, cells, reason): each ID's best readings that don't overlap.

    At most MOST, or one a byte of longer IDs. `page` is the value of the ID's multiplexor with which a signal is there,
    null for those in every frame; the multiplexor has its number of `pages` and the bytes, `cells`, that they carry.
    `added` bits on top of a value never change from 0. `reason` says why: a counter's step, wrap and share of steps; the
    lowest and highest value; the number of distinct values; a flag's changes; a checksum's rule; markers near; and the
    fit to a reference series (ts_ns, seq, value).
    """
    found, ranges, rates = candidates(frames, markers_ns)
    if reference is not None:
        found = _with_fits(found, frames, ranges, reference)
    found = stored(found, "candidates")
    paging, moving = pages_of(found, frames, ranges, rates)
    paging = stored(paging, "paging")
    about = stored(_about(frames, rates), "about")
    moved = found.join(moving.withColumn("moving", F.lit(True)), ["key", "range"], "left").withColumn("moving", F.coalesce("moving", F.lit(False)))
    told = about.join(paging.select("key", "selector", "cells"), "key", "left")
    base = stored(moved.groupBy("key").cogroup(told.groupBy("key")).applyInPandas(lambda rows, about: _choose(rows, about, False), _SUGGESTED), "suggestions")
    out = base.withColumns({"page": F.lit(None).cast("int"), "pages": F.lit(None).cast("int"), "cells": F.lit(None).cast("array<int>")})
    multiplexed = _multiplexed(frames, base, paging)
    if multiplexed:
        proven, signals = multiplexed
        told = proven.join(about.withColumnRenamed("size", "length").select("key", "length", "first", "rates"), "key")
        named = base.groupBy("key").cogroup(told.groupBy("key")).applyInPandas(_with_selector, _SUGGESTED)
        is_it = F.col("kind") == "multiplexor"
        shown = named.join(proven.select("key", F.col("pages").alias("n_pages"), F.col("cells").alias("paged")), "key")
        shown = shown.withColumns({"page": F.lit(None).cast("int"), "pages": F.when(is_it, F.col("n_pages")), "cells": F.when(is_it, F.col("paged"))}).select(*out.columns)
        signals = signals.withColumns({"pages": F.lit(None).cast("int"), "cells": F.lit(None).cast("array<int>")}).select(*out.columns)
        out = out.join(proven.select("key"), "key", "left_anti").unionByName(shown).unionByName(signals)
    score = F.round(F.least(F.greatest("score", F.lit(0.0)), F.lit(0.99)), 2)
    leveled = out.withColumn("score", score).withColumn("level", F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low"))
    return leveled.select("key", "page", "start", "size", "order", "kind", "score", "level", "added", "pages", "cells", "reason")


def _with_selector(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
    if not (len(rows) and len(told)):
        return rows.iloc[:0]
    return _named(rows, told, told.rename(columns={"size": "width", "length": "size"}))


def unknown_only(suggestions: DataFrame, known: DataFrame) -> DataFrame:
    """Suggestions none of whose bits a database already describes; known: (key, bit)."""
    covered = _bits_of()
    names = ["key", "start", "size", "order"]
    over = suggestions.select(*names, F.explode(covered).alias("bit")).join(known.select("key", F.col("bit").cast("long").alias("bit")).distinct(), ["key", "bit"], "left_semi").select(*names).distinct()
    return suggestions.join(over, names, "left_anti")
