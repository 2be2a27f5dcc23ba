"""Filters that follow a capture: each frame is judged as it arrives, and again if a late frame comes in before it.

Rules on a frame alone need no state. A Changes rule compares a frame with the previous one of its ID and kind; each
(ID, kind) keeps its last frames, so that a late one finds the frame before it, and the frame after it is judged anew.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from canlake.operators.trace import Changes, FrameFilter, _member, _rule

#: How far behind the newest frame of its ID and kind a frame may come and still be placed among the others.
LATE_NS = 10_000_000_000
VERDICT = "seq long, ts_ns long, key long, kind string, matches boolean, revision int"


def _differs(data: bytes, before: bytes | None) -> bool:
    n = 0 if before is None else min(len(data), len(before))
    return n > 0 and data[:n] != before[:n]


class _Follower(StatefulProcessor):
    """The recent frames of one ID and kind in time order, with what was said of each."""

    def __init__(self, match_all: bool, late_ns: int) -> None:
        self.match_all, self.late_ns = match_all, late_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "ts_ns long, seq long, data binary, plain boolean, inside boolean, said boolean, revision int")
        self.cut = handle.getValueState("cut", "cut boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        known = [list(r) for r in self.recent.get()] if self.recent.exists() else []
        cut = self.cut.exists()
        new = pd.concat(list(rows)).sort_values(["ts_ns", "seq"])
        said: list[tuple] = []
        fresh = []
        for r in new.itertuples(index=False):
            row = [int(r.ts_ns), int(r.seq), bytes(r.data) if r.data is not None else b"", bool(r.plain), bool(r.inside), None, 0]
            if cut and known and row[:2] < known[0][:2]:
                said.append((row[1], row[0], None, 0))  # what was before it is gone
            else:
                fresh.append(row)
        lined = sorted(known + fresh, key=lambda r: (r[0], r[1]))
        for i, r in enumerate(lined):
            if cut and i == 0 and r[5] is not None:
                continue  # the frame before the first is gone, and was there when it was judged
            changed = _differs(r[2], lined[i - 1][2] if i else None)
            now = r[4] and (r[3] and changed if self.match_all else r[3] or changed)
            if now != r[5]:
                r[6] += r[5] is not None
                r[5] = now
                said.append((r[1], r[0], now, r[6]))
        if lined:
            first = bisect_left([r[0] for r in lined], lined[-1][0] - self.late_ns)
            keep = lined[max(first - 1, 0) :]
            if len(keep) < len(lined):
                self.cut.update((True,))
            self.recent.put([tuple(r) for r in keep])
        out = pd.DataFrame(said, columns=["seq", "ts_ns", "matches", "revision"])
        yield out.assign(key=key[0], kind=key[1])[["seq", "ts_ns", "key", "kind", "matches", "revision"]].astype({"matches": "boolean"})

    def close(self) -> None:
        pass


def follow(frames: DataFrame, spec: FrameFilter, late_ns: int = LATE_NS) -> DataFrame:
    """(seq, ts_ns, key, kind, matches, revision): what a filter says of a stream's frames, as `settled` puts it together.

    A later revision replaces an earlier one. `matches` is null for a frame that comes more than late_ns behind its ID and
    kind after older frames were let go: what it changed from is unknown, and the frame after it isn't judged anew. Frames
    may arrive in any order; seq tells frames of one time apart. A filter with a Changes rule needs the RocksDB state store.
    """
    kept = frames.where(_member("channel", spec.channels) & _member("key", spec.keys) & _member("kind", spec.kinds))
    inside = F.lit(True)
    if spec.t0_ns is not None:
        inside = inside & (F.col("ts_ns") >= spec.t0_ns)
    if spec.t1_ns is not None:
        inside = inside & (F.col("ts_ns") <= spec.t1_ns)
    own = [_rule(r, kept) for r in spec.rules if not isinstance(r, Changes)]
    plain = reduce(lambda a, b: a & b if spec.match_all else a | b, own) if own else F.lit(spec.match_all)
    if len(own) == len(spec.rules):
        hit = kept.where(inside & (plain if own else F.lit(True)))
        return hit.select("seq", "ts_ns", "key", "kind", F.lit(True).alias("matches"), F.lit(0).alias("revision"))
    judged = kept.select("seq", "ts_ns", "key", "kind", "data", plain.alias("plain"), inside.alias("inside"))
    return judged.groupBy("key", "kind").transformWithStateInPandas(_Follower(spec.match_all, late_ns), VERDICT, "append", "None")


def settled(verdicts: DataFrame) -> DataFrame:
    """(seq, ts_ns, key, kind) of the frames that match by their last revision."""
    last = verdicts.groupBy("seq", "ts_ns", "key", "kind").agg(F.max_by("matches", "revision").alias("matches"))
    return last.where("matches").drop("matches")
