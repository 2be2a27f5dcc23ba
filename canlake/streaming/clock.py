"""Capture times from adapters' own clocks: counters that wrap, run fast or slow, and jump.

A clock keeps an anchor, a pair of readings of the adapter and the host that are taken for one moment. A frame's time is
the anchor's host time and the adapter's time since, unwrapped by what the host says has passed. The anchor slides, at most
by SLEW of the adapter's progress: back if a frame would be timed after it arrived, and forward if even the promptest frame
of a window was late. Frames far ahead of the host are held to AHEAD; when frames stay far off, the clock is anchored anew.

A clock is a fold over an adapter's frames in the order they arrived, so one adapter's frames go through one task, a few
numbers in memory: `stamped` does it for a recorded table, `stamp_stream` for a stream, with the clock as state.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from math import floor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Fixed values, in ns but for the share and the count: how far ahead of the host a time may be and how far behind it before
# the anchor counts as off, the slew's share, window and margin, and how long and for how many frames a clock must be off.
AHEAD, BEHIND, SLEW, WINDOW, MARGIN, OFF_FOR, OFF_FRAMES = 1e9, 2e9, 1e-3, 10e9, 1e6, 2e9, 3
#: When a counter of 60 s, and one of 32 bits of microseconds, starts anew.
SLCAN_WRAP, GS_USB_WRAP = 60 * 10**9, (1 << 32) * 1000


@dataclass
class Clock:
    """The state of one adapter's clock; all times in ns. Unset, it is anchored by the first frame."""

    wrap_ns: int
    device: float | None = None
    host: float = 0.0
    reached: float = 0.0
    window_from: float = 0.0
    promptest: float | None = None
    to_go: float = 0.0
    off_first: tuple[float, float] | None = None
    off_frames: int = 0
    off_best: tuple[float, float, float] | None = None
    given: float | None = None
    catching_up: bool = False

    def anchor(self, device: float, host: float) -> None:
        """The adapter read `device` when the host read `host`."""
        self.device, self.host = device, host
        self.reached, self.to_go = 0.0, 0.0
        self.window_from, self.promptest = host, None
        self.off_first = self.off_best = None

    def _stays_off(self, device: float, host: float, ahead: float) -> tuple[float, float, float] | None:
        """Of frames that are off alike, the least late, once they are enough for long enough."""
        if -BEHIND <= ahead <= AHEAD:
            self.off_first = None
            return None
        if self.off_first is None or abs(ahead - self.off_first[1]) > AHEAD:
            self.off_first, self.off_frames, self.off_best = (host, ahead), 0, None
        self.off_frames += 1
        if self.off_best is None or ahead > self.off_best[2]:
            self.off_best = (device, host, ahead)
        return self.off_best if self.off_frames >= OFF_FRAMES and host - self.off_first[0] >= OFF_FOR else None

    def time(self, device: float, host: float) -> tuple[float, float | None]:
        """A frame's time, and by how much the clock was ahead if this frame anchored it anew (null if not)."""
        if self.device is None:
            self.anchor(device, host)
        jumped = None
        for _ in range(2):
            passed = device - self.device
            passed += self.wrap_ns * floor((host - self.host - passed) / self.wrap_ns + 0.5)
            ahead = self.host + passed - host
            best = self._stays_off(device, host, ahead)
            if best is None:
                break
            self.anchor(best[0], best[1])
            self.catching_up, jumped = True, best[2]
        if ahead > AHEAD:
            return self._give(host + AHEAD), jumped
        progress = max(0.0, passed - self.reached)
        self.reached += progress
        near = ahead >= -BEHIND
        if near:
            bound = host - passed  # an anchor up to here times this frame no later than it arrived
            self.promptest = bound if self.promptest is None else min(self.promptest, bound)
            if host - self.window_from >= WINDOW:
                self.to_go = max(0.0, self.promptest - MARGIN - self.host)
                self.window_from, self.promptest = host, None
        if ahead > 0:
            self.host -= min(ahead, SLEW * progress)
            self.to_go = 0.0
        elif near and self.to_go > 0:
            step = min(self.to_go, -ahead, SLEW * progress)
            self.host, self.to_go = self.host + step, self.to_go - step
        return self._give(self.host + passed), jumped

    def _give(self, time: float) -> float:
        """The time, but after a new anchor never one that isn't past the last time given."""
        if self.catching_up:
            if time > self.given:
                self.catching_up = False
            else:
                time = self.given + 1
        self.given = time
        return time

    def save(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def load(cls, text: str) -> Clock:
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(text).items()})


_ADDED = "ts_ns long, jumped_ns long"


def _timed(clock: Clock, rows: pd.DataFrame) -> pd.DataFrame:
    """rows in order of arrival with their times."""
    found = [clock.time(d, h) for d, h in zip(rows.device_ns.tolist(), rows.host_ns.tolist())]
    whole = lambda x: pd.NA if x is None else int(floor(x + 0.5))
    return rows.assign(ts_ns=[whole(t) for t, _ in found], jumped_ns=pd.array([whole(j) for _, j in found], "Int64"))


def stamped(frames: DataFrame, wrap_ns: int, adapter: str = "adapter") -> DataFrame:
    """frames with ts_ns and jumped_ns from device_ns, host_ns and arrival (the order of arrival, unique in an adapter).

    jumped_ns tells at a new anchor by how much the adapter's clock was ahead of the host's; it is null elsewhere. Rows
    with a null reading have no time and leave the clock alone.
    """
    rows = frames.repartition(adapter).sortWithinPartitions(adapter, "arrival")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clock, now = Clock(wrap_ns), None
        for p in parts:
            for name, of in p.groupby(adapter, sort=False, dropna=False):
                if now is None or now[0] != name:
                    clock, now = Clock(wrap_ns), (name,)
                yield _with_readings(clock, of)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema if f.name not in ("ts_ns", "jumped_ns"))
    return rows.drop("ts_ns", "jumped_ns").mapInPandas(run, f"{fields}, {_ADDED}")


def _with_readings(clock: Clock, rows: pd.DataFrame) -> pd.DataFrame:
    known = rows.device_ns.notna() & rows.host_ns.notna()
    empty = rows[~known].assign(ts_ns=pd.array([pd.NA] * int((~known).sum()), "Int64"), jumped_ns=pd.array([pd.NA] * int((~known).sum()), "Int64"))
    return pd.concat([_timed(clock, rows[known]), empty]) if len(empty) else _timed(clock, rows)


class _ClockProcessor(StatefulProcessor):
    """One adapter's clock as value state, across the batches of a stream."""

    def __init__(self, wrap_ns: int) -> None:
        self.wrap_ns = wrap_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("clock", "clock string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        clock = Clock.load(self.state.get()[0]) if self.state.exists() else Clock(self.wrap_ns)
        yield _with_readings(clock, pd.concat(list(rows)).sort_values("arrival", kind="stable"))
        self.state.update((clock.save(),))

    def close(self) -> None:
        pass


def stamp_stream(frames: DataFrame, wrap_ns: int, adapter: str = "adapter") -> DataFrame:
    """A stream of frames with ts_ns and jumped_ns, as `stamped` gives them for the same frames in the same order.

    Needs the RocksDB state store. The frames of a batch must have arrived after those of earlier batches.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema if f.name not in ("ts_ns", "jumped_ns"))
    return frames.drop("ts_ns", "jumped_ns").groupBy(adapter).transformWithStateInPandas(_ClockProcessor(wrap_ns), f"{fields}, {_ADDED}", "append", "None")


def messages(frames: DataFrame, adapter: str = "adapter") -> DataFrame:
    """(adapter, arrival, message) of the frames at which a clock was anchored anew."""
    way = F.when(F.col("jumped_ns") > 0, F.lit("ahead of")).otherwise(F.lit("behind"))
    text = F.format_string("clock %s s %s the computer's, anchored anew", F.format_number(F.abs("jumped_ns") / 1e9, 1), way)
    return frames.where("jumped_ns is not null").select(adapter, "arrival", text.alias("message"))
