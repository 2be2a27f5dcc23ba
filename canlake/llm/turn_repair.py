"""Conversation structure repair by Wagner-Fischer alignment with the alternating grammar.

A repaired conversation reads `(s?(ua)+)?` by its roles' initials: an optional system turn, then user and assistant in
turn, or nothing at all. The turns are aligned with the grammar's string of every feasible length. All strings that end
alike are tails of the longest one, so one table of alignment costs, filled from the end, serves every length; Ukkonen's
band keeps the cells that an alignment within the incumbent cost can pass, and the incumbent is doubled until it holds an
alignment of every kind asked for. Lengths that come out equally cheap are traced back, and their audits compared.

A long conversation is cut into blocks. A block is aligned from each place in the grammar where it may begin to each where
it may end, and blocks are joined like matrices over (cost, audit), which loses nothing: of two ways with equal ends the
cheaper wins whatever surrounds them, and equally cheap audits are never each other's beginnings.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from canlake.llm.common import WORD, written

# Costs of the edits, in the order of their initials' codes: D, I, K, R; and what a truncated turn adds unless it goes.
DELETE, INSERT, KEEP, REROLE, TRUNCATED = 2, 5, 0, 1, 5
#: Distinct turns and bytes of text of a block at most (one turn may be longer).
BLOCK, BLOCK_BYTES = 128, 1 << 22
#: Places in the grammar: nothing yet, after the system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
_FAR = 1 << 40
#: Initials of neighbours that need no repair.
LEGAL = ("su", "ua", "au")
_NAME = {"u": "user", "a": "assistant"}
_AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_OTHER = {"u": "a", "a": "u"}


def _expected(place: int) -> str:
    """The initial that an edit at this place must give, but for a system turn at the start."""
    return "a" if place == USER else "u"


def _fit(turn: str, want: str) -> int:
    """Cost of keeping or reroling a turn to this initial. Turns are s, u, a or o (another role); capitals are truncated."""
    extra = TRUNCATED if turn.isupper() else 0
    if turn.lower() == want:
        return KEEP + extra
    return REROLE + extra if want != "s" else _FAR


def _table(turns: str, last: str, incumbent: int) -> np.ndarray:
    """Least costs of aligning turns[i:] with the last j symbols of the alternating string that ends with `last`.

    Costs above the incumbent may be missing: a cell is filled only if the deletions or insertions that its diagonal
    needs are within the incumbent.
    """
    n, fewer, more = len(turns), incumbent // DELETE, incumbent // INSERT
    width = n + more + 1
    cost = np.full((n + 1, width), _FAR, np.int64)
    step = INSERT * np.arange(width)
    fits = {t: np.array([_fit(t, want) for want in (last, _OTHER[last])]) for t in set(turns)}
    cost[n, : more + 1] = step[: more + 1]
    for i in range(n - 1, -1, -1):
        low, high = max(n - i - fewer, 0), min(n - i + more, width - 1) + 1
        row = DELETE + cost[i + 1, low:high]
        first = max(low, 1)
        places = np.arange(first, high)
        row[first - low :] = np.minimum(row[first - low :], cost[i + 1, first - 1 : high - 1] + fits[turns[i]][(places - 1) & 1])
        cost[i, low:high] = np.minimum.accumulate(row - step[low:high]) + step[low:high]
    return cost


def _trace(turns: str, gone: tuple[int, ...], cost: np.ndarray, i: int, j: int, last: str) -> str:
    """The ASCII-least audit of a cheapest alignment from cell (i, j); turns that must go are deleted as they are met."""
    out, n = ["D" * gone[i]], len(turns)
    while i < n or j:
        here = cost[i, j]
        if i < n and here == DELETE + cost[i + 1, j]:
            out.append("D" + "D" * gone[i + 1])
            i += 1
        elif j and here == INSERT + cost[i, j - 1]:
            out.append("I")
            j -= 1
        else:
            want = last if j & 1 else _OTHER[last]
            out.append(("K" if turns[i].lower() == want else "R") + "D" * gone[i + 1])
            i, j = i + 1, j - 1
    return "".join(out)


@lru_cache(maxsize=1 << 14)
def align(turns: str, gone: tuple[int, ...]) -> dict[tuple[int, int], tuple[int, str]]:
    """(cost, audit) of the best repair of a block from each place to each place that can be reached.

    `turns` are those that may stay; `gone` counts the turns that must go before each of them and after the last.
    """
    n, forced = len(turns), DELETE * sum(gone)
    systems = [i for i, t in enumerate(turns) if t in "sS"]
    before = ["D" * (i + sum(gone[: i + 1])) for i in systems]

    def ways(cost: np.ndarray, last: str, place: int) -> tuple[int, str] | None:
        odd = 1 if _expected(place) == last else 0  # lengths that begin with what the place expects
        least = 2 - odd if place in (START, SYSTEM) else odd  # from these, no symbol at all would not end here
        found: list[tuple[int, int, int, str]] = [(int(cost[0, j]), 0, j, "") for j in range(least, cost.shape[1], 2)]
        if place == START:
            after = 1 if last == "u" else 2
            found += [(DELETE * i + _fit(turns[i], "s") + int(cost[i + 1, j]), i + 1, j, head + "K") for i, head in zip(systems, before) for j in range(after, cost.shape[1], 2)]
        best = min((f[0] for f in found), default=_FAR)
        if best >= _FAR:
            return None
        return best + forced, min(head + _trace(turns, gone, cost, i, j, last) for c, i, j, head in found if c == best)

    ends = [(place, last) for last in "ua" for place in (START, SYSTEM, USER, ASSISTANT)]
    incumbent, out = 8 * INSERT, {}
    while True:
        for last in "ua":
            cost = _table(turns, last, incumbent)
            out |= {(place, _AFTER[last]): ways(cost, last, place) for place, end in ends if end == last}
        if all(x is not None and x[0] - forced <= incumbent for x in out.values()):
            break
        incumbent *= 2
    everything = (DELETE * n + forced, "D" * (n + sum(gone)))
    out |= {(START, START): everything, (SYSTEM, SYSTEM): everything}
    kept = [(DELETE * (n - 1) + _fit(turns[i], "s") + forced, head + "K" + "D" * (n - 1 - i + sum(gone[i + 1 :]))) for i, head in zip(systems, before)]
    if kept:
        out[START, SYSTEM] = min(kept)
    return out


@dataclass
class Part:
    """A run of a conversation's turns after damage: its counts, its ends, and its best repairs between places."""

    turns: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first: str = ""
    last: str = ""
    numbers: int = 0
    low: int | None = None
    high: int | None = None
    ways: dict[tuple[int, int], tuple[int, str, str]] = field(default_factory=lambda: {(p, p): (0, "", "") for p in range(4)})

    def join(self, other: Part) -> Part:
        """The two parts as one; the path of a way has the place at which every block ends."""
        if not (self.turns and other.turns):
            return self if self.turns else other
        both = {k: getattr(self, k) + getattr(other, k) for k in ("turns", "blank", "duplicate", "truncated", "illegal", "numbers")}
        both["illegal"] += self.last + other.first not in LEGAL
        both["numbers"] -= self.high is not None and self.high == other.low
        lows, highs = ([x for x in pair if x is not None] for pair in ((self.low, other.low), (self.high, other.high)))
        return Part(**both, first=self.first, last=other.last, low=min(lows, default=None), high=max(highs, default=None), ways=_joined(self.ways, other.ways))

    def result(self) -> dict:
        """The digest of a whole conversation, but for the hash, and the path of its best repair."""
        cost, audit, path = min(w for (a, b), w in self.ways.items() if a == START and b in (START, ASSISTANT))
        gaps = self.high - self.low + 1 - self.numbers if self.high is not None else 0
        counts = {k: getattr(self, k) for k in ("blank", "duplicate", "truncated", "illegal")}
        return {"gaps": min(gaps, (1 << 63) - 1), **counts, "cost": cost, "audit": audit, "path": path}


class Joiner:
    """Parts joined in order, neighbours of about equal size first, so that audits are copied a logarithm of times."""

    def __init__(self) -> None:
        self.stack: list[tuple[int, Part]] = []

    def add(self, part: Part) -> None:
        size = max(part.turns, 1)
        while self.stack and self.stack[-1][0] <= size:
            before, left = self.stack.pop()
            size, part = before + size, left.join(part)
        self.stack.append((size, part))

    def total(self) -> Part:
        out = Part()
        for _, part in reversed(self.stack):
            out = part.join(out)
        return out


def _joined(left: dict, right: dict) -> dict:
    out: dict = {}
    for (a, b), (cost, audit, path) in left.items():
        for (c, d), (more, rest, on) in right.items():
            if b == c:
                way = (cost + more, audit + rest, path + on)
                if (a, d) not in out or way < out[a, d]:
                    out[a, d] = way
    return out


class Block:
    """Consecutive distinct turns of one conversation, each with the number of its equal rows."""

    def __init__(self) -> None:
        self.part, self.size, self.shape = Part(), 0, ""
        self.gone, self.kept = [0], []

    def add(self, turn: int | None, role: str, name: str, text: str | None, n: int) -> None:
        """n equal rows: blank ones have no name, and rows that all repeat an earlier turn no text."""
        p = self.part
        if p.turns:
            p.illegal += p.last + role[:1] not in LEGAL
        else:
            p.first = role[:1]
        p.last = role[:1]
        p.illegal += n - 1  # no role may follow itself
        p.turns += n
        if turn is not None:
            p.numbers += turn != p.high
            p.low, p.high = turn if p.low is None else p.low, turn
        if not name:
            p.blank += n
            self.gone[-1] += n
        elif text is None:
            p.duplicate += n
            self.gone[-1] += n
        else:
            p.duplicate += n - 1
            cut = text.rstrip(_SPACE)[-1] not in ".!?"
            p.truncated += cut
            kind = role[:1] if role[:1] in ("s", "u", "a") else "o"
            self.shape += kind.upper() if cut else kind
            self.kept.append((role, text))
            self.gone.append(n - 1)
            self.size += len(text)

    @property
    def full(self) -> bool:
        return len(self.kept) >= BLOCK or self.size >= BLOCK_BYTES

    def ways(self) -> dict[tuple[int, int], tuple[int, str]]:
        return align(self.shape, tuple(self.gone))

    def close(self) -> Part:
        self.part.ways = {(a, b): (cost, audit, str(b)) for (a, b), (cost, audit) in self.ways().items()}
        return self.part


_SPACE = " \t\n\v\f\r"


def lines(shape: str, gone: list[int], kept: list[tuple[str, str]], place: int, audit: str) -> Iterator[str]:
    """The repaired `role:text` lines of a block that begins at this place in the grammar."""
    i, at = 0, gone[0]  # `at` characters of the audit delete turns that must go
    for edit in audit:
        if at and edit == "D":
            at -= 1
            continue
        if edit == "I":
            made = _expected(place)
            yield f"{_NAME[made]}:"
        else:
            role, text = kept[i]
            i, at = i + 1, gone[i + 1]
            if edit == "D":
                continue
            made = shape[i - 1].lower() if edit == "K" else _expected(place)
            yield f"{role if edit == 'K' else _NAME[made]}:{text}"
        place = _AFTER[made]


def digest(pieces: Iterator[str]) -> str:
    """SHA-256 of the lines joined by newlines, one line at a time."""
    hashed, first = hashlib.sha256(), True
    for line in pieces:
        hashed.update(line.encode() if first else b"\n" + line.encode())
        first = False
    return hashed.hexdigest()


def damaged(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, n): rows with seeded faults by the CRC-32 of `conv_id:turn`, n times each; dropped rows have n = 0.

    A remainder of 20 says: 0 drops a row, 1 empties its text, 2 takes its full stops, exclamation and question marks,
    3 repeats it, 4 makes its role user. Nulls in that key, in roles and in texts are one blank.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank(conv_id), F.lit(":"), blank(turn))) % 20
    shown = F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace(blank(text), "[.!?]", "")).otherwise(blank(text))
    said = F.when(fault == 4, F.lit("user")).otherwise(blank(role))
    times = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)
    return rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), said.alias("role"), shown.alias("text"), times.cast("long").alias("n"))


_FINAL = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_ROW = f"kind string, part int, block int, {_FINAL}, state string, kept array<struct<role:string,text:string>>, lines array<string>"


def _stream(rows: Iterator[pa.RecordBatch], schema: pa.Schema, with_lines: bool) -> Iterator[pa.RecordBatch]:
    """Blocks and parts of the conversations of one partition, sorted; a conversation within one block comes out whole.

    A partition's first and last conversation may go on in its neighbours, so they come out as parts, like long ones.
    """
    out: list[dict] = []
    now, part, block, joiner, at, held = None, -1, Block(), Joiner(), 0, []

    def close_block() -> None:
        nonlocal block, at
        if block.part.turns:
            joiner.add(block.close())
            held.append((at, block))
            at, block = at + 1, Block()

    def close(edge: bool) -> None:
        nonlocal joiner, at
        close_block()
        total = joiner.total()
        key = {"conv_id": now[0], "part": part}
        if edge or len(held) < at:
            emit_blocks()
            out.append(key | {"kind": "part", "state": json.dumps(asdict(total) | {"ways": [[*k, *v] for k, v in total.ways.items()]})})
        else:
            found = total.result()
            made = (line for _, b in held for line in lines(b.shape, b.gone, b.kept, START, found["audit"]))
            made = list(made) if with_lines else made
            out.append(key | {"kind": "whole", "repaired_sha256": digest(iter(made)), "lines": made if with_lines else None} | {k: v for k, v in found.items() if k != "path"})
        held.clear()
        joiner, at = Joiner(), 0

    def emit_blocks() -> None:
        for i, b in held:
            out.append({"conv_id": now[0], "part": part, "kind": "block", "block": i, "state": json.dumps([b.shape, b.gone]), "kept": [{"role": r, "text": t} for r, t in b.kept]})
        held.clear()

    first = True
    ready: tuple | None = None  # (key, text) of the first of equal turns, until their number comes
    for b in rows:
        cols = [b.column(i).to_pylist() for i in range(b.num_columns)]
        for conv_id, turn, role, name, text, n, part_of in zip(*cols):
            if now is None or now[0] != conv_id:
                if now is not None:
                    close(edge=first)
                    first = False
                now, part, ready = (conv_id,), part_of, None
            if name is None:
                continue
            if not n:
                ready = ((turn, role, name), text)
                continue
            block.add(turn, role, name, ready[1] if ready and ready[0] == (turn, role, name) else None, n)
            if block.full:
                close_block()
                emit_blocks()
        if len(out) >= 512:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if now is not None:
        close(edge=True)
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _assembler(schema: pa.Schema) -> Callable[[pa.Table], pa.Table]:
    def assemble(parts: pa.Table) -> pa.Table:
        """The parts of one conversation, at most one for each partition, joined in order, with the places between its blocks."""
        rows = sorted(parts.to_pylist(), key=lambda r: r["part"])
        joiner, blocks = Joiner(), []
        for r in rows:
            state = json.loads(r["state"])
            part = Part(**state | {"ways": {(a, b): (cost, audit, path) for a, b, cost, audit, path in state["ways"]}})
            blocks += [(r["part"], i) for i in range(len(next(iter(part.ways.values()))[2]) if part.turns else 0)]
            joiner.add(part)
        found = joiner.total().result()
        ends = [START, *map(int, found.pop("path"))]
        moves = [{"part": p, "block": i, "entry": a, "exit": b} for (p, i), a, b in zip(blocks, ends, ends[1:])]
        return pa.Table.from_pylist([found | {"conv_id": rows[0]["conv_id"], "moves": moves}], schema)

    return assemble


def _apply(rows: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The repaired lines of blocks whose places are known."""
    for b in rows:
        out = []
        for r in b.to_pylist():
            shape, gone = json.loads(r["state"])
            _, audit = align(shape, tuple(gone))[r["entry"], r["exit"]]
            made = lines(shape, gone, [(k["role"], k["text"]) for k in r["kept"]], r["entry"], audit)
            out.append({"conv_id": r["conv_id"], "part": r["part"], "block": r["block"], "lines": list(made)})
        yield pa.RecordBatch.from_pylist(out, schema)


def _hash(rows: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A hash for each conversation over its blocks as they come, in order."""
    now, hashed, any_line = None, None, False
    out = []
    for b in rows:
        for conv_id, made in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if now is None or now[0] != conv_id:
                if now is not None:
                    out.append({"conv_id": now[0], "repaired_sha256": hashed.hexdigest()})
                now, hashed, any_line = (conv_id,), hashlib.sha256(), False
            for line in made:
                hashed.update(b"\n" + line.encode() if any_line else line.encode())
                any_line = True
    if now is not None:
        out.append({"conv_id": now[0], "repaired_sha256": hashed.hexdigest()})
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def repair(rows: DataFrame, with_lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Digests and repaired lines of the conversations in `rows`: (conv_id, turn, role, text, n) as `damaged` gives them.

    Digests: one row for each conv_id, null included, with gaps, counts of faults, illegal neighbours, cost, audit and
    repaired_sha256. Lines, if asked for: (conv_id, part, block, lines) in order of part and block. Rows of n = 0 only
    make their conversation known. Turns go by number, nulls first; equal numbers by role, blank texts, then SHA-256 of
    the text, so equal rows are neighbours. gaps is clamped to a long.

    Equal rows are counted before they move, and only the first of equal (role, text) brings its text. Ranges of
    (conversation, turn) are dealt to tasks, so long conversations are split; only the hash of a repaired conversation,
    sequential by its nature, runs over all its lines in one task, a line at a time.
    """
    spark = rows.sparkSession
    conv = rows.schema["conv_id"].dataType.simpleString()
    name = F.when(F.col("text").rlike(WORD), F.sha2("text", 256)).otherwise(F.lit(""))
    there = rows.where("n > 0").withColumn("name", name)
    counted = there.groupBy("conv_id", "turn", "role", "name").agg(F.sum("n").alias("n")).withColumn("text", F.lit(None).cast("string"))
    first = there.where("name <> ''").groupBy("conv_id", "role", "text").agg(F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("unnumbered"))
    first = first.select("conv_id", F.when(~F.col("unnumbered"), F.col("least")).alias("turn"), "role", F.sha2("text", 256).alias("name"), F.lit(0).cast("long").alias("n"), "text")
    known = rows.select("conv_id").distinct().selectExpr("conv_id", "cast(null as bigint) turn", "'' role", "cast(null as string) name", "0L n", "cast(null as string) text")
    order = ["conv_id", "turn", "role", "name"]
    dealt = counted.unionByName(first).unionByName(known).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
    dealt = dealt.sortWithinPartitions(*order, "n").select("conv_id", "turn", "role", "name", "text", "n", F.spark_partition_id().alias("part"))

    def typed(ddl: str) -> tuple[str, pa.Schema]:
        full = f"conv_id {conv}, {ddl}"
        return full, to_arrow_schema(spark.createDataFrame([], full).schema)

    ddl, schema = typed(_ROW)
    found = written(dealt.mapInArrow(partial(_stream, schema=schema, with_lines=with_lines), ddl), "turns")
    digest_columns = ["conv_id", *[c.split()[0] for c in _FINAL.split(", ")]]
    ddl, schema = typed(f"{_FINAL.rpartition(', ')[0]}, moves array<struct<part:int,block:int,entry:int,exit:int>>")
    parts = found.where("kind = 'part'").select("conv_id", "part", "state")
    joined = written(parts.groupBy("conv_id").applyInArrow(_assembler(schema), ddl), "repairs")
    moves = joined.select(F.col("conv_id").alias("of"), F.explode("moves").alias("m")).select("of", F.col("m.part").alias("_part"), F.col("m.block").alias("_block"), "m.entry", "m.exit")
    blocks = found.where("kind = 'block'").select("conv_id", "part", "block", "state", "kept")
    placed = blocks.join(moves, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("_part")) & (F.col("block") == F.col("_block")))
    ddl, schema = typed("part int, block int, lines array<string>")
    made = written(placed.select("conv_id", "part", "block", "state", "kept", "entry", "exit").mapInArrow(partial(_apply, schema=schema), ddl), "lines")
    ddl, schema = typed("repaired_sha256 string")
    hashes = made.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block").select("conv_id", "lines").mapInArrow(partial(_hash, schema=schema), ddl)
    hashes = hashes.withColumnRenamed("conv_id", "of")
    long = joined.join(hashes, F.col("conv_id").eqNullSafe(F.col("of")), "left").withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())))
    digests = found.where("kind = 'whole'").select(*digest_columns).unionByName(long.select(*digest_columns))
    return digests, made.unionByName(found.where("kind = 'whole' AND lines IS NOT NULL").selectExpr("conv_id", "part", "0 block", "lines"))
