"""J1939-21 transport protocol: long messages put together from their packets.

Each announcement begins a transfer of its directed pair of addresses and ends the one before. A running count of
announcements therefore numbers the transfers, frames of the receiver take part under the sender's pair, and every
transfer's frames are gathered by themselves; a pause that no timeout allows ends a transfer's frames as well. A fold
over them, in native expressions, goes through the states of the protocol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canlake import schema
from canlake.functions import frames as ff
from canlake.operators.history import with_previous, with_running_sum

# Formats with their data page bits, control bytes, timeouts in ns and the largest size of the protocol.
CONTROL, TRANSFER = 0xEC, 0xEB
RTS, CTS, BAM, ABORT = 16, 17, 32, 255
T1, T2, T3, T4 = 750_000_000, 1_250_000_000, 1_250_000_000, 1_050_000_000
LARGEST = 1785
#: Parts that a frame takes: announcement, packet, clear to send, abort.
ANNOUNCES, CARRIES, CLEARS, ABORTS = "announcement", "packet", "clear", "abort"


def _bits(c: Column, mask: int) -> Column:
    return c.bitwiseAND(F.lit(mask).cast("long"))


def _group() -> Column:
    byte = lambda i: ff.byte(F.col("data"), i).cast("long")
    return byte(5) + byte(6) * 256 + byte(7) * 65536


def parts(frames: DataFrame) -> DataFrame:
    """(channel, sender, to, part, ts_ns, seq, id, data, group): what each frame means to the transfer of a directed pair.

    A clear to send belongs to the pair the other way round, and an abort to both; announcements of impossible sizes mean nothing.
    """
    form = F.shiftright("id", 16).bitwiseAND(F.lit(0x3FF).cast("long"))
    rows = frames.where((_bits(F.col("id"), schema.EXTENDED_ID) != 0) & form.isin(CONTROL, TRANSFER) & (F.col("kind") == "data"))
    own, other = _bits(F.col("id"), 0xFF), _bits(F.shiftright("id", 8), 0xFF)
    control = ff.byte(F.col("data"), 0)
    size = ff.byte(F.col("data"), 1) + ff.byte(F.col("data"), 2) * 256
    whole = (form == CONTROL) & (F.length("data") >= 8)
    pair = lambda sender, to, part: F.struct(sender.alias("sender"), to.alias("to"), F.lit(part).alias("part"))
    means = (
        F.when((form == TRANSFER) & (F.length("data") > 0), F.array(pair(own, other, CARRIES)))
        .when(whole & control.isin(RTS, BAM) & size.between(1, LARGEST), F.array(pair(own, other, ANNOUNCES)))
        .when(whole & (control == CTS), F.array(pair(other, own, CLEARS)))
        .when(whole & (control == ABORT), F.array_distinct(F.array(pair(own, other, ABORTS), pair(other, own, ABORTS))))
    )
    spread = rows.select("channel", "ts_ns", "seq", "id", "data", F.when(form == CONTROL, _group()).alias("group"), F.explode(means).alias("m"))
    return spread.select("channel", "m.sender", "m.to", "m.part", "ts_ns", "seq", "id", "data", "group")


def _step(s: Column, f: Column, head: Column) -> Column:
    """The state after a frame: open, next packet, end of the block asked for, deadline, bytes so far, and the last packet's place."""
    size, connection = head["size"], head["connection"]

    def state(open_: Column, next_: Column, block: Column, until: Column, data: Column, ts: Column, seq: Column) -> Column:
        return F.struct(open_.cast("boolean").alias("open"), next_.cast("int").alias("next"), block.cast("int").alias("block"), until.cast("long").alias("until"), data.cast("binary").alias("data"), ts.cast("long").alias("ts_ns"), seq.cast("long").alias("seq"))

    no = F.lit(None)
    same = state(s["open"], s["next"], s["block"], s["until"], s["data"], s["ts_ns"], s["seq"])
    closed = state(F.lit(False), s["next"], s["block"], s["until"], s["data"], no, no)
    late = f["ts_ns"] > s["until"]
    number = ff.byte(f["data"], 0)
    fits = (number == s["next"]) & (F.length(f["data"]) == 8)
    data = F.substring(F.concat(s["data"], F.substring(f["data"], F.lit(2), F.lit(7))), F.lit(1), size)
    whole = F.length(data) >= size
    limit = F.when(connection & ~F.coalesce(number < s["block"], F.lit(False)), T3).otherwise(T1)
    taken = state(~whole, (s["next"] + 1) % 256, s["block"], f["ts_ns"] + limit, data, F.when(whole, f["ts_ns"]), F.when(whole, f["seq"]))
    carried = F.when(late, closed).when(fits, taken).when(connection, same).otherwise(closed)
    count, first = ff.byte(f["data"], 1), ff.byte(f["data"], 2)
    held = state(s["open"], s["next"], s["block"], f["ts_ns"] + T4, s["data"], no, no)
    asked = state(s["open"], first, F.least(first + count - 1, F.lit(255)), f["ts_ns"] + T2, F.substring(s["data"], F.lit(1), (first - 1) * 7), no, no)
    cleared = F.when(~connection | late, closed).when(count == 0, held).when((first == 0) | (first > s["next"]), closed).otherwise(asked)
    aborted = F.when(f["group"] == head["group"], closed).otherwise(same)
    return F.when(~s["open"], same).when(f["part"] == CARRIES, carried).when(f["part"] == CLEARS, cleared).otherwise(aborted)


def reassemble(frames: DataFrame) -> DataFrame:
    """Frames of kind reassembled: the time and place of the last packet, the group's ID, and the whole payload.

    What is out of order, short, late, aborted or announced anew drops a transfer, as the protocol has it.
    """
    pair = ["channel", "sender", "to"]
    rows = with_previous(parts(frames), pair, {"ts_ns": "before"})
    # longer pauses than any timeout end a transfer, so their frames needn't be gathered with those before
    announces = F.col("part") == ANNOUNCES
    cut = announces | F.coalesce(F.col("ts_ns") - F.col("before") > max(T1, T2, T3, T4), F.lit(True))
    numbered = with_running_sum(rows, pair, cut.cast("long"), "transfer", by_time=True)
    frame = F.struct("ts_ns", "seq", "part", "id", "data", "group")
    gathered = numbered.groupBy(*pair, "transfer").agg(F.sort_array(F.collect_list(frame)).alias("frames")).where((F.col("frames")[0]["part"] == ANNOUNCES) & (F.size("frames") > 1))
    first = F.col("frames")[0]
    byte = lambda i: ff.byte(first["data"], i)
    head = F.struct((byte(1) + byte(2) * 256).alias("size"), (byte(0) == RTS).alias("connection"), first["group"].alias("group"))
    opened = gathered.select(*pair, first["id"].alias("id"), head.alias("head"), F.slice("frames", F.lit(2), F.size("frames") - 1).alias("rest"), first["ts_ns"].alias("begun"))
    start = F.struct(
        F.lit(True).alias("open"), F.lit(1).alias("next"), F.lit(None).cast("int").alias("block"), (F.col("begun") + F.when(F.col("head.connection"), T3).otherwise(T1)).cast("long").alias("until"),
        F.unhex(F.lit("")).alias("data"), F.lit(None).cast("long").alias("ts_ns"), F.lit(None).cast("long").alias("seq"),
    )
    ended = opened.withColumn("end", F.aggregate("rest", start, lambda s, f: _step(s, f, F.col("head")))).where("end.ts_ns is not null")
    group = F.col("head.group")
    specific = F.when(_bits(F.shiftright(group, 8), 0xFF) < 240, F.col("to")).otherwise(_bits(group, 0xFF))
    id_ = F.lit(schema.EXTENDED_ID).cast("long") + _bits(F.col("id"), 7 << 26) + _bits(group, 0x3FF00) * 256 + specific * 256 + F.col("sender")
    made = ended.select(F.col("end.seq").alias("seq"), F.col("end.ts_ns").alias("ts_ns"), "channel", id_.alias("id"), F.col("end.data").alias("data"))
    return made.select("seq", "ts_ns", "channel", "id", ff.key(F.col("channel"), F.col("id")).alias("key"), F.lit(schema.REASSEMBLED).alias("flags"), F.lit("reassembled").alias("kind"), F.length("data").alias("len"), F.lit(None).cast("int").alias("remote_dlc"), "data")
