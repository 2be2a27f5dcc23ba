"""Senders of transport messages for the registered query: the frames that a node would put on the bus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canlake import schema
from canlake.operators.transport import ABORT, BAM, CONTROL, CTS, RTS, TRANSFER

#: Ways to send a message: to all; to one, which asks for the first packet twice; to all without its first packet; to one, which gives up.
TO_ALL, TO_ONE, BROKEN, GIVEN_UP = range(4)


def packets_of(messages: DataFrame, gap_ns: int = 1_000_000) -> DataFrame:
    """The frames that carry messages (seq, ts_ns, channel, sender, to, group, way, data), a gap apart."""
    size, group = F.length("data"), F.col("group")
    count = F.ceil(size / 7).cast("int")
    byte = lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")
    tail = F.concat(byte(group % 256), byte(F.floor(group / 256) % 256), byte(F.floor(group / 65536)))
    way, sender, to = F.col("way"), F.col("sender").cast("long"), F.when(F.col("way").isin(TO_ALL, BROKEN), 255).otherwise(F.col("to")).cast("long")
    frame = lambda form, a, b, hex_: F.struct((F.lit(schema.EXTENDED_ID + 0x18000000 + form * 65536).cast("long") + b * 256 + a).alias("id"), hex_.alias("hex"))
    control = lambda code, a, b, middle: frame(CONTROL, a, b, F.concat(F.lit(f"{code:02X}"), middle, tail))
    announced = F.concat(byte(size % 256), byte(F.floor(size / 256)), byte(count), F.lit("FF"))
    body = lambda n: frame(TRANSFER, sender, to, F.concat(byte(n), F.rpad(F.hex(F.substring(F.col("data"), (n - 1) * 7 + 1, F.lit(7))), 14, "F")))
    bodies = F.transform(F.sequence(F.lit(1), count), body)
    rest = F.slice(bodies, F.lit(2), F.greatest(count - 1, F.lit(0)))
    asks = control(CTS, to, sender, F.concat(byte(count), F.lit("01FFFF")))
    all_, one = control(BAM, sender, to, announced), control(RTS, sender, to, announced)
    said = (
        F.when(way == TO_ALL, F.concat(F.array(all_), bodies)).when(way == BROKEN, F.concat(F.array(all_), rest))
        .when(way == TO_ONE, F.concat(F.array(one, asks, bodies[0], asks), bodies))
        .otherwise(F.concat(F.array(one, bodies[0], control(ABORT, to, sender, F.lit("01FFFFFF"))), rest))
    )
    rows = messages.select("seq", "ts_ns", "channel", F.posexplode(said).alias("n", "p"))
    return rows.select((F.col("seq") * 1000 + F.col("n")).alias("seq"), (F.col("ts_ns") + F.col("n") * gap_ns).alias("ts_ns"), "channel", "p.id", F.lit("data").alias("kind"), F.unhex("p.hex").alias("data"))
