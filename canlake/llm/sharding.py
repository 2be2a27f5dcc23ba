"""Sharding by jump consistent hashing, in native expressions only.

The published generator (state * 2862933555777941757 + 1 modulo 2^64) names, for each key, an increasing chain of
buckets; a key lives in the last bucket of its chain below the number of shards. One more shard therefore takes over
only the keys whose chain has the new number, and no ring table is needed. The 64-bit state is carried as two 32-bit
halves in longs, so that nothing overflows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canlake.llm.common import ranked

# Fixed value: the multiplier of the published generator.
MULTIPLIER = 2862933555777941757
_HIGH, _LOW, _MASK = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF, 0xFFFFFFFF
#: Steps of the chain that every row takes; longer chains (about one in 10^20) go on step by step.
STEPS = 48
BLOCKS = 1024


def _mask(c: Column) -> Column:
    return c.bitwiseAND(F.lit(_MASK).cast("long"))


def _advance(high: Column, low: Column) -> tuple[Column, Column]:
    """The halves of state * MULTIPLIER + 1 modulo 2^64."""
    part0 = low.bitwiseAND(F.lit(0xFFFF).cast("long")) * _LOW
    part1 = F.shiftright(low, 16) * _LOW
    sum_low = _mask(part0) + F.shiftleft(part1.bitwiseAND(F.lit(0xFFFF).cast("long")), 16) + 1
    from_high = high.bitwiseAND(F.lit(0xFFFF).cast("long")) * _LOW + F.shiftleft((F.shiftright(high, 16) * _LOW).bitwiseAND(F.lit(0xFFFF).cast("long")), 16)
    new_high = F.shiftright(part0, 32) + F.shiftright(part1, 16) + F.shiftright(sum_low, 32) + _mask(from_high) + _mask(low * _HIGH)
    return _mask(new_high), _mask(sum_low)


def _key64(key: Column, kind: T.DataType) -> Column:
    """Integers are their own key; anything else is hashed. Null counts as 0."""
    as_long = key.cast("long") if isinstance(kind, T.IntegralType) else F.when(key.isNotNull(), F.xxhash64(key))
    return F.coalesce(as_long, F.lit(0).cast("long"))


def jump(key: Column, shards: int) -> Column:
    """Struct (shard, grown) of a long key: its bucket among `shards` and among one more."""
    if shards < 1:
        raise ValueError("there must be a shard")
    at = lambda v: F.lit(v).cast("long")

    def step(s: Column, _: Column) -> Column:
        high, low = _advance(s["high"], s["low"])
        ahead = F.floor((s["next"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double"))).cast("long")
        moved = F.struct(high.alias("high"), low.alias("low"), ahead.alias("next"), F.when(s["next"] < shards, s["next"]).otherwise(s["shard"]).alias("shard"), s["next"].alias("grown"))
        return F.when(s["next"] <= shards, moved).otherwise(s)

    start = F.struct(_mask(F.shiftrightunsigned(key, 32)).alias("high"), _mask(key).alias("low"), at(0).alias("next"), at(0).alias("shard"), at(0).alias("grown"))
    state = F.aggregate(F.sequence(F.lit(1), F.lit(min(STEPS, shards + 1))), start, step)
    if shards + 1 > STEPS:
        state = F.when(state["next"] > shards, state).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(shards + 1 - STEPS)), state, step))
    return F.struct(state["shard"].cast("int").alias("shard"), state["grown"].cast("int").alias("grown"))


def assign_shards(df: DataFrame, key: str = "doc_id", shards: int = 24, shard: str = "shard", grown: str = "grown_shard") -> DataFrame:
    """df with its shard and the shard with one more appended: a projection, without any shuffle.

    Null keys count as key 0; equal keys share a shard; an empty table stays empty. A column of df that has the name
    of an output column is replaced.
    """
    jumped = df.withColumn("_jump", jump(_key64(F.col(key), df.schema[key].dataType), shards))
    return jumped.withColumn(shard, F.col("_jump.shard")).withColumn(grown, F.col("_jump.grown")).drop("_jump")


def number_slots(df: DataFrame, key: str = "doc_id", shard: str = "shard", slot: str = "slot", blocks: int = BLOCKS) -> DataFrame:
    """df with gapless places from 0 in each shard, ordered by (key's block, all columns).

    The block is taken from low bits of the generator's first state, which the choice of shard hardly uses, so a shard
    is numbered in `blocks` independent parts. Equal rows are counted before they are dealt out. A column named like the
    slot is replaced.
    """
    df = df.drop(slot)
    high, _ = _advance(_mask(F.shiftrightunsigned(k := _key64(F.col(key), df.schema[key].dataType), 32)), _mask(k))
    order = [key, *[c for c in df.columns if c not in (key, shard)]]
    return ranked(df, [shard], F.pmod(high, F.lit(blocks)).cast("int"), order, slot)
