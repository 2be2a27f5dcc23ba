"""Queries over documents by their own columns: sharding and source mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canlake.llm import mixing, sharding
from canlake.llm.common import table

SHARDS = 24


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32("text").alias("text_crc32"))
    placed = sharding.number_slots(sharding.assign_shards(sized, "doc_id", SHARDS))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


QUERIES = {"op1_sharding": op1_sharding}
ORACLES: dict = {
    "op1_sharding": rf"""
WITH RECURSIVE tab AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(CAST(n AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
d AS MATERIALIZED (SELECT doc_id, CAST(coalesce(strlen(text), 0) + 8 AS BIGINT) AS size, row_number() OVER () AS r,
  (CAST(coalesce(doc_id, 0) AS HUGEINT) + 18446744073709551616::HUGEINT) % 18446744073709551616::HUGEINT AS key,
  CASE WHEN text = '' THEN 0 WHEN text IS NOT NULL THEN xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(regexp_replace(hex(encode(text)), '(..)', '\1,', 'g')[:-2], ','), lambda h: CAST('0x' || h AS BIGINT))), lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8)), 4294967295) END AS text_crc32
  FROM documents, tab),
j AS (
  SELECT r, key, CAST(0 AS BIGINT) AS ahead, CAST(0 AS BIGINT) AS shard, CAST(0 AS BIGINT) AS grown FROM d
  UNION ALL
  SELECT r, k, CAST(floor((ahead + 1) * (CAST(2147483648 AS DOUBLE) / CAST(k // 8589934592 + 1 AS DOUBLE))) AS BIGINT), CASE WHEN ahead < {SHARDS} THEN ahead ELSE shard END, ahead
  FROM (SELECT *, (key * {sharding.MULTIPLIER}::HUGEINT + 1) % 18446744073709551616::HUGEINT AS k FROM j WHERE ahead <= {SHARDS})
), f AS (SELECT d.*, CAST(j.shard AS INTEGER) AS shard, CAST(j.grown AS INTEGER) AS grown_shard, ((d.key * {sharding.MULTIPLIER}::HUGEINT + 1) % 18446744073709551616::HUGEINT // 4294967296) % {sharding.BLOCKS} AS block FROM d JOIN j ON d.r = j.r AND j.ahead > {SHARDS})
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY block, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard FROM f"""
}


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.words_in(F.col("text")).alias("size"))
    mixed = mixing.mix(docs)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"), "source")


QUERIES["op8_source_mixing"] = op8_source_mixing
