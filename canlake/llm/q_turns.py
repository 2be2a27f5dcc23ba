"""Queries over conversations: repair of their structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from canlake.llm import turn_repair
from canlake.llm.common import table


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(turn_repair.damaged(table(spark, sf_dir, "conversations")))[0]


QUERIES = {"op11_conversation_repair": op11_conversation_repair}
ORACLES = {
    # the same repairs by the grammar's automaton: 0 nothing yet, 1 after the system turn, 2 after a user's, 3 after an assistant's
    "op11_conversation_repair": r"""
WITH RECURSIVE tab AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(CAST(n AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
k AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
f AS MATERIALIZED (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(key, ''), lambda h: CAST(ascii(h) AS BIGINT))), lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8)), 4294967295) % 20 AS fault FROM k, tab),
d AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE fault WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM f),
b AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, CASE WHEN blank THEN '' ELSE sha256(text) END) AS i FROM b),
r AS MATERIALIZED (SELECT *, role[1] AS c, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AND NOT blank AS dup, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM o),
g AS MATERIALIZED (SELECT conv_id, turn, role, text, i, c, blank OR dup AS gone, blank, dup, NOT blank AND NOT dup AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut, coalesce(pair NOT IN ('su', 'ua', 'au'), false) AS illegal FROM r),
a AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated, count(*) FILTER (illegal) AS illegal, max(i) AS n FROM g GROUP BY conv_id),
w AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, unnest([{'p': 0, 'w': {'cost': 0, 'audit': '', 'said': ''}}, {'p': 2, 'w': {'cost': 5, 'audit': 'I', 'said': 'user:'}}, {'p': 3, 'w': {'cost': 10, 'audit': 'II', 'said': 'user:' || chr(10) || 'assistant:'}}]) AS x FROM a
  UNION ALL
  SELECT conv_id, i, {'p': p, 'w': min(w)} AS x FROM (
    WITH e AS (
      SELECT w.conv_id, g.i, w.x.p AS p, w.x.w AS w, g.c, g.gone, g.cut, g.role, g.text FROM w JOIN g ON w.conv_id IS NOT DISTINCT FROM g.conv_id AND g.i = w.i + 1
    ), m AS (
      SELECT conv_id, i, p, {'cost': w.cost + 2, 'audit': w.audit || 'D', 'said': w.said} AS w FROM e
      UNION ALL SELECT conv_id, i, 1, {'cost': w.cost + CASE WHEN cut THEN 5 ELSE 0 END, 'audit': w.audit || 'K', 'said': role || ':' || text} FROM e WHERE NOT gone AND p = 0 AND c = 's'
      UNION ALL SELECT conv_id, i, CASE WHEN p = 2 THEN 3 ELSE 2 END, {'cost': w.cost + CASE WHEN cut THEN 5 ELSE 0 END + CASE WHEN c = CASE WHEN p = 2 THEN 'a' ELSE 'u' END THEN 0 ELSE 1 END,
        'audit': w.audit || CASE WHEN c = CASE WHEN p = 2 THEN 'a' ELSE 'u' END THEN 'K' ELSE 'R' END,
        'said': w.said || CASE WHEN p = 0 THEN '' ELSE chr(10) END || CASE WHEN c = CASE WHEN p = 2 THEN 'a' ELSE 'u' END THEN role WHEN p = 2 THEN 'assistant' ELSE 'user' END || ':' || text} FROM e WHERE NOT gone
    ), s AS (
      SELECT conv_id, i, CASE WHEN p = 2 THEN 3 ELSE 2 END AS p, {'cost': w.cost + 5, 'audit': w.audit || 'I', 'said': w.said || CASE WHEN p = 0 THEN '' ELSE chr(10) END || CASE WHEN p = 2 THEN 'assistant:' ELSE 'user:' END} AS w FROM m
    ), z AS (
      SELECT conv_id, i, CASE WHEN p = 2 THEN 3 ELSE 2 END AS p, {'cost': w.cost + 5, 'audit': w.audit || 'I', 'said': w.said || chr(10) || CASE WHEN p = 2 THEN 'assistant:' ELSE 'user:' END} AS w FROM s
    )
    SELECT * FROM m UNION ALL SELECT * FROM s UNION ALL SELECT * FROM z
  ) GROUP BY conv_id, i, p
),
best AS (SELECT w.conv_id, min(w.x.w) AS w FROM w JOIN a ON w.conv_id IS NOT DISTINCT FROM a.conv_id AND w.i = a.n WHERE w.x.p IN (0, 3) GROUP BY w.conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(w.cost, 0) AS BIGINT) AS cost, coalesce(w.audit, '') AS audit, sha256(coalesce(w.said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN a ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN best ON c.conv_id IS NOT DISTINCT FROM best.conv_id"""
}
