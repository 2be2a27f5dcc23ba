"""Queries that audit filters: how five text filters interact in every order."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canlake.llm import filter_audit
from canlake.llm.common import WORD, table


def conditions() -> dict[str, Column]:
    """Failure conditions of the filters that a text tells alone; E, the repeat of a smaller id's text, comes last."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = filter_audit.failure_sets(table(spark, sf_dir, "documents"), conditions(), table(spark, sf_dir, "labels"), duplicate="E")
    return filter_audit.audit(sets, list("ABCDE"))


QUERIES = {"op13_filter_audit": op13_filter_audit}
_ORDERS = ", ".join(f"('{''.join(o)}')" for o in permutations("ABCDE"))
ORACLES = {
    "op13_filter_audit": rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
firsts AS (SELECT text, min(doc_id) AS first FROM t GROUP BY text),
told AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
d AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN t.doc_id > first THEN 'E' ELSE '' END AS failed
  FROM t JOIN firsts USING (text) LEFT JOIN told USING (doc_id)
),
cells AS (SELECT part, failed, good, toxic, count(*) AS n FROM d GROUP BY ALL),
orders AS (SELECT * FROM (VALUES {_ORDERS}) AS v(filter_order)),
steps AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS f, filter_order[1:step - 1] AS before FROM orders, range(1, 6) AS r(step)),
judged AS (
  SELECT part, filter_order, step, f, n, good, toxic, failed, contains(failed, f) AS fails, len(list_filter(string_split(failed, ''), lambda x: x <> '' AND contains(before, x))) > 0 AS gone
  FROM cells, steps
),
counted AS (
  SELECT part, filter_order, step, f, sum(n) FILTER (NOT gone AND NOT fails) AS kept, sum(n) FILTER (NOT gone AND fails) AS removed, sum(n) FILTER (gone AND fails) AS redundant,
    sum(n) FILTER (failed = f) AS unique_fails, sum(n) FILTER (NOT gone AND fails AND good) AS good_lost, sum(n) FILTER (NOT gone AND fails AND toxic) AS toxic_lost
  FROM judged GROUP BY ALL
)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted"""
}
