"""Queries that find repeated text: near-duplicate documents, repeated strings and word runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canlake.llm import jaccard, prefix_free, recompression
from canlake.llm.common import table


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op10_ngram_jaccard_join": op10_ngram_jaccard_join}
_WORDS = r"'[^\x20\x09-\x0D]+'"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
ORACLES: dict = {
    "op6_suffix_array_dedup": f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, i, h[2 * i + 1 : 2 * i + 2] AS byte, CASE WHEN 2 * i + 2 * {prefix_free.WINDOW} <= length(h) THEN md5(h[2 * i + 1 : 2 * i + 2 * {prefix_free.WINDOW}]) END AS w FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS i FROM d)),
f AS (SELECT doc_id, i, byte, CASE WHEN w IS NOT NULL AND row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1 THEN 1 ELSE 0 END AS later FROM b),
g AS (SELECT doc_id, i, byte, max(later) OVER (PARTITION BY doc_id ORDER BY i ROWS {prefix_free.WINDOW - 1} PRECEDING) AS gone FROM f),
s AS (SELECT *, CASE WHEN gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 THEN 1 ELSE 0 END AS head FROM g),
a AS (SELECT doc_id, count(*) AS n, sum(gone) AS n_removed, sum(head) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (gone = 0) AS kept FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)""",
    "op7_substring_dedup": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS words FROM documents),
b AS (SELECT doc_id, i, words[i] AS word, CASE WHEN i + {recompression.WINDOW - 1} <= len(words) THEN md5(array_to_string(words[i : i + {recompression.WINDOW - 1}], ' ')) END AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM d)),
f AS (SELECT doc_id, i, word, CASE WHEN w IS NOT NULL AND row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1 THEN 1 ELSE 0 END AS later FROM b),
g AS (SELECT doc_id, i, word, max(later) OVER (PARTITION BY doc_id ORDER BY i ROWS {recompression.WINDOW - 1} PRECEDING) AS gone FROM f),
a AS (SELECT doc_id, count(*) AS n, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)""",
    "op10_ngram_jaccard_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), {_WORDS}) AS words FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, md5(CASE WHEN len(words) < 4 THEN array_to_string(words, ' ') ELSE array_to_string(words[i : i + 3], ' ') END) AS x FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i FROM d WHERE len(words) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, m.b) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) m ON m.a = d.doc_id""",
}


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = prefix_free.remove_repeated_strings(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


QUERIES["op6_suffix_array_dedup"] = op6_suffix_array_dedup


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = recompression.remove_repeated_words(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", "kept_sha256")


QUERIES["op7_substring_dedup"] = op7_substring_dedup
