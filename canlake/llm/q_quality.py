"""Queries that judge documents: language ID and quality rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canlake.llm import language, line_rules
from canlake.llm.common import table


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_rules.judge_lines(table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~F.col("depleted")).alias("kept"), "words_left")


QUERIES = {"op5_quality_rules": op5_quality_rules}
_WORDS = r"'[^\x20\x09-\x0D]+'"
_FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 'abcdefghijklmnopqrstuvwxyz0000000000'"
ORACLES: dict = {
    "op5_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(text, {_WORDS})) AS word, generate_subscripts(regexp_extract_all(text, {_WORDS}), 1) AS i FROM d),
t AS (SELECT *, lead(word) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
c AS (SELECT *, count(*) OVER (PARTITION BY r, word, w2, w3) AS n FROM t WHERE w3 IS NOT NULL),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM c WHERE n > 1) GROUP BY r),
counts AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY r),
raw AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (SELECT r, line, list_transform(regexp_extract_all(line, {_WORDS}), lambda x: translate(x, {_FOLD})) AS words FROM raw WHERE regexp_matches(line, {_WORDS})),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup FROM lines GROUP BY r),
own AS (SELECT r, array_to_string(words, ' ') AS name, sum(len(words)) AS words FROM lines GROUP BY 1, 2),
hosts AS (SELECT source, count(*) AS docs FROM d GROUP BY source),
freq AS (SELECT d.source, name, count(*) AS n FROM own JOIN d USING (r) GROUP BY 1, 2 HAVING count(*) > {line_rules.LIMIT_DOCS}),
bad AS (SELECT f.* FROM freq f JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source WHERE f.n > {line_rules.LIMIT_SHARE} * h.docs),
gone AS (SELECT own.r, sum(own.words) AS gone FROM own JOIN d USING (r) JOIN bad b ON d.source IS NOT DISTINCT FROM b.source AND own.name = b.name GROUP BY own.r),
a AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words,
  coalesce(n_words, 0) - coalesce(gone, 0) AS words_left FROM d LEFT JOIN counts USING (r) LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN gone USING (r)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  base_failed, NOT base_failed AND words_left >= {line_rules.LEAST_SHARE} * n_words AS kept, CAST(words_left AS BIGINT) AS words_left FROM v"""
}


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from learning; one without an id is in neither part."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def language_model(docs: DataFrame) -> language.Model | None:
    return language.train(docs.where(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "text", "lang"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    told = language.identify(docs.select("doc_id", held_out().alias("held_out"), "text"), language_model(docs))
    return told.select("doc_id", "held_out", "lang_pred", "score")


QUERIES["op3_language_id"] = op3_language_id
