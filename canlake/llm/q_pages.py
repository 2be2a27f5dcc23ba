"""Queries over raw pages: the WARC fixity audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canlake.llm import warc
from canlake.llm.common import table, written

#: The replica that the query audits is damaged by rule: one page in ALTERED has a byte changed, one in LOST is gone.
ALTERED, LOST = 61, 149


def damaged(records: DataFrame) -> DataFrame:
    """A replica of the records at the same offsets: some bodies have their first byte replaced, some records are lost."""
    hit = F.col("page_id") % ALTERED == 5
    first = F.when(F.left("html", F.lit(1)) == "<", ">").otherwise("<")
    return records.where(~F.coalesce(F.col("page_id") % LOST == 7, F.lit(False))).withColumn("html", F.when(hit, F.concat(first, F.substring("html", 2, 1 << 30))).otherwise(F.col("html")))


def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = written(warc.layout(table(spark, sf_dir, "pages")), "records")
    trees = warc.grow([warc.leaves(records), warc.leaves(damaged(records))])
    return warc.audit(*trees)


QUERIES = {"op2_warc_fixity": op2_warc_fixity}
ORACLES = {
    "op2_warc_fixity": f"""
WITH p AS (SELECT page_id, url, html, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
    || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10) || 'Content-Length: '
    || CAST(strlen(coalesce(html, '')) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM (SELECT DISTINCT page_id, url, html FROM pages)),
n AS (SELECT greatest(1, CAST(ceil(sum(strlen(coalesce(html, ''))) / CAST({warc.FILE_BYTES} AS DOUBLE)) AS BIGINT)) AS files FROM pages),
f AS (SELECT page_id, url, html, CAST(strlen(record) AS BIGINT) AS length, md5(record) AS lot, CAST('0x' || left(md5(record), 8) AS BIGINT) % files AS file FROM p, n),
r AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY file ORDER BY lot, page_id NULLS FIRST, url NULLS FIRST, html NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM f)
SELECT file, CAST(place AS BIGINT) AS "offset", page_id, length, CASE WHEN page_id % {LOST} = 7 THEN 'missing' ELSE 'altered' END AS kind
FROM r WHERE page_id % {LOST} = 7 OR (page_id % {ALTERED} = 5 AND html IS NOT NULL)"""
}
