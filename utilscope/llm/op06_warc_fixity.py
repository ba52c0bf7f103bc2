"""`op6_warc_fixity`: a fixity drill over all pages.

The archive of `pages` is held against a replica in which records are damaged by rules on
page_id; the audit must name exactly those records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utilscope.llm.warc import FILE_RECORDS, audit, leaves, records, tree

#: Pages damaged in the replica: page_id modulo DAMAGE is CHANGED, CUT or LOST.
DAMAGE, CHANGED, CUT, LOST = 97, 5, 17, 29


def op6_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`page_id`, `url`, `file`, `place`, `start`, `length`, `kind` of every damaged record."""
    ours = records(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    rule = F.pmod(F.col("id"), F.lit(DAMAGE))
    damaged = F.when(rule == CHANGED, F.concat(F.lit("warc/1.1"), F.substring("record", 9, 1 << 30))).when(
        rule == CUT, F.expr("substring(record, 1, length(record) div 2)")
    ).otherwise(F.col("record"))
    expected = leaves(ours)
    replica = leaves(ours.withColumn("record", damaged)).where(F.coalesce(rule != LOST, F.lit(True)))
    wrong = audit(tree(expected), tree(replica))
    node = F.col("file") * FILE_RECORDS + F.col("place")
    return wrong.join(expected.withColumn("node", node), "node").select(
        F.col("id").alias("page_id"), "url", "file", "place", "start", "length", "kind"
    )


SQL = rf"""
WITH texts AS (
  SELECT page_id, coalesce(url, '') AS u, coalesce(html, '') AS h, md5(coalesce(url, '') || chr(10) || coalesce(html, '')) AS m FROM pages
), recs AS (
  SELECT page_id, u, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || u
    || chr(13) || chr(10) || 'WARC-Record-ID: <urn:uuid:' || m[1:8] || '-' || m[9:12] || '-' || m[13:16] || '-' || m[17:20] || '-' || m[21:32]
    || '>' || chr(13) || chr(10) || 'WARC-Date: 2000-01-01T00:00:00Z' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
    || 'Content-Length: ' || strlen(h) || chr(13) || chr(10) || chr(13) || chr(10) || h AS r
  FROM texts
), placed AS (
  SELECT page_id, u, strlen(r) + 4 AS length, row_number() OVER (ORDER BY page_id NULLS FIRST, u, sha256(r)) - 1 AS n FROM recs
), offsets AS (
  SELECT *, n // {FILE_RECORDS} AS file, n % {FILE_RECORDS} AS place,
    coalesce(sum(length) OVER (PARTITION BY n // {FILE_RECORDS} ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM placed
)
SELECT page_id, u AS url, CAST(file AS BIGINT) AS file, CAST(place AS INTEGER) AS place, CAST(start AS BIGINT) AS start,
  CAST(length AS BIGINT) AS length, CASE WHEN page_id % {DAMAGE} = {LOST} THEN 'missing' ELSE 'changed' END AS kind
FROM offsets WHERE page_id % {DAMAGE} IN ({CHANGED}, {CUT}, {LOST})
"""
