"""`op10_embedding_dedup`: links and classes of all embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from utilscope.llm.embedding_dedup import Hashing, embedding_classes

SETTINGS = Hashing(least_cosine=0.93)


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_classes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), SETTINGS)


#: All pairs of equal label. The hashing misses none of them on the test tables.
SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93
), reach AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings
  UNION
  SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
), smallest AS (
  SELECT x, min(y) AS component_id FROM reach GROUP BY x
), counts AS (
  SELECT x, count(*) AS n FROM links GROUP BY x
)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN smallest s ON s.x = vec_id LEFT JOIN counts c ON c.x = vec_id
"""
