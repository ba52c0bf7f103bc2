"""`op13_nearest_vectors`: the ten nearest embeddings of every hundredth one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from utilscope.llm.multi_index import Search, nearest_vectors

SETTINGS = Search(neighbours=10)


def op13_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda id: id % 100 == 0, SETTINGS)


#: All pairs. The walks miss no neighbour on the tables that the twin is run on.
SQL = """
WITH usable AS (
  SELECT row_number() OVER () AS row, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), near AS (
  SELECT a.row, a.vec_id AS query_id, b.vec_id, sqrt(list_reduce(
    list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])), lambda s, x: s + x)) AS score
  FROM usable a JOIN usable b ON a.row <> b.row AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY row ORDER BY score, vec_id) AS rank FROM near
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
