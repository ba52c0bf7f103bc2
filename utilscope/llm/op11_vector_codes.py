"""`op11_vector_codes`: codes of eight parts and sixteen entries each for all embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from utilscope.llm.vector_codes import Coding, encode_vectors

SETTINGS = Coding(parts=8, entries=16, rounds=6, scale=4096)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), SETTINGS)


def _assigned(n: int) -> str:
    """Every part with its nearest entry of codebook `n`: distance * 256 + entry."""
    return f"""assigned{n} AS MATERIALIZED (
  SELECT row, p, any_value(x) AS x, min(256 * list_sum(list_transform(range(1, len(x) + 1),
    lambda i: (x[i] - c[i]) * (x[i] - c[i]))) + e) AS nearest
  FROM parts JOIN book{n} USING (p) GROUP BY row, p
)"""


def _round(n: int) -> str:
    return f"""{_assigned(n)}, sums{n} AS (
  SELECT p, nearest % 256 AS e, i, sum(x[i])::BIGINT AS s, count(*) AS n
  FROM assigned{n}, range(1, (SELECT max(len(x)) FROM parts) + 1) t(i) GROUP BY ALL
), means{n} AS (
  SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS mean FROM sums{n} GROUP BY p, e
), book{n + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(mean, c) AS c FROM book{n} LEFT JOIN means{n} USING (p, e)
)"""


#: Every part against every entry, without cells.
SQL = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), parts AS MATERIALIZED (
  SELECT row, p, v[p * (len(v) // 8) + 1 : (p + 1) * (len(v) // 8)] AS x FROM kept, range(8) t(p)
), book0 AS MATERIALIZED (
  SELECT p, row - 1 AS e, x AS c FROM parts WHERE row <= 16
), {", ".join(_round(n) for n in range(SETTINGS.rounds))}, {_assigned(SETTINGS.rounds)}, coded AS (
  SELECT row, string_agg(printf('%02x', (nearest % 256)::INTEGER), '' ORDER BY p) AS code,
    sum(nearest // 256)::BIGINT AS error
  FROM assigned{SETTINGS.rounds} GROUP BY row
), digest AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{SETTINGS.rounds}
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (row), digest
"""
