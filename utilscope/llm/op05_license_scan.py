"""`op5_license_scan`: license labels of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from utilscope.llm.license_scan import PHRASES, Scan, scan_licenses, words_of

SETTINGS = Scan()


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"), SETTINGS)


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_PHRASE_ROWS = ", ".join(f"({_list(words_of(p))}, '{label}')" for p, label in PHRASES.items())
_TEMPLATE_ROWS = ", ".join(f"('{label}', {_list(words)})" for label, words in SETTINGS.template_sets())
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[0-9a-z\x{80}-\x{10FFFF}]+'"

#: Every phrase at every word, every template against every line.
SQL = f"""
WITH texts AS (
  SELECT doc_id, row_number() OVER () AS r, {_LOWER} AS t FROM documents
), words AS (
  SELECT r, doc_id, t, regexp_extract_all(t, {_WORD}) AS w FROM texts
), phrases(p, label) AS (VALUES {_PHRASE_ROWS}
), places AS (
  SELECT r, label, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1:i + len(p)] = p)) AS start
  FROM words, phrases WHERE contains(t, p[1])
), base AS (
  SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list(DISTINCT label) AS labels
  FROM places GROUP BY r
), templates(label, tokens) AS (VALUES {_TEMPLATE_ROWS}
), lines AS (
  SELECT r, unnest(string_split(t, chr(10))) AS line FROM texts
), shares AS (
  SELECT r, label, len(list_intersect(list_distinct(regexp_extract_all(line, {_WORD})), tokens)) AS held, len(tokens) AS size
  FROM lines, templates
), found AS (
  SELECT r, list(DISTINCT label) AS labels, max(held / size) AS share
  FROM shares WHERE 100 * held >= {SETTINGS.percent} * size GROUP BY r
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
FROM words w LEFT JOIN base USING (r) LEFT JOIN found USING (r)
"""
