"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from utilscope.llm import (
    op01_ngram_join, op02_language_id, op03_decontaminate, op04_chat_format, op05_license_scan,
    op06_warc_fixity, op07_sentencepiece, op08_sharding, op09_html_text, op10_embedding_dedup, op11_vector_codes, op12_whitening,
    op13_nearest_vectors,
)
from utilscope.llm.shipping import ship

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES = (
    op01_ngram_join.op1_ngram_join,
    op02_language_id.op2_language_id,
    op03_decontaminate.op3_decontaminate,
    op04_chat_format.op4_chat_format,
    op05_license_scan.op5_license_scan,
    op06_warc_fixity.op6_warc_fixity,
    op07_sentencepiece.op7_sentencepiece,
    op08_sharding.op8_sharding,
    op09_html_text.op9_html_text,
    op10_embedding_dedup.op10_embedding_dedup,
    op11_vector_codes.op11_vector_codes,
    op12_whitening.op12_whitening,
    op13_nearest_vectors.op13_nearest_vectors,
)
_SQL = {
    "op1_ngram_join": op01_ngram_join.SQL,
    "op4_chat_format": op04_chat_format.SQL,
    "op5_license_scan": op05_license_scan.SQL,
    "op6_warc_fixity": op06_warc_fixity.SQL,
    "op10_embedding_dedup": op10_embedding_dedup.SQL,
    "op11_vector_codes": op11_vector_codes.SQL,
    "op13_nearest_vectors": op13_nearest_vectors.SQL,
}


def _shipped(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {query.__name__: _shipped(query) for query in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
