"""`op2_language_id`: language of all pages and all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utilscope.llm.language_id import document_evidence, identify_languages, page_evidence


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every page (`page_id`) and every document (`doc_id`), the other id NULL.

    Pages declare a language in their markup and have an address; documents declare `lang`, and
    their source stands for the host. Each table is evidence for itself alone.
    """
    absent = F.lit(None).cast("long")
    verdict = ["language", "probability", "text_language", "rejected"]
    pages = identify_languages(page_evidence(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    docs = identify_languages(document_evidence(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return pages.select(F.col("key").alias("page_id"), absent.alias("doc_id"), *verdict).unionAll(
        docs.select(absent.alias("page_id"), F.col("key").alias("doc_id"), *verdict)
    )
