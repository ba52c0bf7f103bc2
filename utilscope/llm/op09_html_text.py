"""`op9_html_text`: main text of all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from utilscope.llm.html_text import extract_main_text


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract_main_text(pages, ["page_id", "url"])
