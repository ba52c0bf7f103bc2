"""`op3_decontaminate`: places of benchmark items in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from utilscope.llm.decontaminate import Budget, find_leaks

SETTINGS = Budget(q=10, percent=8)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), SETTINGS)
