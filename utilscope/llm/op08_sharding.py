"""`op8_sharding`: stable shards 0 to 15 of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from utilscope.llm.sharding import shard_rows

SHARDS = 16


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"), SHARDS)
