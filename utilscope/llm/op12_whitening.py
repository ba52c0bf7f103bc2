"""`op12_whitening`: all embeddings along the eight leading components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utilscope.llm.whitening import Whitening, whiten

SETTINGS = Whitening(components=8, scale=1024, offset=100_000)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`deviation` grows with the square of the rows; beyond 64 bits, as a LONG can't hold it, it is NULL."""
    whitened = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), SETTINGS)
    return whitened.withColumn("deviation", F.col("deviation").try_cast("long"))
