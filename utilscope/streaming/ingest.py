"""Resumable ingest: landing folder -> row-local transform -> Parquet, exactly once.

A rerun with the same checkpoint takes only files it has not seen.  The batch functions
(scope filter, cleaning, classification) are row-local, so they apply to the stream as
they are.  Every row is stamped with the ingest run that took it.  `upkeep` ingests the
typed fact and keeps yearly totals up with it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from utilscope.operators.classify import candidate_filter, in_scope, included
from utilscope.operators.clean import standardize
from utilscope.rules import ScopeRules
from utilscope.schema import RAW_COLUMNS, RAW_SCHEMA
from utilscope.sources.files import CSV_OPTIONS
from utilscope.workspace import spread

LANDING_SCHEMA = T.StructType([*RAW_SCHEMA.fields, T.StructField("year", T.IntegerType())])


PROGRESS_KEPT = "spark.sql.streaming.numRecentProgressUpdates"


@dataclass(frozen=True)
class IngestPaths:
    landing: str
    sink: str
    checkpoint: str
    partials: str


def raw_stream(spark: SparkSession, landing: str, max_bytes_per_batch: int = 512 * 2**30) -> DataFrame:
    """Raw CSV rows as they land, `year` from the directory.

    The byte limit bounds one micro-batch; a run still takes everything that is there.
    """
    return (
        spark.readStream.options(**CSV_OPTIONS).schema(LANDING_SCHEMA)
        .option("maxBytesPerTrigger", max_bytes_per_batch).csv(landing)
    )


def raw_candidates(raw: DataFrame, rules: ScopeRules) -> DataFrame:
    """Raw rows in scope."""
    return candidate_filter(raw, rules, "Brnd_Name", "Gnrc_Name").select(*RAW_COLUMNS, "year")


def typed_fact(raw: DataFrame, rules: ScopeRules) -> DataFrame:
    """Included fact rows."""
    return included(standardize(raw_candidates(raw, rules), rules))


def ingest_available(
    spark: SparkSession, paths: IngestPaths, rules: ScopeRules,
    transform: Callable[[DataFrame, ScopeRules], DataFrame], run: int,
) -> list[dict]:
    """Take every file that has landed since the last run, then stop.

    After a crash, call again with the same `run`: finished micro-batches are not repeated.
    Returns the rows scanned and kept by each micro-batch.
    """
    in_scope_rows = F.count_if(in_scope(rules, "Brnd_Name", "Gnrc_Name"))
    raw = raw_stream(spark, paths.landing).observe(
        "extract", F.count(F.lit(1)).alias("scanned"), in_scope_rows.alias("kept")
    )
    return with_all_progress(spark, (
        transform(raw, rules).withColumn("ingest_run", F.lit(run))
        .writeStream.format("parquet").option("path", paths.sink)
        .option("checkpointLocation", paths.checkpoint).option("compression", "zstd")
        .partitionBy("ingest_run", "year").trigger(availableNow=True)
    ))


def with_all_progress(spark: SparkSession, writer: DataStreamWriter) -> list[dict]:
    """Run a stream to its end; `batch` and the observed `extract` counts of each micro-batch."""
    kept_before = spark.conf.get(PROGRESS_KEPT)
    spark.conf.set(PROGRESS_KEPT, str(2**31 - 1))  # one entry per micro-batch, none dropped
    try:
        with spread(spark):  # the stream starts with a copy of the session's settings
            query = writer.start()
            query.awaitTermination()
    finally:
        spark.conf.set(PROGRESS_KEPT, kept_before)
    return [
        {"batch": p.batchId, **p.observedMetrics["extract"].asDict()}
        for p in query.recentProgress
        if "extract" in p.observedMetrics
    ]
