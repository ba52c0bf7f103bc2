"""Profiles of raw text extracts (columns under their raw names, plus `year`)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utilscope.functions.numbers import ratio, to_double
from utilscope.schema import RAW_COLUMNS

PROFILED_NUMBERS = ["Tot_Clms", "Tot_30day_Fills", "Tot_Day_Suply", "Tot_Drug_Cst"]
RAW_KEY = ["Prscrbr_NPI", "Brnd_Name", "Gnrc_Name"]


def _is_blank(name: str):
    return F.col(name).isNull() | (F.col(name) == "")


def profile_rows(raw: DataFrame) -> DataFrame:
    """Rows and source columns of each year."""
    columns = len([c for c in raw.columns if c != "year"])
    return raw.groupBy("year").agg(
        F.count(F.lit(1)).alias("row_count"), F.lit(columns).alias("column_count")
    )


def profile_blank_counts(raw: DataFrame, columns: list[str] = RAW_COLUMNS) -> DataFrame:
    """Blank or NULL values of every column, one row per year and column, in one pass."""
    counts = raw.groupBy("year").agg(*[F.count_if(_is_blank(c)).alias(c) for c in columns])
    return counts.unpivot("year", list(columns), "column_name", "blank_count")


def profile_duplicate_keys(df: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """Repeated occurrences of a key: rows beyond the first of each key."""
    per_key = df.groupBy(*by, *key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy(*by).agg(
        F.sum("n").alias("row_count"),
        F.count(F.lit(1)).alias("distinct_keys"),
        F.sum(F.col("n") - 1).alias("duplicate_keys"),
    )


def profile_label_pairs(raw: DataFrame, brand: str, generic: str) -> DataFrame:
    """Distinct brand and generic pairs by year, NULLs included."""
    return (
        raw.select("year", brand, generic).distinct()
        .groupBy("year").agg(F.count(F.lit(1)).alias("label_pairs"))
    )


def profile_numeric_range(raw: DataFrame, columns: list[str] = PROFILED_NUMBERS) -> DataFrame:
    """Smallest and largest number of each column, text that is no number left out."""
    measured = raw.select("year", *[to_double(F.col(c)).alias(c) for c in columns])
    ranges = measured.groupBy("year").agg(*[
        F.struct(F.min(c).alias("min_value"), F.max(c).alias("max_value")).alias(c)
        for c in columns
    ])
    return ranges.unpivot("year", list(columns), "column_name", "range").select(
        "year", "column_name", "range.*"
    )


def profile_missing_rate(raw: DataFrame, column: str = "Tot_Benes") -> DataFrame:
    return (
        raw.groupBy("year").agg(
            F.count(F.lit(1)).alias("row_count"), F.count_if(_is_blank(column)).alias("blank_count")
        )
        .withColumn("blank_share", ratio(F.col("blank_count"), F.col("row_count")))
    )


def scope_counts(audit: DataFrame) -> DataFrame:
    """Audited label-years per decision."""
    return audit.groupBy("scope_status").agg(F.count(F.lit(1)).alias("labels"))
