"""Strict CSV extracts, partitioned Parquet facts, JSON records and CSV reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from utilscope.functions.numbers import finite
from utilscope.schema import RAW_SCHEMA
from utilscope.workspace import spread

CSV_OPTIONS = {
    "header": True,
    "enforceSchema": False,  # compare each file's header with the schema
    "mode": "FAILFAST",  # a row with too few or too many fields is an error
    "columnPruning": False,  # else a query of few columns never counts the fields
    "quote": '"',
    "escape": '"',
}


def read_strict_csv(
    spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA
) -> DataFrame:
    """All-text scan; a wrong header or field count fails. Blank fields come back NULL.

    `year=YYYY` directories below `path` become the `year` column.  The header check minds
    case only with spark.sql.caseSensitive=true.
    """
    return spark.read.options(**CSV_OPTIONS).schema(schema).csv(path)


def stamp_year(df: DataFrame, pattern: str = r"(\d{4})[^/\d]*\.csv[^/]*$") -> DataFrame:
    """`year` from the name of the file each row came from, for flat landing folders."""
    found = F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)
    return df.withColumn("year", found.try_cast("int"))


def write_raw_csv(raw: DataFrame, path: str, mode: str = "overwrite", compression: str = "gzip") -> None:
    """Raw rows as CSV with one directory per year, white space kept as it is.

    Every task writes files of its own, so that compressed ones, which can't be split, stay small.
    """
    with spread(raw.sparkSession):
        (
            raw.write.mode(mode).partitionBy("year").option("header", True).option("compression", compression)
            .option("zlib.compress.level", "BEST_SPEED")
            .option("escape", '"').option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False).csv(path)
        )


def write_fact(fact: DataFrame, path: str, balance: bool = False) -> None:
    """Typed fact as zstd Parquet, one directory per year, many files each.

    `balance` adds a shuffle that evens out file sizes: worth it when the input arrives in
    many small partitions, since AQE splits large years and merges small ones.
    """
    if balance:
        fact = fact.hint("rebalance", F.col("year"))
    with spread(fact.sparkSession, small_tasks=not balance):
        fact.write.mode("overwrite").partitionBy("year").option("compression", "zstd").parquet(path)


def read_fact(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Fact by year directory; a schema given spares the footer scan."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def write_json_records(df: DataFrame, path: str) -> None:
    """One JSON object per row; NaN and infinities become null, nulls are written."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    clean = df.withColumns({c: finite(F.col(c)) for c in doubles}) if doubles else df
    clean.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_json_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_csv_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Bytes and files by year directory below `path`, from the listing alone."""
    listed = spark.read.format("binaryFile").load(path).select("year", "length")
    return listed.groupBy("year").agg(
        F.sum("length").alias("source_bytes_scanned"), F.count(F.lit(1)).alias("files")
    )
