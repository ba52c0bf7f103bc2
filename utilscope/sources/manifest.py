"""Extraction: keep the rows in scope and record what the scan saw, file by file.

One pass over the raw text writes the rows in scope, and of every other row just the file that it
came from, which Parquet folds to next to nothing. All counters are then read from what was
written and committed: a task that ran twice or died has left nothing in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from utilscope.functions.text import contains_any, normalize_text
from utilscope.operators.classify import in_scope
from utilscope.rules import ScopeRules
from utilscope.schema import RAW_COLUMNS
from utilscope.workspace import literal_rows, spread

BRAND, GENERIC = "Brnd_Name", "Gnrc_Name"
COUNTS = ["source_rows_scanned", "candidate_rows", "excluded_rows", "fingerprint"]
COUNT_SCHEMA = T.StructType([
    T.StructField("year", T.IntegerType()),
    *[T.StructField(c, T.LongType()) for c in COUNTS[:-1]],
    T.StructField("fingerprint", T.StringType()),
])


def _flagged(raw: DataFrame, rules: ScopeRules) -> DataFrame:
    """Raw rows with `_kept` (in scope) and `_device` (in scope, but an excluded pattern)."""
    kept = F.coalesce(in_scope(rules, BRAND, GENERIC), F.lit(False))
    device = contains_any(normalize_text(F.col(GENERIC)), list(rules.excluded_patterns))
    return raw.withColumns({"_kept": kept, "_device": kept & device})


def _row_hash() -> Column:
    """60 bits of the MD5 of a raw row.

    Summed over the kept rows they make a fingerprint that does not depend on the rows' order or
    on how they are split over files, so many tasks can take it together, and files add up to years.
    """
    # Field lengths make the text of a row unambiguous.
    fields = [F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)) for c in RAW_COLUMNS]
    digest = F.md5(F.concat_ws("|", *[F.coalesce(f, F.lit("-")) for f in fields]))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _counters(kept: str, device: str, row_hash: Column) -> list[Column]:
    """The four counters, in the order of `COUNTS`."""
    fingerprint = F.sum(F.when(F.col(kept), row_hash).cast("decimal(38,0)"))
    counters = [F.count(F.lit(1)), F.count_if(kept), F.count_if(device), fingerprint.cast("string")]
    return [c.alias(name) for c, name in zip(counters, COUNTS)]


def extract_counts(raw: DataFrame, rules: ScopeRules) -> DataFrame:
    """Rows scanned, kept, then excluded as devices, with the fingerprint, by year."""
    return _flagged(raw, rules).groupBy("year").agg(*_counters("_kept", "_device", _row_hash()))


def _rows(raw: DataFrame, path: str) -> DataFrame:
    """What `extract` wrote for the rows of `raw`: `_kept` false marks a row out of scope."""
    fields = [T.StructField(c, T.StringType()) for c in (*RAW_COLUMNS, "_file")]
    marks = [T.StructField("_bytes", T.LongType()), T.StructField("_device", T.BooleanType()), T.StructField("_hash", T.LongType())]
    folders = [T.StructField("_kept", T.BooleanType()), raw.schema["year"]]
    return raw.sparkSession.read.schema(T.StructType([*fields, *marks, *folders])).parquet(f"{path}/rows")


def extract(raw: DataFrame, rules: ScopeRules, years: list[int], path: str) -> DataFrame:
    """Write the rows in scope as Parquet and return `extract_counts`, in one pass over `raw`.

    `raw` is a scan of files. The counts are the sums of `file_counts`; a year without files has none.
    """
    source = {"_file": F.col("_metadata.file_path"), "_bytes": F.col("_metadata.file_size")}
    marked = _flagged(raw.withColumns(source), rules)
    in_scope_only = lambda c: F.when(F.col("_kept"), c)
    with spread(raw.sparkSession):
        (
            marked.select(
                *[in_scope_only(F.col(c)).alias(c) for c in RAW_COLUMNS], "_file", "_bytes",
                in_scope_only(F.col("_device")).alias("_device"), in_scope_only(_row_hash()).alias("_hash"), "_kept", "year",
            )
            .write.mode("overwrite").partitionBy("_kept", "year").option("compression", "zstd").parquet(f"{path}/rows")
        )
        by_file = _rows(raw, path).groupBy(F.col("_file").alias("file"), "year").agg(
            F.max("_bytes").alias("bytes"), *_counters("_kept", "_device", F.col("_hash"))
        )
        by_file.write.mode("overwrite").parquet(f"{path}/files")
    wanted = literal_rows(raw.sparkSession, [(y,) for y in years], T.StructType([COUNT_SCHEMA["year"]]))
    totals = _scanned(raw.sparkSession, path).groupBy("year").agg(
        *[F.sum(c).alias(c) for c in COUNTS[:-1]],
        F.sum(F.col("fingerprint").cast("decimal(38,0)")).cast("string").alias("fingerprint"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return wanted.join(totals, "year", "left").select("year", *[zero(c) for c in COUNTS[:-1]], "fingerprint")


def _scanned(spark: SparkSession, path: str) -> DataFrame:
    source = [T.StructField("file", T.StringType()), T.StructField("bytes", T.LongType())]
    schema = T.StructType([*source, *COUNT_SCHEMA.fields])
    return spark.read.schema(schema).parquet(f"{path}/files")


def file_counts(spark: SparkSession, path: str, landing: str) -> DataFrame:
    """The counters of each file of `landing` that `extract` scanned into `path`, with its `bytes`.

    `file` is the path below `landing`. A file without rows (a header alone, or nothing) has zeros.
    The counters are written below `path`, so they can be held against a later extraction.
    """
    listed = spark.read.format("binaryFile").load(landing).select(
        F.col("_metadata.file_path").alias("file"), F.col("year").cast("int").alias("_year"), F.col("length").alias("_listed"),
    )
    found = listed.join(_scanned(spark, path), "file", "left").select(
        F.regexp_extract("file", r"(year=[^/]*/.*)$", 1).alias("file"), F.col("_year").alias("year"),
        F.coalesce("bytes", "_listed").alias("bytes"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS[:-1]], "fingerprint",
    )
    found.write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.schema(found.schema).parquet(f"{path}/manifest")


def differing_files(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Files in which two `file_counts` differ: `file`, `year`, `difference`, and rows and bytes of both.

    `difference` is `missing` or `extra` (in `found`), `short` or `long` (fewer or more rows), else
    `changed`: as many rows, but other bytes, counters or content.
    """
    fields = ["bytes", *COUNTS]
    side = lambda df, name: df.select("file", "year", F.struct(*fields).alias(name))
    both = side(expected, "expected").join(side(found, "found"), ["file", "year"], "full")
    rows, rows_expected = F.col("found.source_rows_scanned"), F.col("expected.source_rows_scanned")
    difference = (
        F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "extra")
        .when(rows < rows_expected, "short").when(rows > rows_expected, "long").otherwise("changed")
    )
    return both.filter(~F.col("expected").eqNullSafe(F.col("found"))).select(
        "file", "year", difference.alias("difference"),
        rows_expected.alias("rows_expected"), rows.alias("rows_found"),
        F.col("expected.bytes").alias("bytes_expected"), F.col("found.bytes").alias("bytes_found"),
    )


def read_extract(raw: DataFrame, path: str) -> DataFrame:
    """The rows in scope that `extract` wrote from `raw`; those out of scope stand in other folders."""
    return _rows(raw, path).filter("_kept").select(*RAW_COLUMNS, "year")


def manifest(counts: DataFrame, rules: ScopeRules) -> DataFrame:
    """Counts by year with the column count and the terms and brands that were applied."""
    return counts.select(
        "year", "source_rows_scanned", F.col("candidate_rows").alias("filtered_row_count"),
        F.lit(len(RAW_COLUMNS)).alias("column_count"),
        F.lit("|".join(rules.distinct_terms())).alias("filter_terms"),
        F.lit("|".join(sorted(rules.excluded_brands))).alias("excluded_brands"),
        "fingerprint",
    )
