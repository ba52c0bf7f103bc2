"""Readers and writers: strict CSV, partitioned Parquet, JSON records, rule files."""
