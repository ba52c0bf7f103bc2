"""Written tables that several reports share, kept in the cluster's shared folder.

A derived table that more than one job reads is written once and read back, which cuts
its lineage: a lost executor costs a re-read, not a re-run of the whole upstream plan.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_local_root: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if not _local_root:
        _local_root.append(tempfile.mkdtemp(prefix="utilscope-"))
    return _local_root[0]


def literal_rows(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A handful of configuration rows as a table, without a Python worker."""
    structs = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, schema.fields)])
        for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))


def stamp(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Bytes, files and modification time of a file or folder, without reading it."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(context._jsc.hadoopConfiguration())
    summary = files.getContentSummary(target)
    changed = files.getFileStatus(target).getModificationTime()
    return summary.getLength(), summary.getFileCount(), changed


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder through Spark's file systems."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


#: A folder per year is written without sorting the rows by year first, up to this many folders in a task.
OPEN_WRITERS = {"spark.sql.maxConcurrentOutputFileWriters": "64"}
#: Rows that are narrow in a file or shuffle get wide behind it, so tasks are cut smaller than Spark's defaults.
SMALL_TASKS = {
    "spark.sql.files.maxPartitionBytes": "32m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000",
}


@contextmanager
def spread(spark: SparkSession, small_tasks: bool = True) -> Iterator[None]:
    """Settings under which jobs that write large tables sort and hash in memory, without spilling.

    What the session sets itself is left alone.
    """
    wanted = OPEN_WRITERS | (SMALL_TASKS if small_tasks else {})
    changed = {key: value for key, value in wanted.items() if spark.conf.get(key, None) is None}
    for key, value in changed.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key in changed:
            spark.conf.unset(key)


class Workspace:
    """Named tables under one folder of their own; each is built at most once."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = f"{root or shared_root(spark)}/utilscope/{uuid.uuid4().hex}"
        self._tables: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def fresh_path(self, name: str) -> str:
        """A path no earlier call has returned."""
        return f"{self.root}/{name}-{uuid.uuid4().hex}"

    def table(
        self, name: str, build: Callable[[], DataFrame], partition_by: list[str] | None = None
    ) -> DataFrame:
        """The named table, written from `build()` on first use."""
        if name not in self._tables:
            built = build()
            with spread(self.spark):
                self._tables[name] = self.write(self.path(name), built, partition_by)
        return self._tables[name]

    def write(
        self, path: str, df: DataFrame, partition_by: list[str] | None = None
    ) -> DataFrame:
        writer = df.write.mode("overwrite").option("compression", "zstd")
        writer.partitionBy(*(partition_by or [])).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self) -> None:
        """Delete every table of the workspace; frames that read them are then void."""
        remove(self.spark, self.root)
        self._tables.clear()
