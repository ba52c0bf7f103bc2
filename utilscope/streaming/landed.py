"""A typed fact that follows its landing folder, also when files are replaced or withdrawn.

A ledger holds path, length and modification time of every landed file. Its difference to the
folder tells which files are new, changed or gone. Rows of the fact stand in a partition of
their file, so a changed file's rows are replaced by a dynamic partition overwrite and a
withdrawn file's partition is dropped; files that stayed are not read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from utilscope.operators.classify import candidate_filter, included
from utilscope.operators.clean import standardize
from utilscope.rules import ScopeRules
from utilscope.sources.files import CSV_OPTIONS
from utilscope.streaming.ingest import LANDING_SCHEMA, typed_fact
from utilscope.workspace import spread

LEDGER = "path string, length long, modified timestamp, file string"


def _file_of(path: Column) -> Column:
    """A short name for a file, the same wherever Spark reads it."""
    return F.substring(F.sha2(path, 256), 1, 24).alias("file")


def landed_files(spark: SparkSession, landing: str) -> DataFrame:
    """`path`, `length`, `modified` and `file` of every file; no content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv*").load(landing)
    return found.select("path", "length", F.col("modificationTime").alias("modified"), _file_of(F.col("_metadata.file_path")))


class LandedFact:
    """The fact of one landing folder below `root`."""

    def __init__(self, spark: SparkSession, landing: str, root: str, rules: ScopeRules):
        self.spark, self.landing, self.rules = spark, landing, rules
        self.sink, self._ledgers = f"{root}/fact", f"{root}/ledger"
        context = spark.sparkContext
        self._path = context._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(root).getFileSystem(context._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        """Finished ledgers: a draft gets its number once the fact has followed it."""
        folder = self._path(self._ledgers)
        if not self._files.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._files.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def ledger(self) -> DataFrame:
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(f"{self._ledgers}/{versions[-1]}")

    def changes(self, listed: DataFrame) -> DataFrame:
        """Listed files whose rows in the fact are others: `path`, `file`, `change`, `year` of the directory."""
        now, then = listed.alias("now"), self.ledger().alias("then")
        both = now.join(then, F.col("now.path") == F.col("then.path"), "full")
        same = (F.col("now.length") == F.col("then.length")) & (F.col("now.modified") == F.col("then.modified"))
        change = F.when(F.col("then.path").isNull(), "new").when(F.col("now.path").isNull(), "gone").when(~same, "changed")
        path = F.coalesce("now.path", "then.path")
        return both.select(
            path.alias("path"), F.coalesce("now.file", "then.file").alias("file"), change.alias("change"),
            F.regexp_extract(path, r"/year=(\d+)/", 1).cast("int").alias("year"),
        ).where("change IS NOT NULL")

    def follow(self) -> list[tuple[str, str]]:
        """Bring the fact up to the folder; the paths that differed, each with what happened to it.

        The listing becomes the ledger only after the fact is written. A run that dies is repeated from
        the old ledger: it replaces the partitions of the same files.
        """
        draft = f"{self._ledgers}/draft"
        landed_files(self.spark, self.landing).write.mode("overwrite").parquet(draft)
        changed = self.changes(self.spark.read.schema(LEDGER).parquet(draft)).collect()
        for c in changed:
            if c.change != "new":  # a changed file that keeps no row must lose its old ones, too
                self._files.delete(self._path(f"{self.sink}/year={c.year}/file={c.file}"), True)
        read = [c.path for c in changed if c.change != "gone"]
        if read:
            self._replace(self.spark.read.options(**CSV_OPTIONS, basePath=self.landing).schema(LANDING_SCHEMA).csv(read))
        if changed:
            following = (self._versions() or [0])[-1] + 1
            self._files.rename(self._path(draft), self._path(f"{self._ledgers}/{following}"))
        return sorted((c.path, c.change) for c in changed)

    def _replace(self, raw: DataFrame) -> None:
        """Write the included rows of some files, each file to its own partition."""
        named = raw.select("*", _file_of(F.col("_metadata.file_path")))
        wanted = candidate_filter(named, self.rules, "Brnd_Name", "Gnrc_Name")
        fact = included(standardize(wanted, self.rules, ("file",)))
        writer = fact.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
        with spread(self.spark):
            writer.partitionBy("year", "file").parquet(self.sink)

    def fact(self) -> DataFrame:
        schema = typed_fact(self.spark.createDataFrame([], LANDING_SCHEMA), self.rules).schema
        return self.spark.read.schema(schema).parquet(self.sink).select(*schema.names)
