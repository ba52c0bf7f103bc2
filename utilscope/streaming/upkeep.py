"""Typed fact and yearly totals kept up by one stream, batch by batch.

A micro-batch is scanned once: its fact rows are written below its own folder, and its partial
totals come from those rows in one pass over the columns they need. A ledger names the live partials. It
is replaced as a whole after everything it names is written, so a batch that dies half-way
leaves only folders that no ledger names, and its repetition overwrites them.

Partials are folded like the digits of a counter: two of one tier become one of the next, so n
batches leave about log2(n) partials, and a row is rewritten as often. The partial of the last
batch in the ledger is never folded, since the stream may deliver that batch again, and then
it replaces its own.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utilscope.functions.numbers import sum_of
from utilscope.operators.aggregates import MEASURES, measure_sums, selected_fills, selected_share, unit_costs
from utilscope.operators.classify import in_scope
from utilscope.operators.prescribers import SKETCH_LOG_BUCKETS
from utilscope.rules import ScopeRules
from utilscope.streaming.ingest import LANDING_SCHEMA, IngestPaths, raw_stream, typed_fact, with_all_progress

PRODUCT_KEY = ["brand_name", "generic_name"]


@dataclass(frozen=True)
class Partial:
    """Totals of the batches `first` to `last`, in tier `tier`, below the partials' folder."""

    first: int
    last: int
    tier: int

    @property
    def name(self) -> str:
        return f"tier-{self.tier}/batches-{self.first}-{self.last}"


class Ledger:
    """The live partials, oldest first, as one small file that is replaced by a rename."""

    def __init__(self, spark: SparkSession, root: str):
        context = spark.sparkContext
        self._path = context._jvm.org.apache.hadoop.fs.Path
        self._root, self._conf = f"{root}/ledger", context._jsc.hadoopConfiguration()
        self._files = self._path(self._root).getFileSystem(self._conf)
        self._jvm = context._jvm

    def _versions(self) -> list[int]:
        folder = self._path(self._root)
        if not self._files.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._files.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != "_")

    def live(self) -> list[Partial]:
        versions = self._versions()
        if not versions:
            return []
        stream = self._files.open(self._path(f"{self._root}/{versions[-1]:012d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Partial(**json.loads(line)) for line in text.splitlines()]

    def publish(self, partials: list[Partial]) -> None:
        """A new version; the one before is kept for readers that have just opened it."""
        versions = self._versions()
        following = (versions[-1] if versions else 0) + 1
        draft, final = (self._path(f"{self._root}/{p}{following:012d}.json") for p in ("_", ""))
        stream = self._files.create(draft, True)
        stream.write(bytearray("\n".join(json.dumps(asdict(p)) for p in partials).encode()))
        stream.close()
        if not self._files.rename(draft, final):
            raise OSError(f"the ledger could not be renamed to {final}")
        for version in versions[:-1]:
            self._files.delete(self._path(f"{self._root}/{version:012d}.json"), False)

    def remove(self, path: str) -> None:
        self._files.delete(self._path(path), True)


def partial_totals(fact: DataFrame) -> DataFrame:
    """Additive totals of some fact rows, in one pass: rows by provider and rows by product of each year.

    Provider rows carry the sums and make prescribers exact; product rows make products exact.
    """
    return fact.groupingSets(
        [["year", "provider_npi"], ["year", *PRODUCT_KEY]], "year", "provider_npi", *PRODUCT_KEY
    ).agg(F.grouping("provider_npi").cast("int").alias("by_product"), *measure_sums(), selected_fills())


def folded(partials: DataFrame) -> DataFrame:
    """Partials of several batches as one."""
    return partials.groupBy("year", "provider_npi", *PRODUCT_KEY, "by_product").agg(
        *measure_sums(), sum_of("selected_class_fills")
    )


def provider_sketches(partial: DataFrame) -> DataFrame:
    """A mergeable sketch of each year's prescribers."""
    providers = partial.where("by_product = 0")
    return providers.groupBy("year").agg(F.hll_sketch_agg("provider_npi", F.lit(SKETCH_LOG_BUCKETS)).alias("sketch"))


class Upkeep:
    """The fact and the partial totals of one landing folder."""

    def __init__(self, spark: SparkSession, paths: IngestPaths, rules: ScopeRules):
        self.spark, self.paths, self.rules = spark, paths, rules
        self.ledger = Ledger(spark, paths.partials)

    def _totals(self, partial: Partial) -> str:
        return f"{self.paths.partials}/{partial.name}/totals"

    def _sketches(self, partial: Partial) -> str:
        return f"{self.paths.partials}/{partial.name}/sketches"

    def _write(self, partial: Partial, totals: DataFrame) -> None:
        totals.write.mode("overwrite").option("compression", "zstd").parquet(self._totals(partial))
        written = self.spark.read.schema(totals.schema).parquet(self._totals(partial))
        provider_sketches(written).coalesce(1).write.mode("overwrite").parquet(self._sketches(partial))

    def _read(self, partials: list[Partial]) -> DataFrame:
        """Totals of some partials. A folder whose batch kept no row holds no file."""
        schema = partial_totals(typed_fact(self._nothing(), self.rules)).schema
        frames = [self.spark.read.schema(schema).parquet(self._totals(p)) for p in partials]
        return reduce(DataFrame.unionAll, frames, self.spark.createDataFrame([], schema))

    def _nothing(self) -> DataFrame:
        return self.spark.createDataFrame([], LANDING_SCHEMA)

    def take_batch(self, raw: DataFrame, batch: int, run: int) -> None:
        """Write the fact rows and the totals of one micro-batch, and put it into the ledger."""
        fact = typed_fact(raw, self.rules).withColumn("ingest_run", F.lit(run))
        path = f"{self.paths.sink}/batch={batch}"
        fact.write.mode("overwrite").option("compression", "zstd").partitionBy("ingest_run", "year").parquet(path)
        written = self.spark.read.schema(fact.schema).parquet(path)
        mine = Partial(batch, batch, 0)
        self._write(mine, partial_totals(written))
        before = [p for p in self.ledger.live() if p.last < batch]
        live, gone = self._fold(before)
        self.ledger.publish([*live, mine])
        for partial in gone:  # after no ledger names them
            self.ledger.remove(f"{self.paths.partials}/{partial.name}")

    def _fold(self, partials: list[Partial]) -> tuple[list[Partial], list[Partial]]:
        """The partials with equal tiers folded, newest first, and those that went into others."""
        live, gone = list(partials), []
        while len(live) > 1 and live[-1].tier == live[-2].tier:
            pair = [live.pop(), live.pop()]
            whole = Partial(pair[1].first, pair[0].last, pair[0].tier + 1)
            self._write(whole, folded(self._read(pair)))
            live.append(whole)
            gone += pair
        return live, gone

    def ingest_available(self, run: int) -> list[dict]:
        """Take every file that has landed since the last run, then stop; a scan and a commit for each micro-batch.

        After a crash, call again with the same `run`. Returns the rows scanned and kept by each micro-batch.
        """
        raw = raw_stream(self.spark, self.paths.landing).observe(
            "extract", F.count(F.lit(1)).alias("scanned"),
            F.count_if(in_scope(self.rules, "Brnd_Name", "Gnrc_Name")).alias("kept"),
        )
        writer = (
            raw.writeStream.foreachBatch(lambda df, batch: self.take_batch(df, batch, run))
            .option("checkpointLocation", self.paths.checkpoint).trigger(availableNow=True)
        )
        return with_all_progress(self.spark, writer)

    def fact(self) -> DataFrame:
        """The fact rows of the batches in the ledger."""
        live = self.ledger.live()
        last = max((p.last for p in live), default=-1)
        return self.spark.read.parquet(self.paths.sink).filter(F.col("batch") <= last).drop("batch")

    def market_year(self) -> DataFrame:
        """`market_year` from the live partials alone: about log2(batches) of them.

        Distinct counts are not additive over batches, so they are recounted from the partials' keys.
        """
        merged = folded(self._read(self.ledger.live()))
        per_year = merged.groupBy("year", "by_product").agg(
            *measure_sums(), sum_of("selected_class_fills"), F.count(F.lit(1)).alias("keys")
        )
        products = per_year.where("by_product = 1").select(F.col("year").alias("_year"), F.col("keys").alias("products"))
        totals = per_year.where("by_product = 0").withColumnRenamed("keys", "prescribers")
        return (
            totals.join(products, F.col("year") == F.col("_year"))
            .withColumns({**unit_costs(), "selected_class_share": selected_share()})
            .select(
                "year", *MEASURES, "prescribers", "products", "avg_cost_per_claim", "avg_cost_per_30day_fill",
                "selected_class_share",
            )
        )

    def estimated_prescribers(self) -> DataFrame:
        """`year`, `prescribers_estimate` from the partials' sketches alone: some KB a batch and year, no keys."""
        frames = [self.spark.read.schema("year int, sketch binary").parquet(self._sketches(p)) for p in self.ledger.live()]
        sketches = reduce(DataFrame.unionAll, frames, self.spark.createDataFrame([], "year int, sketch binary"))
        return sketches.groupBy("year").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("prescribers_estimate"))
