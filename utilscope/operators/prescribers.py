"""Distinct prescribers of any slice, merged cell or run of years, from the cube's cells alone.

Distinct counts don't add up over cells. Each cell therefore keeps its prescribers as bits: providers
get dense numbers, a bitmap holds the bits of one range of 32,768 numbers, and the union of cells is
the OR of their bitmaps. Numbers follow the providers' labels, so the providers of a cell lie close
together and fill few bitmaps. Beside the bits stands a mergeable sketch of bounded size, for
estimates where the bits would be too many to read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utilscope.operators.aggregates import CELL, provider_cells
from utilscope.operators.cube import Slice, apply_slice
from utilscope.operators.ranking import GlobalOrder
from utilscope.workspace import Workspace

#: log2 of a sketch's buckets; the relative standard error of an estimate is 1.04 / sqrt(buckets).
SKETCH_LOG_BUCKETS = 12
#: Three standard errors.
SKETCH_BOUND = 3 * 1.04 / (1 << SKETCH_LOG_BUCKETS) ** 0.5


def provider_numbers(workspace: Workspace, providers: DataFrame) -> DataFrame:
    """`provider_npi` with `provider_number` (from 1, dense), in the order of the smallest labels seen.

    `providers` has a row for each provider and year, or more. The numbers come from one
    range-partitioned sort and the sizes of its slices.
    """
    labels = ["provider_state", "provider_specialty"]
    each = providers.groupBy("provider_npi").agg(*[F.min(c).alias(c) for c in labels])
    place = F.struct(*labels, "provider_npi").alias("place")
    order = GlobalOrder(workspace, "provider_numbers", each.select("provider_npi", place), [], "place", [])
    return order.numbered().select("provider_npi", F.col("row_number").alias("provider_number"))


def prescriber_cube(fact: DataFrame, deciles: DataFrame, numbers: DataFrame) -> DataFrame:
    """Bits and sketch of the prescribers of every cube cell, a row for each cell and range of numbers.

    `bucket` names the range, `bits` its bitmap, `sketch` its sketch. `deciles` holds year,
    provider_npi and volume_decile. The numbers join the deciles, one row a provider and year, before
    these join the fact's cells. Numbers are shuffled, not partial bitmaps of 4 KB each that hold few of
    them; a cell has at most 32,768 of a range.
    """
    numbered = deciles.select("year", "provider_npi", "volume_decile").join(numbers, "provider_npi")
    number, keys = F.col("provider_number"), ["year", *CELL, "volume_decile", "bucket"]
    return (
        provider_cells(fact).select("year", "provider_npi", *CELL).join(numbered, ["year", "provider_npi"])
        .withColumn("bucket", F.bitmap_bucket_number(number)).select(*keys, number)
        .repartition(*keys).groupBy(*keys)
        .agg(
            F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"),
            F.hll_sketch_agg(number, F.lit(SKETCH_LOG_BUCKETS)).alias("sketch"),
        )
    )


def distinct_prescribers(cells: DataFrame, by: list[str]) -> DataFrame:
    """`prescribers`, exact, of all cells together for each value of `by`."""
    merged = cells.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy(*by).agg(F.sum(F.bitmap_count("bits")).alias("prescribers"))


def estimated_prescribers(cells: DataFrame, by: list[str]) -> DataFrame:
    """`prescribers_estimate` of all cells together for each value of `by`: approximate, see SKETCH_BOUND."""
    return cells.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("prescribers_estimate"))


def slice_prescribers(cells: DataFrame, s: Slice) -> DataFrame:
    """Exact prescribers of a slice in every year, and of all years together (`year` NULL).

    The year filter of the slice is ignored. A slice without cells has only the row of all years, with zero.
    """
    chosen = apply_slice(cells, s, ignore=("year",))
    yearly = chosen.groupBy("year", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    whole = yearly.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits")).agg(
        F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("prescribers"))
    per_year = yearly.groupBy("year").agg(F.sum(F.bitmap_count("bits")).alias("prescribers"))
    return per_year.unionAll(whole.select(F.lit(None).cast("int").alias("year"), "prescribers"))


def compared_prescribers(cells: DataFrame, by: list[str]) -> DataFrame:
    """`prescribers`, `prescribers_estimate`, and `within_bound`: whether the estimate keeps its error bound.

    Estimates of few prescribers are exact but for rounding.
    """
    estimate = estimated_prescribers(cells, by).withColumnsRenamed({c: f"_{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    joined = distinct_prescribers(cells, by).join(estimate, same)
    off = F.abs(F.col("prescribers_estimate") - F.col("prescribers"))
    bound = F.greatest(F.lit(1.0), F.col("prescribers") * SKETCH_BOUND)
    return joined.select(*by, "prescribers", "prescribers_estimate", (off <= bound).alias("within_bound"))
