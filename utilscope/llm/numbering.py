"""Gapless numbers in a sorted order, without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from utilscope.llm.storage import materialize


def numbered(df: DataFrame, order: list[str], name: str, within: str | None = None) -> DataFrame:
    """`df` with `name`: 0, 1, 2, ... in the order of `order`, started anew for each `within`.

    Rows are range-partitioned and written once; a slice's rows are numbered inside the slice
    and moved by the rows of the slices before it. Rows that tie in all of `order` are told apart
    by their place in the input, so a key that most rows share still spans several slices.
    """
    group = [] if within is None else [within]
    tied = df.withColumn("_row", F.monotonically_increasing_id())
    keys = [*group, *order, "_row"]
    slices = materialize(
        tied.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_slice", F.spark_partition_id())
    )
    counts = slices.groupBy(*group, "_slice").count()
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, "_slice").orderBy(*order, "_row")
    placed = slices.withColumn("_place", F.row_number().over(inside).cast("long") - 1)
    joined = placed.join(
        offsets.withColumnsRenamed({c: f"_{c}_of" for c in group}).withColumnRenamed("_slice", "_slice_of"),
        [F.col("_slice") == F.col("_slice_of"), *[F.col(c).eqNullSafe(F.col(f"_{c}_of")) for c in group]],
    )
    return joined.select(*df.columns, (F.col("_place") + F.col("_before")).alias(name))
