"""The heaviest of very many labels, without grouping all of them.

A sketch sums the measure in ROWS x WIDTH hash buckets. It is taken on the map side, has a fixed
size and is merged by addition, whatever the number of labels. As no part of a bucket is negative,
a label's total is at most that of its bucket. Labels of the heaviest buckets are summed first; the
k-th of them is a total that k labels reach. Only labels whose every bucket reaches it too can be
among the k heaviest: those alone are grouped and summed exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of the sketch: 2 x 65,536 sums, 1 MB. More labels than buckets only make it less sharp.
ROWS, WIDTH = 2, 1 << 16
#: Sums of floating-point numbers differ in their last places with the order of the rows.
SLACK = 1e-9


def _bucket(label: str, row: int) -> Column:
    return F.pmod(F.xxhash64(F.col(label), F.lit(row)), F.lit(WIDTH)).cast("int")


def sketch(df: DataFrame, label: str, measure: str) -> np.ndarray:
    """Upper bounds: the positive parts of `measure`, summed in each row's buckets."""
    places = F.explode(F.array(*[_bucket(label, row) + row * WIDTH for row in range(ROWS)])).alias("bucket")
    number = F.coalesce(F.col(measure).cast("double"), F.lit(0.0))
    # NaN sorts above all numbers, so it must not hide a label.
    weight = F.when(F.isnan(number), float("inf")).otherwise(F.greatest(number, F.lit(0.0))).alias("weight")
    found = df.select(places, weight).groupBy("bucket").agg(F.sum("weight").alias("weight")).toArrow()
    sums = np.zeros(ROWS * WIDTH)
    sums[found["bucket"].to_numpy()] = found["weight"].to_numpy()
    return sums.reshape(ROWS, WIDTH)


def _in_buckets(df: DataFrame, label: str, row: int, buckets: np.ndarray) -> DataFrame:
    """The rows whose label falls into one of the row's buckets, of which there are at most WIDTH."""
    name = f"_bucket{row}"
    wanted = df.sparkSession.createDataFrame(pa.table({name: pa.array(buckets.astype(np.int32))}))
    return df.join(F.broadcast(wanted), _bucket(label, row) == F.col(name), "left_semi")


def heavy_rows(df: DataFrame, label: str, measure: str, k: int) -> DataFrame:
    """The rows of all labels that can be among the `k` with the highest sum of `measure`, ties included.

    No label that belongs to them is left out. With fewer than `k` labels, or where the k-th total is
    not above zero, all rows are returned; so they are where labels are all about as heavy.
    A NULL label is a label.
    """
    bounds = sketch(df, label, measure)
    first = np.argsort(-bounds[0], kind="stable")[: 4 * k]
    totals = _in_buckets(df, label, 0, first).groupBy(label).agg(F.sum(measure).cast("double").alias("total"))
    top = [r["total"] for r in totals.orderBy(F.col("total").desc_nulls_last()).limit(k).collect()]
    if not top or len(top) < k or not (top[-1] or 0) > 0:
        return df
    for row in range(ROWS):
        df = _in_buckets(df, label, row, np.flatnonzero(bounds[row] >= top[-1] * (1 - SLACK)))
    return df
