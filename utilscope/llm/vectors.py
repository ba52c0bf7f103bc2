"""Usable rows of a table of vectors, and the views of them that Arrow batches give numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from utilscope.llm.storage import materialize


def finite(vector: str) -> Column:
    """Whether an array column is not NULL and holds neither NULL nor a non-finite component."""
    wrong = F.exists(F.col(vector).cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~wrong, F.lit(False))


def usable_vectors(vectors: DataFrame, columns: dict[str, str], vector: str, nonzero: bool = False) -> tuple[DataFrame, int]:
    """The rows with a usable vector, written, and the length of their vectors.

    `columns` maps output names to SQL expressions; the vector follows as `vector`, with float or
    double components as given. Rows whose vector is NULL, empty or holds a NULL or non-finite
    component are left out, with `nonzero` also those of zeros alone. Vectors of another length
    than most rows have (ties: the shorter) are left out too; of no row at all the length is 0.
    """
    kind = vectors.schema[vector].dataType
    narrow = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    values = F.col(vector).cast("array<float>" if narrow else "array<double>")
    kept = finite(vector) & (F.size(F.col(vector)) > 0)
    if nonzero:
        kept &= F.exists(values, lambda x: x != 0)
    rows = materialize(
        vectors.where(kept).select(*[F.expr(e).alias(name) for name, e in columns.items()], values.alias("vector"))
    )
    size = F.size("vector")
    most = rows.groupBy(size.alias("size")).count().orderBy(F.desc("count"), "size").first()
    length = 0 if most is None else most["size"]
    return rows.where(size == length), length


def matrix(batch: pa.RecordBatch, column: str = "vector") -> np.ndarray:
    """An array column whose rows have one length, as doubles, a row for each."""
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(batch.num_rows, -1)


def scaled(values: np.ndarray, scale: int, limit: int) -> np.ndarray:
    """floor(scale * value) as 64-bit integers; one beyond +-limit stops the job, as sums would not stay exact."""
    with np.errstate(over="ignore"):
        floors = np.floor(values * float(scale))
    if floors.size and np.abs(floors).max() > limit:
        raise ValueError(f"a component is beyond {limit / scale:g}: exact 64-bit sums need smaller ones")
    return floors.astype(np.int64)
