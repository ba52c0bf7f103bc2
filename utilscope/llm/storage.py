"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utilscope.workspace import Workspace, shared_root


#: Rows of a checkpoint file, for frames whose size is known to be small.
FILE_ROWS = 100_000


def materialize(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The rows, written to the shared checkpoint folder and read back from there.

    A frame of at most `rows` rows is dealt to as few files as that needs.

    A lost executor costs a re-read of its part, not a re-run of the plan above. The folder is
    the one named by `spark.checkpoint.dir`; Spark's cleaner removes the files once the frame
    is unreachable (`spark.cleaner.referenceTracking.cleanCheckpoints`).
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession))
    if rows is not None:
        files = max(1, -(-rows // FILE_ROWS))
        if files < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
            df = df.repartition(files)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table of the shared folder, whose size Spark knows when it plans a join."""
    workspace = Workspace(df.sparkSession)
    return workspace.write(workspace.path("table"), df)


def splittable(grouped: DataFrame) -> DataFrame:
    """An aggregate dealt out anew, so that a join on its key shuffles both sides.

    Spark splits a hot key of a join only where both sides come straight from a shuffle; an
    aggregate that keeps its partitions would pin all rows of the key to one task.
    """
    return grouped.hint("rebalance")


#: Least and most bits of a broadcast membership filter (512 KB and 16 MB), and bits for each hash between them.
FILTER_BITS, MOST_FILTER_BITS, BITS_A_HASH = 1 << 22, 1 << 27, 16


class Filter:
    """A broadcast bitmap over the LONG hashes of a one-column frame, of a size between two bounds.

    It is built by an aggregation, whatever the number of hashes; `may_hold` is never false for
    one of them. Of other hashes it passes about 1 in 16, and more only beyond 8 million hashes.
    """

    def __init__(self, hashes: DataFrame):
        name = hashes.columns[0]
        wanted = BITS_A_HASH * max(1, hashes.count())
        self._size = min(max(FILTER_BITS, 1 << (wanted - 1).bit_length()), MOST_FILTER_BITS)
        words = (
            hashes.groupBy(F.shiftright(F.col(name).bitwiseAND(F.lit(self._size - 1)), 6).alias("word"))
            .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(`{name}` & 63 as int))")).alias("bits")).toArrow()
        )
        bits = np.zeros(self._size // 64, np.uint64)
        bits[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
        self._bits = hashes.sparkSession.sparkContext.broadcast(bits)

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes.view(np.uint64) & np.uint64(self._size - 1)
        word = self._bits.value[(slot >> np.uint64(6)).astype(np.int64)]
        return ((word >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)


def keep_keys(docs: DataFrame, key: list[Column], keys: DataFrame) -> DataFrame:
    """The rows of `docs` whose key (an id and a hash) is `kept` in the stored `keys`, one row a key.

    `keys` holds `key`, `hash`, `both` (their hash), `kept` and `rows` for every key of `docs`. Three
    bitmaps decide most rows where they are read: a row that can only be of a kept key, or only of one
    that is not, moves nowhere. Just the others, and the keys with several rows, meet the keys by a
    join. Columns of `docs` keep their names, whatever they are.
    """
    filters = [Filter(keys.where(c).select("both")) for c in ("kept", "not kept", "kept and rows > 1")]

    @F.arrow_udf("int")
    def standing(values: pa.Array) -> pa.Array:
        held = [f.may_hold(values.to_numpy()) for f in filters]
        return pa.array(np.where(~held[0], 0, np.where(held[1] | held[2], 2, 1)).astype(np.int32))  # goes, stays, doubtful

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    marked = docs.select(row, key[0].alias("key"), key[1].alias("hash")).withColumn("standing", standing(F.xxhash64("key", "hash")))
    doubtful = marked.where("standing = 2")
    once = splittable(keys.where("kept").select(F.col("key").alias("k"), F.col("hash").alias("h"), "rows"))
    met = doubtful.join(once, F.col("key").eqNullSafe(F.col("k")) & (F.col("hash") == F.col("h")))
    several = met.where("rows > 1").dropDuplicates(["key", "hash"])
    found = marked.where("standing = 1").select("row").unionAll(met.where("rows = 1").select("row")).unionAll(several.select("row"))
    return found.select("row.*")


def maybe_in(hashes: DataFrame, of: Column) -> Column:
    """Whether a row's LONG hash `of` may be among those of the one-column frame `hashes`.

    Lets most rows pass by an exact join.
    """
    known = Filter(hashes)

    @F.arrow_udf("boolean")
    def held(values: pa.Array) -> pa.Array:
        return pa.array(known.may_hold(values.to_numpy()))

    return held(of)
