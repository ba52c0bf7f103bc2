"""Near-duplicate vectors by cross-polytope hashing with multiprobe buckets and verified pairs.

A vector is rotated by sign flips and fast Hadamard transforms; its hash is the signed axis
nearest to the result. Several hashes make the key of a table. A vector enters its own bucket
of every table and the buckets of its nearest other axes, so close vectors meet in some bucket.
All pairs that meet are verified by their cosine in double precision.

Equal vectors are folded to one first. A bucket is cut into blocks of bounded size, and pairs of
blocks are verified as matrix products: a pair is counted only in the smallest bucket that both
vectors share, and a block yields a row for each of its vectors, never one for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utilscope.llm.graph import components, smallest_members
from utilscope.llm.shingles import mix
from utilscope.llm.storage import materialize, splittable


@dataclass(frozen=True)
class Hashing:
    """Tables, hashes in a table's key, and buckets that a vector enters in a table."""

    least_cosine: float = 0.93
    tables: int = 8
    hashes: int = 2
    probes: int = 3
    block: int = 1024
    seed: int = 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """The rows under the orthonormal Hadamard transform; their length is a power of two."""
    n, d = x.shape
    step = 1
    while step < d:
        x = x.reshape(n, d // (2 * step), 2, step)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2)
        step *= 2
    return x.reshape(n, d) / np.sqrt(d)


def _near_axes(vectors: np.ndarray, signs: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest signed axes of the rotated rows, nearest first, and how much is lost by each."""
    for flips in signs:
        vectors = hadamard(vectors * flips)
    size = np.abs(vectors)
    axes = np.argsort(-size, axis=1, kind="stable")[:, :most]
    values = np.take_along_axis(vectors, axes, 1)
    strength = np.abs(values)
    return axes * 2 + (values < 0), strength[:, :1] - strength


def bucket_keys(vectors: np.ndarray, hashing: Hashing) -> np.ndarray:
    """Keys (rows x tables * probes, distinct within a row) of the buckets that each vector enters."""
    n, d = vectors.shape
    dim = 1 << max(1, (d - 1).bit_length())
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    padded = np.zeros((n, dim))
    padded[:, :d] = unit
    random = np.random.default_rng((hashing.seed, d))
    most = min(hashing.probes, dim)
    keys = np.zeros((n, hashing.tables, hashing.probes), np.uint64)
    for table in range(hashing.tables):
        axes, losses = [], []
        for _ in range(hashing.hashes):
            signs = random.choice([-1.0, 1.0], (3, dim))
            a, lost = _near_axes(padded, signs, most)
            axes.append(a)
            losses.append(lost)
        # Probes in order of loss, one hash moved to another of its axes at a time; the first moves none.
        moves = [(h, rank) for h in range(hashing.hashes) for rank in range(1, most)]
        cost = np.stack([losses[h][:, rank] for h, rank in moves], axis=1)
        best = np.argsort(cost, axis=1, kind="stable")[:, :hashing.probes - 1]
        for probe in range(min(hashing.probes, 1 + len(moves))):
            chosen = [a[:, 0].copy() for a in axes]
            if probe:
                for number, (h, rank) in enumerate(moves):
                    moved = best[:, probe - 1] == number
                    chosen[h][moved] = axes[h][moved, rank]
            key = np.full(n, table, np.uint64)
            for value in chosen:
                key = mix(key * np.uint64(2 * dim + 1) + value.astype(np.uint64), 31)
            keys[:, table, probe] = key
    return keys.reshape(n, -1)


def _entries(batches: Iterator[pa.RecordBatch], hashing: Hashing) -> Iterator[pa.RecordBatch]:
    """node, label, copies, vector (doubles) and buckets of every folded vector."""
    for batch in batches:
        vectors = batch.column("vector")
        sizes = vectors.value_lengths().to_numpy()
        for size in np.unique(sizes):
            rows = batch.take(pa.array(np.flatnonzero(sizes == size)))
            matrix = rows.column("vector").flatten().to_numpy().reshape(-1, size)
            labels = rows.column("label").to_numpy()
            # Vectors of other labels or lengths never meet.
            own = mix(mix(labels.view(np.uint64), 32) + np.uint64(size), 33)
            keys = bucket_keys(matrix, hashing) ^ own[:, None]
            offsets = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1])
            buckets = pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([*rows.columns, buckets], [*rows.schema.names, "buckets"])


def _verified(rows: pa.Table, hashing: Hashing) -> pa.RecordBatch | None:
    """(node, other, links) of the rows of one pair of blocks of one bucket."""
    n = rows.num_rows
    if n < 2:
        return None
    key, low, high = (rows[c][0].as_py() for c in ("key", "low", "high"))
    label, block = rows["label"].to_numpy(), rows["block"].to_numpy()
    lengths = pa.compute.list_value_length(rows["vector"]).to_numpy()
    if (lengths != lengths[0]).any():  # vectors of several lengths share a key by accident
        parts = [_verified(rows.filter(pa.array(lengths == size)), hashing) for size in np.unique(lengths)]
        parts = [p for p in parts if p is not None]
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if parts else None
    vectors = rows["vector"].combine_chunks().flatten().to_numpy().reshape(n, -1)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = (unit @ unit.T >= hashing.least_cosine) & (label[:, None] == label[None, :])
    if low != high:
        near &= block[:, None] != block[None, :]
    pairs = np.argwhere(np.triu(near, 1))
    if not len(pairs):
        return None
    node, copies = rows["node"].to_numpy(), rows["copies"].to_numpy()
    buckets = rows["buckets"].combine_chunks().flatten().to_numpy().reshape(n, -1)
    links = np.zeros(n, np.int64)
    for part in np.array_split(pairs, len(pairs) // 4096 + 1):
        a, b = buckets[part[:, 0]], buckets[part[:, 1]]
        shared = (a[:, :, None] == b[:, None, :]).any(2)
        smallest = np.where(shared, a, np.iinfo(np.int64).max).min(1)
        here = part[smallest == key]
        np.add.at(links, here[:, 0], copies[here[:, 1]])
        np.add.at(links, here[:, 1], copies[here[:, 0]])
    other = node[smallest_members(pairs, n)]
    told = np.flatnonzero((links > 0) | (other != node))
    if not len(told):
        return None
    return pa.RecordBatch.from_arrays(
        [pa.array(node[told]), pa.array(other[told]), pa.array(links[told])], ["node", "other", "links"]
    )


def _blocks(batches: Iterator[pa.RecordBatch], hashing: Hashing) -> Iterator[pa.RecordBatch]:
    """Verify the block pairs of sorted rows; one pair of blocks is held at a time."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = (table if held is None else pa.concat_tables([held, table])).combine_chunks()
        columns = [table[c].to_numpy() for c in ("key", "low", "high")]
        changed = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        starts = np.concatenate([[0], np.flatnonzero(changed) + 1])
        for first, end in zip(starts[:-1], starts[1:]):
            if end - first > 1 and (found := _verified(table.slice(first, end - first), hashing)) is not None:
                yield found
        held = table.slice(starts[-1])
    if held is not None and (found := _verified(held, hashing)) is not None:
        yield found


def embedding_classes(
    vectors: DataFrame, hashing: Hashing = Hashing(), id: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """`id`, `n_links`, `component_id`, `kept` for every row of `vectors`.

    Rows link when their labels are equal and not NULL and their cosine reaches the threshold.
    `n_links` counts the other rows linked directly, `component_id` is the smallest id reached
    (the row's own included), `kept` tells whether that is the row's own. Vectors that are NULL,
    empty, zero or hold a NULL or non-finite component link with nothing, nor do vectors of
    different lengths. Repeated rows are vectors of their own. A NULL id names no class.
    Every row is indexed; which pairs of near vectors meet depends on `hashing`.
    """
    values = F.col(vector).cast("array<double>")
    wrong = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce((F.size(values) > 0) & ~wrong & F.exists(values, lambda x: x != 0.0), F.lit(False))
    rows = vectors.select(
        F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), values.alias("vector"),
        (usable & F.col(label).isNotNull()).alias("usable"),
    ).withColumn("node", F.when(F.col("usable"), F.xxhash64("label", "vector")))
    folded = rows.where("usable").groupBy("node").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"),
        F.first("vector").alias("vector"),
    )
    schema = "node long, id long, copies long, label long, vector array<double>, buckets array<long>"
    folded = materialize(folded.mapInArrow(lambda batches: _entries(batches, hashing), schema))
    entries = folded.select("node", F.explode(F.array_distinct("buckets")).alias("key"))
    sizes = splittable(entries.groupBy("key").count().where("count > 1"))
    blocks = F.ceil(F.col("count") / hashing.block).cast("int")
    placed = entries.join(sizes, "key").select("key", "node", blocks.alias("blocks")).withColumn(
        "block", F.pmod(F.xxhash64("node"), "blocks").cast("int")
    )
    paired = placed.withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("block", "mate").alias("low"), F.greatest("block", "mate").alias("high"), "block", "node")
    full = paired.join(folded.select("node", "copies", "label", "vector", "buckets"), "node")
    dealt = full.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    told = materialize(dealt.select("key", "low", "high", "block", "node", "copies", "label", "vector", "buckets")
                       .mapInArrow(lambda batches: _blocks(batches, hashing), "node long, other long, links long"))
    links = told.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(told.where("node != other"), "node", "other")
    known = (
        folded.select("node", "id", "copies").join(links, "node", "left").join(classes, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    smallest = known.groupBy("component").agg(F.min("id").alias("component_id"), F.sum("copies").alias("members"))
    grouped = known.join(smallest.where("members > 1").drop("members"), "component").select(
        "node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")
    )
    component = F.when(F.col("component_id").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    return rows.select("id", "node").join(grouped, "node", "left").select(
        F.col("id").alias(id), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"),
    )
