"""Connected components of a link table: contraction inside partitions, alternating stars between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utilscope.llm.storage import FILE_ROWS, materialize, splittable


def smallest_members(pairs: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of the connected class of each of n members, given pairs of members."""
    labels = np.arange(n)
    while len(pairs):
        low = np.minimum(labels[pairs[:, 0]], labels[pairs[:, 1]])
        before = labels.copy()
        np.minimum.at(labels, pairs[:, 0], low)
        np.minimum.at(labels, pairs[:, 1], low)
        labels = labels[labels]
        if (labels == before).all():
            break
    return labels


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a partition as stars: every node with the smallest one that it reaches by them."""
    held = [np.zeros((0, 2), np.int64)]
    size = 0

    def stars() -> pa.RecordBatch:
        nodes, places = np.unique(np.concatenate(held), return_inverse=True)
        roots = nodes[smallest_members(places.reshape(-1, 2), len(nodes))]
        moved = roots != nodes
        return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(roots[moved])], ["u", "v"])

    for batch in batches:
        held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1))
        size += batch.num_rows
        if size > 2 * FILE_ROWS:  # a partition is about FILE_ROWS; a longer one is taken in parts
            yield stars()
            held, size = [np.zeros((0, 2), np.int64)], 0
    yield stars()


def _contracted(edges: DataFrame, files: int) -> DataFrame:
    return materialize(edges.repartition(files).mapInArrow(_contract, "u long, v long"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every neighbour above a node on the node's smallest neighbour."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy("u").agg(F.min("v").alias("m"))
    smallest = splittable(smallest.select("u", F.least("u", "m").alias("m")))
    return both.join(smallest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its neighbours below it on the smallest of them."""
    smallest = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(splittable(smallest), "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(smallest.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Count and checksum of the edges, to see that nothing moved."""
    hashed = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(hashed)).first())


def components(links: DataFrame, left: str, right: str, rows: int | None = None, file_rows: int = FILE_ROWS) -> DataFrame:
    """(`node`, `component`) for every node that has a link; `component` is its smallest node.

    Ids are LONG. Self links, NULL ends and repeated links are ignored. `rows` is the number of
    links where the caller knows it. Links are dealt to partitions of `file_rows`, and each
    partition contracts its own to stars. As long as there are several partitions, a round of
    large and small stars joins them: aggregations with map-side combine and joins on the node
    whose hot keys Spark splits, so a hub's neighbours are never gathered in one task. The rounds
    needed grow with the logarithm of the longest chain.
    """
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    edges = materialize(
        links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), rows
    )
    files = max(1, -(-edges.count() // file_rows))
    edges = _contracted(edges, files)
    before = _mark(edges) if files > 1 else None
    while files > 1:
        edges = _contracted(_small_star(_large_star(edges)), files)
        after = _mark(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).distinct().unionAll(roots)
