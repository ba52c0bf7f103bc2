"""Nearest neighbours by an inverted multi-index over two halves of the vectors.

Each half has its own centroids, and a pair of them is a cell, so few centroids give many cells.
A query walks the cells in order of the summed squared distances to both centroids, with a heap,
until enough rows are gathered. Their exact distances bound the distance of its k-th neighbour, and
the bound tells how far the walk has to go: to cells whose centroids are at most `reach` times the
bound farther away than the nearest cell's. The walk is short where vectors lie in clusters and
long where nothing is near. A reach of 2 loses nothing, by the triangle inequality.

Equal vectors are folded to one node before anything is joined. The cells of a first centroid make
a region; a large region is cut into blocks, and a query's vector is sent once to each block of a
region that it walks through, not to each cell. A task holds one block, through which its queries
stream; they are dealt to several tasks where there are many.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from utilscope.llm.storage import materialize, splittable
from utilscope.llm.vectors import matrix, usable_vectors


@dataclass(frozen=True)
class Search:
    """Neighbours wanted, and the settings of the index.

    The centroids of a half are the root of distinct vectors / `cell_rows`, `most_centroids` at most
    (their pairs' sizes are broadcast: 8 MB), fitted in `rounds` rounds on `sampled` vectors for each.
    A walk first gathers `gathered` rows and then goes as far as `reach` says. `block` bounds the rows
    of a task's block, `queries` the queries that stream through it.
    """

    neighbours: int = 10
    cell_rows: int = 16
    most_centroids: int = 1024
    sampled: int = 32
    rounds: int = 8
    gathered: int = 1000
    reach: float = 0.2
    block: int = 2048
    queries: int = 32768
    seed: int = 13


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of `a` to all rows of `b`, up to rounding, none negative."""
    found = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T
    return np.maximum(found, 0, out=found)


def fitted_centroids(points: np.ndarray, count: int, search: Search) -> np.ndarray:
    """`count` centroids of a bounded sample by Lloyd's rounds; unused ones stay."""
    random = np.random.default_rng(search.seed)
    centroids = points[random.choice(len(points), count, replace=False)]
    for _ in range(search.rounds):
        nearest = np.concatenate([squared_distances(part, centroids).argmin(1) for part in np.array_split(points, len(points) // 4096 + 1)])
        used = np.bincount(nearest, minlength=count)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, points)
        centroids = np.where(used[:, None] > 0, sums / np.maximum(used, 1)[:, None], centroids)
    return centroids


@dataclass(frozen=True)
class Cells:
    """Centroids of both halves and the rows of each pair of them."""

    first: np.ndarray
    second: np.ndarray
    sizes: np.ndarray

    def halves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of the vectors' halves to the centroids."""
        cut = self.first.shape[1]
        return squared_distances(vectors[:, :cut], self.first), squared_distances(vectors[:, cut:], self.second)


def walked(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, enough: int) -> np.ndarray:
    """Cells (as first * centroids + second) in order of a[first] + b[second] until they hold `enough` rows.

    A cell enters the heap once both cells before it, one place nearer in either half, are done.
    """
    rows, columns = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    near, beside = a[rows].tolist(), b[columns].tolist()
    rows, columns = rows.tolist(), columns.tolist()
    heap = [(near[0] + beside[0], 0, 0)]
    done = [0] * (len(rows) + 1)  # how many columns of a row are done
    found, gathered = [], 0
    while heap and gathered < enough:
        _, i, j = heapq.heappop(heap)
        done[i] = j + 1
        size = sizes[rows[i], columns[j]]
        if size:
            found.append(rows[i] * len(columns) + columns[j])
            gathered += size
        if i + 1 < len(rows) and done[i + 1] == j:
            heapq.heappush(heap, (near[i + 1] + beside[j], i + 1, j))
        if j + 1 < len(columns) and (i == 0 or done[i - 1] > j + 1):
            heapq.heappush(heap, (near[i] + beside[j + 1], i, j + 1))
    return np.array(found, np.int64)


def _cells_of(batches: Iterator[pa.RecordBatch], cells: Cells) -> Iterator[pa.RecordBatch]:
    """The rows with the nearest centroid of either half."""
    for batch in batches:
        if batch.num_rows:
            a, b = cells.halves(matrix(batch))
            places = [pa.array(x.argmin(1).astype(np.int32)) for x in (a, b)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *places], [*batch.schema.names, "region", "cell"])


def _walks(batches: Iterator[pa.RecordBatch], cells, search: Search, further: bool) -> Iterator[pa.RecordBatch]:
    """node, vector, bound, region, cells: a row for each region that a query walks through.

    At first cells are walked until enough rows are gathered. With `further`, the cells left up to
    the end of the walk are told, as the rows' `bound` has it.
    """
    known = cells.value
    for batch in batches:
        if not batch.num_rows:
            continue
        near = known.halves(matrix(batch))
        bounds = batch.column("bound").to_numpy()
        row, region, lists = [], [], []
        for n, (a, b) in enumerate(zip(*near)):
            told = walked(a, b, known.sizes, search.gathered)
            if further:
                end = np.sqrt(a.min() + b.min()) + search.reach * np.sqrt(bounds[n])
                wanted = (a[:, None] + b <= end * end) & (known.sizes > 0)
                wanted.ravel()[told] = False
                told = np.flatnonzero(wanted)
            told = np.sort(told)
            regions, starts = np.unique(told // len(known.second), return_index=True)
            for r, of in zip(regions.tolist(), np.split(told % len(known.second), starts[1:])):
                row.append(n)
                region.append(r)
                lists.append(of.astype(np.int32))
        for part in range(0, len(row), 4096):  # bounded batches, however many regions a query walks through
            taken = batch.select(["node", "vector", "bound"]).take(pa.array(row[part:part + 4096], pa.int64()))
            places = [pa.array(region[part:part + 4096], pa.int32()), pa.array(lists[part:part + 4096], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*taken.columns, *places], [*taken.schema.names, "region", "cells"])


class _Block:
    """The rows of one block of a region, in order of their cells."""

    def __init__(self, rows: pa.Table):
        cell = rows["cell"].to_numpy()
        rows = rows.take(pa.array(np.argsort(cell, kind="stable"))).combine_chunks()
        self.vectors = matrix(rows.to_batches()[0])
        self.squares = (self.vectors * self.vectors).sum(1)
        self.node, self.least, self.copies = (rows[c].to_numpy() for c in ("node", "least", "copies"))
        self.cells, starts = np.unique(rows["cell"].to_numpy(), return_index=True)
        self.starts = np.append(starts, len(cell))

    def near(self, queries: pa.RecordBatch, most: int) -> pa.RecordBatch:
        """query, node, least, copies, distance (squared): the `most` nearest rows of each query's cells inside its bound."""
        vectors, bounds = matrix(queries), queries.column("bound").to_numpy()
        squares = (vectors * vectors).sum(1)
        lists = queries.column("cells")
        row = np.repeat(np.arange(queries.num_rows), lists.value_lengths().to_numpy())
        wanted = lists.flatten().to_numpy()
        place = np.minimum(np.searchsorted(self.cells, wanted), len(self.cells) - 1)
        here = self.cells[place] == wanted
        row, place = row[here], place[here]
        order = np.argsort(place, kind="stable")
        row, place = row[order], place[order]
        cuts = np.flatnonzero(np.diff(place, prepend=-1))
        pairs = []
        for first, end in zip(cuts, [*cuts[1:], len(place)]):
            low, high = self.starts[place[first]], self.starts[place[first] + 1]
            for part in range(first, end, 1024):
                q = row[part:min(part + 1024, end)]
                scale = squares[q][:, None] + self.squares[low:high]
                rough = scale - 2 * vectors[q] @ self.vectors[low:high].T
                # Rounding is far below this slack, so no row inside the bound is lost.
                i, j = np.nonzero(rough <= bounds[q][:, None] + 1e-9 * scale)
                pairs.append(self._nearest(q[i], low + j, vectors, bounds, most))
        pairs = [p for p in pairs if len(p[0])]
        if not pairs:
            return None
        q, r, distance = (np.concatenate(c) for c in zip(*pairs))
        q, r, distance = self._first(q, r, distance, most)
        columns = [queries.column("node").take(pa.array(q)), self.node[r], self.least[r], self.copies[r], distance]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query", "node", "least", "copies", "distance"])

    def _nearest(self, q, r, vectors, bounds, most):
        """The pairs inside the bound with their exact distances, the `most` nearest of each query."""
        distance = np.zeros(len(q))
        for part in range(0, len(q), 16384):
            s = slice(part, part + 16384)
            apart = vectors[q[s]] - self.vectors[r[s]]
            # Added component by component, in order, as a plain loop would.
            distance[s] = np.ascontiguousarray((apart * apart).T).sum(0)
        inside = distance <= bounds[q]
        return self._first(q[inside], r[inside], distance[inside], most)

    def _first(self, q, r, distance, most):
        """The `most` pairs of each query of least distance; ties go to the smaller least id."""
        order = np.lexsort((self.least[r], distance, q))
        q, r, distance = q[order], r[order], distance[order]
        starts = np.flatnonzero(np.diff(q, prepend=-1))
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
        return q[place < most], r[place < most], distance[place < most]


def _reranked(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Stream the queries of sorted rows through the block that stands before them."""
    key, held, block = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.stack([batch.column(c).to_numpy() for c in ("region", "block", "deal", "kind")])
        cuts = np.flatnonzero(np.any(columns[:, 1:] != columns[:, :-1], axis=0)) + 1
        for first, end in zip([0, *cuts], [*cuts, batch.num_rows]):
            *at, kind = columns[:, first].tolist()
            if at != key:
                key, held, block = at, [], None
            part = batch.slice(first, end - first)
            if kind == 0:
                held.append(part.select(["node", "vector", "least", "copies", "cell"]))
            elif held or block:
                if block is None:
                    block, held = _Block(pa.Table.from_batches(held)), []
                for some in range(0, part.num_rows, 2048):
                    found = block.near(part.slice(some, 2048), most)
                    if found is not None:
                        yield found


_FOUND = "query long, node long, least long, copies int, distance double"


def _searched(index: DataFrame, queries: DataFrame, cells, search: Search, further: bool) -> DataFrame:
    """The nearest rows of the cells that the queries (`node`, `vector`, `bound`) walk through."""
    kind = index.schema["vector"].dataType.simpleString()
    walks = materialize(queries.mapInArrow(
        lambda batches: _walks(batches, cells, search, further),
        f"node long, vector {kind}, bound double, region int, cells array<int>",
    ))
    # Rows by region: numbers of blocks and of parts that queries are dealt to, one row a centroid.
    sizes = cells.value.sizes.sum(1)
    blocks = np.maximum(1, -(-sizes // search.block))
    parts = np.ones(len(sizes), np.int64)
    for region, count in walks.groupBy("region").count().collect():
        parts[region] = -(-count // search.queries)
    blocks, parts = (F.array(*[F.lit(int(n)) for n in counts])[F.col("region")] for counts in (blocks, parts))
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    rows = index.select("*", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"), spread(parts).alias("deal"))
    asking = walks.select("*", spread(blocks).alias("block"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("deal"))
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    place = ["region", "block", "deal", "kind"]
    both = rows.select(
        *place[:3], F.lit(0).alias("kind"), "node", "vector", "least", "copies", "cell", none("bound", "double"), none("cells", "array<int>")
    ).unionAll(asking.select(
        *place[:3], F.lit(1).alias("kind"), "node", "vector", none("least", "long"), none("copies", "int"), none("cell", "int"), "bound", "cells"
    ))
    dealt = both.repartition(*place[:3]).sortWithinPartitions(*place)
    found = dealt.mapInArrow(lambda batches: _reranked(batches, search.neighbours + 1), _FOUND)
    return _nearest_of(found, search.neighbours + 1)


def _nearest_of(found: DataFrame, most: int) -> DataFrame:
    """The `most` nearest rows found for each query."""
    order = Window.partitionBy("query").orderBy("distance", "least")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place")


def _folded(rows: DataFrame, most: int) -> DataFrame:
    """node, vector, ids (the `most` smallest), least, copies: a row for each distinct vector, written."""
    inside = Window.partitionBy("vector").orderBy("id")
    few = rows.withColumn("place", F.row_number().over(inside)).where(F.col("place") <= most)
    nodes = few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return materialize(nodes.select(
        F.monotonically_increasing_id().alias("node"), "vector", "ids", F.col("ids")[0].alias("least"), F.size("ids").alias("copies")
    ))


def build_index(nodes: DataFrame, length: int, search: Search) -> tuple[DataFrame, object]:
    """node, vector, least, copies, region, cell of every node, written; and the cells, broadcast."""
    count = nodes.count()
    centroids = min(search.most_centroids, int(np.ceil(np.sqrt(count / search.cell_rows))))
    sample = nodes.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(centroids * search.sampled).toArrow()
    points = matrix(sample.combine_chunks().to_batches()[0])
    cut = (length + 1) // 2
    halves = [fitted_centroids(half, min(centroids, len(half)), search) for half in (points[:, :cut], points[:, cut:])]
    cells = Cells(*halves, np.zeros((len(halves[0]), len(halves[1])), np.int64))
    kind = nodes.schema["vector"].dataType.simpleString()
    index = materialize(nodes.select("node", "vector", "least", "copies").mapInArrow(
        lambda batches: _cells_of(batches, cells),
        f"node long, vector {kind}, least long, copies int, region int, cell int",
    ))
    counted = index.groupBy("region", "cell").count().toArrow()
    cells.sizes[counted["region"].to_numpy(), counted["cell"].to_numpy()] = counted["count"].to_numpy()
    return index, nodes.sparkSession.sparkContext.broadcast(cells)


def nearest_vectors(
    vectors: DataFrame, asked, search: Search = Search(), id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """`query_id`, `rank` (from 1), `vec_id`, `score`: the nearest rows found for the rows whose id meets `asked`.

    `asked` makes a condition of the id's column. Nearness is the Euclidean distance in double precision,
    nearest first; ties go to the smaller id. Candidates are all rows but the query's own; equal vectors of other
    rows are neighbours at distance zero, and a repeated row has its copies as neighbours. Rows take no part whose
    id or vector is NULL, or whose vector is empty, zero or holds a NULL or non-finite component, nor vectors of
    another length than most rows have. With fewer candidates than wanted all are returned. Further columns of
    `vectors` are ignored, whatever their names. Every row is indexed; the centroids are fitted on the bounded
    sample of least hashes.
    """
    rows, length = usable_vectors(vectors, {"id": f"cast(`{id}` as long)"}, vector, nonzero=True)
    rows = rows.where("id IS NOT NULL")
    wanted = search.neighbours + 1  # a query's own row is among them
    nodes = _folded(rows, wanted)
    schema = "query_id long, rank int, vec_id long, score double"
    if nodes.isEmpty():
        return rows.sparkSession.createDataFrame([], schema)
    index, cells = build_index(nodes, length, search)
    asking = materialize(
        rows.where(asked(F.col("id"))).join(splittable(nodes.select("node", "vector")), "vector").select("id", "node")
    )
    queries = asking.select("node").distinct().join(nodes.select("node", "vector"), "node")
    unbounded = F.lit(float("inf")).alias("bound")
    near = materialize(_searched(index, queries.select("node", "vector", unbounded), cells, search, further=False))
    # The distance within which enough rows are known bounds the last neighbour's.
    so_far = F.sum("copies").over(Window.partitionBy("query").orderBy("distance", "least").rowsBetween(Window.unboundedPreceding, 0))
    bounds = near.withColumn("so_far", so_far).where(F.col("so_far") >= wanted).groupBy("query").agg(F.min("distance").alias("bound"))
    bounded = queries.join(bounds.withColumnRenamed("query", "node"), "node", "left")
    bounded = bounded.select("node", "vector", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    found = near.unionAll(_searched(index, bounded, cells, search, further=True))
    found = _nearest_of(found, wanted)
    ids = found.join(splittable(nodes.select("node", "ids")), "node").select("query", "distance", F.explode("ids").alias("id"))
    order = Window.partitionBy("query").orderBy("distance", "id")
    lists = ids.withColumn("place", F.row_number().over(order)).where(F.col("place") <= wanted).groupBy("query").agg(
        F.sort_array(F.collect_list(F.struct("distance", "id"))).alias("all"))
    own = F.array_position(F.transform("all", lambda x: x["id"]), F.col("id")) - 1
    others = F.slice(F.filter("all", lambda x, n: n != F.col("own")), 1, search.neighbours)
    answered = asking.join(splittable(lists), F.col("node") == F.col("query")).withColumn("own", own)
    return answered.select(F.col("id").alias("query_id"), F.posexplode(others).alias("place", "found")).select(
        "query_id", (F.col("place") + 1).alias("rank"), F.col("found.id").alias("vec_id"), F.sqrt("found.distance").alias("score")
    )
