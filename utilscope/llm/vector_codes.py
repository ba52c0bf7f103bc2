"""Product codes of vectors by memoised grid cells, all in whole numbers.

A vector is cut into parts, and each part is coded by the nearest entry of its own codebook.
The space of a part is cut into a grid of cells. An entry is dominated in a cell if another one
is nearer all over its box. The rival taken is the entry whose largest distance to the box is
least, and the test is the sign of the largest difference of the two distances over the box,
which holds wherever the entry's least distance exceeds the rival's largest. The entries that
are left are kept for the cell, by the hash of its coordinates; a part evaluates just those.

Codebooks are averaged over all rows in every round. A task adds its rows up and tells one sum
for each entry and component, so a round moves as much as the codebooks hold, whatever the
number of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utilscope.llm.shingles import mix
from utilscope.llm.storage import materialize, splittable
from utilscope.llm.vectors import matrix, scaled, usable_vectors

#: Scaled components of at most this size keep squared distances exact in 64 bits.
LIMIT = 1 << 28


@dataclass(frozen=True)
class Coding:
    """Parts of a vector, entries of a codebook (256 at most), rounds of averaging, scale of components.

    `cell` is the side of a grid cell in scaled units; a task remembers `cells` of them for each
    part and starts anew beyond that. Neither changes a result.
    """

    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096
    cell: int = 512
    cells: int = 1 << 14


class Cells:
    """Entries of one codebook (entries x components) that can be nearest in a cell, by cell."""

    def __init__(self, book: np.ndarray, side: int, most: int):
        self._book, self._side, self._most = book, side, most
        self._clear()

    def _clear(self) -> None:
        self._places: dict[int, int] = {}
        self._corners = np.zeros((0, self._book.shape[1]), np.int64)
        self._masks = np.zeros((0, len(self._book)), bool)

    def _undominated(self, cells: np.ndarray) -> np.ndarray:
        """Whether an entry may be nearest somewhere in the boxes (cells x entries)."""
        low = cells * self._side
        high = low + (self._side - 1)
        far = np.maximum(np.abs(low[:, None] - self._book), np.abs(high[:, None] - self._book))
        rival = self._book[(far * far).sum(2).argmin(1)][:, None]
        across = rival - self._book
        corner = np.where(across > 0, low[:, None], high[:, None])
        most = ((rival - corner) ** 2 - (self._book - corner) ** 2).sum(2)
        return most >= 0

    def candidates(self, points: np.ndarray) -> np.ndarray:
        """Entries (points x entries) that a point has to be compared with."""
        cells = points // self._side
        hashed = np.zeros(len(points), np.uint64)
        for axis in range(cells.shape[1]):
            hashed = mix(hashed ^ cells[:, axis].view(np.uint64), 41)
        keys, first, cell = np.unique(hashed, return_index=True, return_inverse=True)
        if len(self._places) + len(keys) > self._most:
            self._clear()
        new = [n for n, key in enumerate(keys.tolist()) if key not in self._places]
        if new:
            known = len(self._places)
            self._places |= {int(keys[n]): known + k for k, n in enumerate(new)}
            added = cells[first[new]]
            masks = [self._undominated(part) for part in np.array_split(added, len(new) // 1024 + 1)]
            self._corners, self._masks = np.concatenate([self._corners, added]), np.concatenate([self._masks, *masks])
        place = np.array([self._places[key] for key in keys.tolist()], np.int64)[cell.ravel()]
        # A point whose cell shares its hash with another cell is compared with all entries.
        return self._masks[place] | (self._corners[place] != cells).any(1, keepdims=True)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of every point's nearest entry; ties go to the lower index."""
        point, entry = np.nonzero(self.candidates(points))
        apart = points[point] - self._book[entry]
        distance = np.einsum("ij,ij->i", apart, apart)
        starts = np.searchsorted(point, np.arange(len(points)))
        least = np.minimum.reduceat(distance, starts)
        hits = np.flatnonzero(distance == least[point])
        return entry[hits[np.searchsorted(point[hits], np.arange(len(points)))]], least


def _coded(
    batches: Iterator[pa.RecordBatch], books: np.ndarray, coding: Coding
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches with their parts (rows x parts x components), indexes and squared distances (rows x parts)."""
    cells = [Cells(book, coding.cell, coding.cells) for book in books]
    for batch in batches:
        if batch.num_rows:
            parts = _parts(matrix(batch), coding)
            nearest = [c.nearest(parts[:, p]) for p, c in enumerate(cells)]
            yield batch, parts, np.stack([n[0] for n in nearest], 1), np.stack([n[1] for n in nearest], 1)


def _parts(values: np.ndarray, coding: Coding) -> np.ndarray:
    """Scaled rows x parts x components; a length that the parts don't divide is filled up with zeros."""
    width = -(-values.shape[1] // coding.parts)
    whole = np.zeros((len(values), coding.parts * width), np.int64)
    whole[:, :values.shape[1]] = scaled(values, coding.scale, LIMIT)
    return whole.reshape(len(values), coding.parts, width)


def _sums(batches: Iterator[pa.RecordBatch], books: np.ndarray, coding: Coding) -> Iterator[pa.RecordBatch]:
    """place, total of a task's rows: sums by (part, entry, component), then counts by (part, entry)."""
    sums, counts = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
    for _, parts, index, _ in _coded(batches, books, coding):
        for p in range(len(books)):
            np.add.at(sums[p], index[:, p], parts[:, p])
            counts[p] += np.bincount(index[:, p], minlength=books.shape[1])
    totals = np.concatenate([sums.ravel(), counts.ravel()])
    told = np.flatnonzero(totals)
    yield pa.RecordBatch.from_arrays([pa.array(told), pa.array(totals[told])], ["place", "total"])


def averaged(rows: DataFrame, books: np.ndarray, coding: Coding) -> np.ndarray:
    """The codebooks after one round over all rows: floors of the mean parts, unused entries as they were."""
    told = rows.select("vector").mapInArrow(lambda batches: _sums(batches, books, coding), "place long, total long")
    found = told.groupBy("place").agg(F.sum("total").alias("total")).toArrow()
    totals = np.zeros(books.size + books.shape[0] * books.shape[1], np.int64)
    totals[found["place"].to_numpy()] = found["total"].to_numpy()
    sums, counts = totals[:books.size].reshape(books.shape), totals[books.size:].reshape(*books.shape[:2], 1)
    return np.where(counts > 0, sums // np.maximum(counts, 1), books)


def _codes(batches: Iterator[pa.RecordBatch], books: np.ndarray, coding: Coding) -> Iterator[pa.RecordBatch]:
    digits = np.array([f"{n:02x}" for n in range(256)], object)
    for batch, _, index, distance in _coded(batches, books, coding):
        codes = pa.array(["".join(row) for row in digits[index]], pa.string())
        columns = [batch.column("id"), batch.column("label"), codes, pa.array(distance.sum(1))]
        yield pa.RecordBatch.from_arrays(columns, ["id", "label", "code", "error"])


def fitted_codebooks(rows: DataFrame, coding: Coding) -> np.ndarray:
    """Codebooks (parts x entries x components) of written rows `id`, `vector` after all rounds.

    They start as the parts of the rows of the smallest ids (ties: the smaller vector; NULL last).
    """
    first = rows.select("id", "vector").orderBy(F.asc_nulls_last("id"), "vector").limit(coding.entries).toArrow()
    start = matrix(pa.RecordBatch.from_arrays([first["vector"].combine_chunks()], ["vector"]))
    books = np.ascontiguousarray(_parts(start, coding).transpose(1, 0, 2))
    for _ in range(coding.rounds):
        books = averaged(rows, books, coding)
    return books


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode_vectors(
    vectors: DataFrame, coding: Coding = Coding(), id: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """`id`, `code`, `error`, `label_error`, `codebooks_sha256` of every row with a usable vector.

    Rows with a NULL or empty vector or one with a NULL or non-finite component are dropped, and
    so are vectors of another length than most rows have. A length that the parts don't divide is
    filled up with zeros. Repeated rows are rows of their own; NULL ids come after all others in the
    choice of first entries, NULL labels are one label. A table without usable rows gives no rows.
    A component beyond +-2**28 / scale stops the job, since distances would not be exact. Further
    columns of `vectors` are ignored, whatever their names.
    """
    columns = {"id": f"cast(`{id}` as long)", "label": f"`{label}`"}
    rows, length = usable_vectors(vectors, columns, vector)
    kind = rows.schema["label"].dataType.simpleString()
    schema = f"id long, label {kind}, code string, error long"
    if length:
        books = fitted_codebooks(rows, coding)
        coded = materialize(rows.mapInArrow(lambda batches: _codes(batches, books, coding), schema))
        digest = books_digest(books)
    else:
        coded, digest = rows.sparkSession.createDataFrame([], schema), ""
    errors = splittable(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    joined = coded.join(errors, F.col("label").eqNullSafe(F.col("of")))
    return joined.select(
        F.col("id").alias(id), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
