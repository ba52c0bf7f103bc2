"""Whitening of vectors along their leading components, found by slicing the spectrum.

Components are scaled to whole numbers, so counts, sums and products over all rows are exact,
whatever the order of tasks: a task adds up its rows and tells a number for each pair of
dimensions. The covariance is divided out once, from whole numbers.

How many eigenvalues lie above a shift is the number of positive pivots of the LDL' factors of
the shifted covariance (law of inertia). Shifts are halved until an interval holds one
eigenvalue; Rayleigh quotient iteration, which converges cubically, then finds it with its
vector, and counts just below and above it certify its number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utilscope.llm.storage import materialize
from utilscope.llm.vectors import matrix, scaled, usable_vectors

#: Scaled components of at most this size can be multiplied exactly in two halves of 20 bits.
LIMIT = 1 << 38
_HALF = 20
_EPSILON = float(np.finfo(float).eps)


@dataclass(frozen=True)
class Whitening:
    """Components to return; scale and offset that make whole numbers of the vectors' components."""

    components: int = 8
    scale: int = 1024
    offset: int = 100_000


def positive_pivots(symmetric: np.ndarray) -> int:
    """Number of positive eigenvalues, by LDL' factors with pivots of one or two rows."""
    a = np.array(symmetric, float)
    positive = 0
    while len(a):
        diagonal, rest = np.abs(np.diagonal(a)), np.abs(np.tril(a, -1))
        one = int(diagonal.argmax())
        row, column = np.unravel_index(rest.argmax(), rest.shape)
        if diagonal[one] == 0 and rest[row, column] == 0:
            break
        if diagonal[one] >= (1 + 17**0.5) / 8 * rest[row, column]:
            pivots = [one]
            positive += bool(a[one, one] > 0)
        else:  # a pivot of two rows has one positive and one negative eigenvalue
            pivots = [int(column), int(row)]
            positive += 1
        others = np.delete(np.arange(len(a)), pivots)
        beside = a[np.ix_(others, pivots)]
        a = a[np.ix_(others, others)] - beside @ np.linalg.solve(a[np.ix_(pivots, pivots)], beside.T)
        a = (a + a.T) / 2
    return positive


class Spectrum:
    """Eigenvalues of a symmetric matrix without negative ones, numbered from 1 by falling value."""

    def __init__(self, symmetric: np.ndarray):
        self._a = symmetric
        self._unit = np.eye(len(symmetric))
        self._bound = float(np.abs(symmetric).sum(1).max()) * (1 + 8 * _EPSILON)
        #: Shifts and values closer than this are not told apart.
        self.tolerance = 8 * _EPSILON * self._bound
        self._counts = {-self.tolerance: len(symmetric), self._bound + self.tolerance: 0}

    def above(self, shift: float) -> int:
        """Number of eigenvalues above a shift."""
        if shift not in self._counts:
            self._counts[shift] = positive_pivots(self._a - shift * self._unit)
        return self._counts[shift]

    def interval(self, number: int) -> tuple[float, float]:
        """The narrowest interval known so far that holds the eigenvalue of this number."""
        low = max(s for s, n in self._counts.items() if n >= number)
        return low, min(s for s, n in self._counts.items() if n < number and s > low)

    def halve(self, number: int) -> tuple[float, float]:
        low, high = self.interval(number)
        self.above((low + high) / 2)
        return self.interval(number)

    def isolated(self, number: int) -> tuple[float, float]:
        """An interval that holds the eigenvalue alone, or one too narrow to be halved."""
        low, high = self.interval(number)
        while self.above(low) - self.above(high) > 1 and high - low > self.tolerance:
            low, high = self.halve(number)
        return low, high

    def pair(self, number: int, found: np.ndarray) -> tuple[float, np.ndarray]:
        """The eigenvalue of this number and a unit vector, orthogonal to the columns of `found`."""
        low, high = self.isolated(number)
        while True:
            value, vector = self._iterated((low + high) / 2, found)
            if low - self.tolerance <= value <= high + self.tolerance or high - low <= self.tolerance:
                break
            low, high = self.halve(number)
        margin = 4 * self.tolerance
        if not self.above(value + margin) < number <= self.above(value - margin):
            raise ArithmeticError(f"eigenvalue {number} is not certified by the counts")
        return value, vector

    def _iterated(self, shift: float, found: np.ndarray) -> tuple[float, np.ndarray]:
        """Rayleigh quotient iteration after two steps with the shift as it is."""
        vector = np.random.default_rng(len(found.T)).normal(size=len(self._a))
        for step in range(40):
            shifted = self._a - shift * self._unit
            try:
                vector = np.linalg.solve(shifted, vector)
            except np.linalg.LinAlgError:
                vector = np.linalg.solve(shifted + self.tolerance * self._unit, vector)
            for _ in range(2):
                vector = vector / np.linalg.norm(vector)
                vector = vector - found @ (found.T @ vector)
            vector /= np.linalg.norm(vector)
            value = float(vector @ self._a @ vector)
            if step > 1:
                if np.linalg.norm(self._a @ vector - value * vector) <= self.tolerance:
                    break
                shift = value
        return value, vector


def leading_pairs(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit vectors (as columns), `most` at most.

    Eigenvalues that rounding can't tell from zero are left out. Of equal eigenvalues any
    orthonormal vectors are returned. A vector's largest entry is positive.
    """
    spectrum = Spectrum(covariance)
    noise = len(covariance) * spectrum.tolerance
    values, vectors = [], np.zeros((len(covariance), 0))
    while len(values) < min(most, spectrum.above(noise)):
        value, vector = spectrum.pair(len(values) + 1, vectors)
        vector *= np.sign(vector[np.abs(vector).argmax()])
        values.append(value)
        vectors = np.column_stack([vectors, vector])
    return np.array(values), vectors


def _whole(batch: pa.RecordBatch, settings: Whitening) -> np.ndarray:
    return scaled(matrix(batch), settings.scale, LIMIT) + settings.offset


def _sums(batches: Iterator[pa.RecordBatch], settings: Whitening, length: int) -> Iterator[pa.RecordBatch]:
    """place, total: rows at -1 and sums by dimension of a task's rows."""
    rows, sums = 0, np.zeros(length, object)
    for batch in batches:
        if batch.num_rows:
            rows += batch.num_rows
            sums += _whole(batch, settings).sum(0).astype(object)
    yield _told(np.arange(-1, length), [rows, *sums])


def _told(places: np.ndarray, totals: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(places), pa.array(totals, pa.decimal128(38, 0))], ["place", "total"])


def products(values: np.ndarray) -> np.ndarray:
    """Exact products of the columns of whole numbers below 2**39 in size, as Python integers.

    Doubles hold the sum of 4,096 products of numbers of 20 bits without rounding.
    """
    high = (values + (1 << (_HALF - 1))) >> _HALF
    low = values - (high << _HALF)
    total = np.zeros((values.shape[1], values.shape[1]), object)
    for part in range(0, len(values), 4096):
        a, b = high[part:part + 4096].astype(float), low[part:part + 4096].astype(float)
        total += (b.T @ b).astype(np.int64)
        if a.any():
            mixed = (a.T @ b).astype(np.int64).astype(object)
            total += ((a.T @ a).astype(np.int64).astype(object) << 2 * _HALF) + ((mixed + mixed.T) << _HALF)
    return total


def _products(batches: Iterator[pa.RecordBatch], settings: Whitening, centre: np.ndarray) -> Iterator[pa.RecordBatch]:
    """place, total: products of a task's centred dimensions, by place in the upper triangle."""
    total = np.zeros((len(centre), len(centre)), object)
    for batch in batches:
        if batch.num_rows:
            total += products(_whole(batch, settings) - centre)
    upper = total[np.triu_indices(len(centre))]
    yield _told(np.arange(len(upper)), list(upper))


def _added(rows: DataFrame, sums, places: int) -> list[int]:
    """The totals of all tasks by place, from place 0 on; place -1 comes last."""
    told = rows.mapInArrow(sums, "place long, total decimal(38,0)").groupBy("place").agg(F.sum("total").alias("total"))
    totals = [0] * places
    for place, total in told.collect():
        totals[place] = int(total)
    return totals


@dataclass(frozen=True)
class Fit:
    """Rows, exact sums by dimension, covariance, and leading eigenvalues with their vectors."""

    rows: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @property
    def centre(self) -> np.ndarray:
        """Whole numbers next to the means."""
        return np.array([(2 * s + self.rows) // (2 * self.rows) for s in self.sums], np.int64)


def fitted(rows: DataFrame, length: int, settings: Whitening) -> Fit:
    """Exact sums and centred products of all rows, and the leading eigenpairs of their covariance.

    Only numbers by dimension and by pair of dimensions come to the driver.
    """
    *sums, n = _added(rows, lambda batches: _sums(batches, settings, length), length + 1)
    fit = Fit(n, sums, np.zeros((0, 0)), np.zeros(0), np.zeros((0, 0)))
    centre = fit.centre
    upper = np.triu_indices(length)
    totals = _added(rows, lambda batches: _products(batches, settings, centre), len(upper[0]))
    left = [s - n * c for s, c in zip(sums, centre.tolist())]
    covariance = np.zeros((length, length))
    for i, j, total in zip(*(u.tolist() for u in upper), totals):
        covariance[i, j] = covariance[j, i] = (n * total - left[i] * left[j]) / (n * n)
    return Fit(n, sums, covariance, *leading_pairs(covariance, settings.components))


def _whitened(batches: Iterator[pa.RecordBatch], settings: Whitening, fit: Fit) -> Iterator[pa.RecordBatch]:
    """id, exact deviation and whitened components of every row."""
    centre, n = fit.centre, fit.rows
    left = np.array([s - n * c for s, c in zip(fit.sums, centre.tolist())], object)
    beside = (left / n).astype(float)
    axes = fit.vectors / np.sqrt(fit.values)
    small = 1 << 24
    for batch in batches:
        if not batch.num_rows:
            continue
        values = _whole(batch, settings) - centre
        if np.abs(values).max() < small and np.abs(left).max() < small << 8:
            squares, crossed = (values * values).sum(1).astype(object), (values @ left.astype(np.int64)).astype(object)
        else:
            whole = values.astype(object)
            squares, crossed = (whole * whole).sum(1), whole @ left
        deviation = squares * (n * n) - crossed * (2 * n) + (left * left).sum()
        whitened = (values - beside) @ axes
        offsets = pa.array(np.arange(len(whitened) + 1, dtype=np.int32) * whitened.shape[1])
        yield pa.RecordBatch.from_arrays([
            batch.column("id"), pa.array(list(deviation), pa.decimal128(38, 0)),
            pa.ListArray.from_arrays(offsets, pa.array(whitened.ravel())),
        ], ["id", "deviation", "whitened"])


def identity_error(whitened: DataFrame, size: int) -> float:
    """The largest entry of the covariance of the whitened rows less the identity, measured over all rows."""
    value = [F.col("whitened")[k] for k in range(size)]
    means = whitened.agg(*[F.avg(v) for v in value]).first()
    centred = [v - F.lit(m) for v, m in zip(value, means)]
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    found = whitened.agg(*[F.avg(centred[i] * centred[j]) for i, j in pairs]).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(found, pairs))


def whiten(vectors: DataFrame, settings: Whitening = Whitening(), id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each usable row and component: `id`, `component` (from 1), `n`, `deviation`, `whitened`, `explained`, `identity_error`.

    `deviation` is the exact squared distance of a row's whole numbers, times `n`, from their sums, as
    decimal(38,0). Rows with a NULL or empty vector or one with a NULL or non-finite component are
    dropped, and so are vectors of another length than most rows have. Repeated rows, NULL ids
    included, are rows of their own. A component whose variance rounding can't tell from zero can't be
    whitened and is not returned, so equal rows, a single row and an empty table give no rows.
    A component beyond +-2**38 / scale stops the job, since sums would not be exact. Further columns of
    `vectors` are ignored, whatever their names. The work in the driver is that of a square
    matrix of the vectors' length.
    """
    rows, length = usable_vectors(vectors, {"id": f"cast(`{id}` as long)"}, vector)
    schema = "id long, deviation decimal(38,0), whitened array<double>"
    fit = fitted(rows, length, settings) if length else None
    if fit is None or not len(fit.values):
        whitened, n, error, shares = rows.sparkSession.createDataFrame([], schema), 0, 0.0, [0.0]
    else:
        whitened = materialize(rows.mapInArrow(lambda batches: _whitened(batches, settings, fit), schema))
        n, error = fit.rows, identity_error(whitened, len(fit.values))
        shares = (fit.values / np.trace(fit.covariance)).tolist()
    explained = F.array(*map(F.lit, shares))
    return whitened.select("id", "deviation", F.posexplode("whitened").alias("place", "value")).select(
        F.col("id").alias(id), (F.col("place") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.col("value").alias("whitened"), explained[F.col("place")].alias("explained"), F.lit(error).alias("identity_error"),
    )
