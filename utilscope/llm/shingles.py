"""Word shingles of Arrow text columns as 64-bit hashes, vectorised over the UTF-8 bytes.

A word is a run of bytes other than space and \\x09-\\x0D; A-Z count as a-z. Word and shingle
hashes do not depend on the place in the buffer, the batch or the machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values; another seed gives an unrelated order."""
    x = x ^ np.uint64((seed * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64), seed=7)
    values[0x41:0x5B] = values[0x61:0x7B]
    values[_SEPARATOR] = 0
    return values


_VALUES = _byte_values()
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n + 1 of each."""
    global _powers
    if len(_powers[0]) <= n:
        size = 1 << (n + 1).bit_length()
        tables = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _powers = tuple(tables)
    return _powers


@dataclass
class Sets:
    """Distinct shingles of consecutive rows: row r's are hashes[starts[r]:starts[r + 1]], ascending."""

    first_row: int
    starts: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), self.counts)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets and bytes of a text column; NULL counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return offsets, data


def _word_hashes(data: np.ndarray, row_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the index of each row's first word (with the total at the end)."""
    inside = ~_SEPARATOR[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = row_starts[row_starts < len(data)]
    begins[heads] = inside[heads]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    tails = heads[heads > 0] - 1
    ends[tails] = inside[tails]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    powers, inverses = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * powers[:len(data)], out=sums[1:])
    words = mix((sums[end] - sums[begin]) * inverses[begin])
    return words, np.searchsorted(begin, row_starts)


def _shingles(words: np.ndarray, first_word: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every shingle; a row of fewer than k words has one, a row of none has none."""
    per_row = np.diff(first_word)
    made = np.where(per_row >= k, per_row - k + 1, np.minimum(per_row, 1))
    rows = np.repeat(np.arange(len(per_row)), made)
    at = np.arange(len(rows)) - np.repeat(np.cumsum(made) - made, made) + first_word[:-1][rows]
    left = first_word[1:][rows] - at
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    total = np.minimum(left, k).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    factors = mix(np.arange(1, k + 1, dtype=np.uint64), seed=3) | np.uint64(1)
    for j in range(k):
        total += np.where(left > j, padded[at + j], np.uint64(0)) * factors[j]
    return rows, mix(total, seed=1)


def shingle_sets(column: pa.Array, k: int, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Sets]:
    """The shingle sets of all rows, some rows at a time; a longer row makes a chunk of its own."""
    offsets, data = utf8(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        last = int(np.searchsorted(offsets, offsets[row] + chunk_bytes, side="right")) - 1
        last = min(max(last, row + 1), n)
        part = data[offsets[row]:offsets[last]]
        words, first_word = _word_hashes(part, offsets[row:last + 1] - offsets[row])
        rows, hashes = _shingles(words, first_word, k)
        order = np.lexsort((hashes, rows))
        rows, hashes = rows[order], hashes[order]
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
        rows, hashes = rows[fresh], hashes[fresh]
        yield Sets(row, np.searchsorted(rows, np.arange(last - row + 1)), hashes)
        row = last
