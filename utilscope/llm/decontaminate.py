"""Benchmark passages in documents by the q-gram lemma and banded alignment.

Texts are compared as bytes of their normal form: lower case, every run of ASCII characters
other than letters and digits one space. An item of m bytes that occurs with k edits at most
shares m + 1 - q * (k + 1) of its q-grams with the place, all on diagonals (place in the text
minus place in the item) at most k apart. So the shared q-grams are counted in bands of
2 * (k + 1) diagonals that overlap by half; bands that reach the bound are kept and verified by
an alignment of the whole item inside the band.

Items are taken in blocks of bounded size and every document is scanned for each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utilscope.llm.shingles import _power_tables, mix, utf8
from utilscope.llm.storage import materialize, splittable

CHUNK_BYTES = 1 << 18
SLOTS = 22
#: Shared q-grams that are taken at once.
SLICE = 1 << 18


@dataclass(frozen=True)
class Budget:
    """Edits allowed: `percent` of an item's bytes, as long as the lemma still asks for a q-gram."""

    q: int = 10
    percent: int = 8
    #: Bytes of item texts in one block, about; its index takes some 40 times as much.
    block_bytes: int = 2_000_000

    def edits(self, m: int) -> int:
        return max(0, min(m * self.percent // 100, m // self.q - 1))

    def shared(self, m: int) -> int:
        return m + 1 - self.q * (self.edits(m) + 1)


def _byte_map() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    for b in range(128):
        c = chr(b)
        table[b] = ord(c.lower()) if c.isalnum() else 0x20
    return table


_MAP = _byte_map()
_GRAM_VALUES = mix(np.arange(1, 257, dtype=np.uint64), seed=9)


def normal_rows(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normal form of consecutive rows (already in lower case beyond ASCII), and their new starts."""
    mapped = _MAP[data]
    space = mapped == 0x20
    keep = np.ones(len(mapped), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    heads = starts[:-1][starts[:-1] < starts[1:]]
    keep[heads] = ~space[heads]  # no space in front
    # A space kept at the start of a run inside a row whose front was dropped stays dropped.
    lead = space.copy()
    if len(heads):
        first_word = np.minimum.reduceat(np.where(space, len(mapped), np.arange(len(mapped))), heads)
        ends = np.append(heads[1:], len(mapped))
        marks = np.zeros(len(mapped) + 1, np.int32)
        np.add.at(marks, heads, 1)
        np.add.at(marks, np.minimum(first_word, ends), -1)
        lead = np.cumsum(marks[:-1]) > 0
    keep &= ~(space & lead)
    kept = np.concatenate([[0], np.cumsum(keep)])
    return mapped[keep], kept[starts]


def gram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q bytes from every place that has as many behind it."""
    if len(data) < q:
        return np.zeros(0, np.uint64)
    powers, inverses = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_GRAM_VALUES[data] * powers[:len(data)], out=sums[1:])
    hashes = (sums[q:] - sums[:-q]) * inverses[:len(data) - q + 1]
    return hashes * np.uint64(0x9E3779B97F4A7C15)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers, ascending, and how often each occurs; by a plain array where they lie close."""
    low, high = int(keys.min()), int(keys.max())
    if high - low > 4 * len(keys):
        return np.unique(keys, return_counts=True)
    counts = np.bincount(keys - low)
    met = np.flatnonzero(counts)
    return met + low, counts[met]


def _added(keys: np.ndarray, counts: np.ndarray, more: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two tables of ascending numbers and counts as one."""
    if not len(keys):
        return more, often
    both, place = np.unique(np.concatenate([keys, more]), return_inverse=True)
    total = np.zeros(len(both), np.int64)
    np.add.at(total, place.ravel(), np.concatenate([counts, often]))
    return both, total


class Index:
    """q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, str]], budget: Budget):
        self.budget, self.ids, self.texts = budget, [], []
        self.short: list[tuple[int, bytes]] = []
        hashes, owners, places = [], [], []
        for item_id, text in items:
            raw = np.frombuffer((text or "").lower().encode(), np.uint8)
            normal, _ = normal_rows(raw, np.array([0, len(raw)]))
            data = normal.tobytes().rstrip(b" ")
            if len(data) < budget.q:
                if data:
                    self.short.append((item_id, data))
                continue
            grams = gram_hashes(np.frombuffer(data, np.uint8), budget.q)
            hashes.append(grams)
            owners.append(np.full(len(grams), len(self.ids)))
            places.append(np.arange(len(grams)))
            self.ids.append(item_id)
            self.texts.append(data)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        all_hashes = join(hashes, np.uint64)
        order = np.argsort(all_hashes, kind="stable")
        self.hashes = all_hashes[order]
        self.owners, self.places = join(owners, np.int64)[order], join(places, np.int64)[order]
        self.known = np.zeros(1 << SLOTS, bool)
        self.known[self.hashes >> np.uint64(64 - SLOTS)] = True
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.bands = np.array([budget.edits(m) + 1 for m in self.sizes], np.int64)
        self.needed = np.array([budget.shared(m) for m in self.sizes], np.int64)

    def regions(self, data: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
        """(row, item, band) that hold as many shared q-grams as the lemma asks for.

        Shared q-grams are taken in slices of bounded size and added up by band. Places ascend, so a
        band that lies behind the slice is done: it is held against its bound and forgotten. What is
        held at once is a slice and the bands that an item's length spans, however often a text repeats.
        """
        if not len(self.hashes):
            return []
        # A key is a (row, item, band) as one number; bands may be as low as minus an item's length.
        below = int(self.sizes.max()) + 2
        span = int(np.diff(starts).max()) + 2 * below
        good, keys, counts = [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        for part in range(0, len(data), CHUNK_BYTES):
            for key, row, here in self._shared(data, starts, part, span, below):
                keys, counts = _added(keys, counts, *_counted(np.concatenate([key, key - 1])))
                if len(keys) > SLICE:
                    of_row, of_item, band = self._parts(keys, span, below)
                    done = (of_row < row) | ((band + 2) * self.bands[of_item] + self.sizes[of_item] < here)
                    good.append(keys[done & (counts >= self.needed[of_item])])
                    keys, counts = keys[~done], counts[~done]
        good.append(keys[counts >= self.needed[self._parts(keys, span, below)[1]]])
        return list(zip(*(part.tolist() for part in self._parts(np.sort(np.concatenate(good)), span, below))))

    def _shared(self, data: np.ndarray, starts: np.ndarray, begin: int, span: int, below: int):
        """Keys of the q-grams shared from the bytes of one stretch on, by slices; row and place that each ends with."""
        hashes = gram_hashes(data[begin:begin + CHUNK_BYTES + self.budget.q - 1], self.budget.q)
        at = np.flatnonzero(self.known[hashes >> np.uint64(64 - SLOTS)])
        first = np.searchsorted(self.hashes, hashes[at])
        many = np.searchsorted(self.hashes, hashes[at], side="right") - first
        at += begin
        row = np.searchsorted(starts, at, side="right") - 1
        found = (many > 0) & (at + self.budget.q <= starts[row + 1])
        at, first, row, many = at[found], first[found], row[found], many[found]
        upto = np.cumsum(many)
        for low in range(0, int(upto[-1]) if len(upto) else 0, SLICE):
            place = np.arange(low, min(low + SLICE, int(upto[-1])))
            gram = np.searchsorted(upto, place, side="right")
            posting = first[gram] + place - (upto[gram] - many[gram])
            item = self.owners[posting]
            diagonal = at[gram] - starts[row[gram]] - self.places[posting]
            key = (row[gram] * len(self.texts) + item) * span + diagonal // self.bands[item] + below
            yield key, row[gram[-1]], at[gram[-1]] - starts[row[gram[-1]]]

    def _parts(self, keys: np.ndarray, span: int, below: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, item and band of keys."""
        pair, band = np.divmod(keys, span)
        return *np.divmod(pair, len(self.texts)), band - below

    def matches(self, data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item id, edits, start, end): the best place of each item in each row."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for row, item, band in self.regions(data, starts):
            k = int(self.bands[item]) - 1
            if best.get((row, item), (k + 1,))[0] == 0:
                continue
            text = data[starts[row]:starts[row + 1]]
            low = max(0, band * (k + 1) - k)
            high = min(len(text), band * (k + 1) + 2 * (k + 1) + len(self.texts[item]) + k)
            found = align(self.texts[item], text[low:high].tobytes(), k)
            if found is not None:
                edits, start, end = found
                entry = (edits, start + low, end + low)
                best[row, item] = min(best.get((row, item), entry), entry)
        for (row, item), entry in best.items():
            yield row, self.ids[item], *entry
        for item_id, data_of in self.short:
            padded = b" " + data_of + b" "
            for row in range(len(starts) - 1):
                place = (b" " + data[starts[row]:starts[row + 1]].tobytes() + b" ").find(padded)
                if place >= 0:
                    yield row, item_id, 0, place, place + len(data_of)


def _last_row(pattern: np.ndarray, text: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Edits of the whole pattern against text ending behind each offset; one band of diagonals.

    `first` are the costs of starting at each offset. Column o of row i stands for text[:i + o].
    """
    offsets = np.arange(len(first))
    far = np.int64(1 << 30)
    costs = np.minimum.accumulate(first - offsets) + offsets
    padded = np.concatenate([text.astype(np.int16), np.full(max(0, len(pattern) + len(first) - len(text)), -1, np.int16)])
    limit = len(text)
    for i, c in enumerate(pattern):
        window = padded[i:i + len(first)]
        changed = np.where(window < 0, far, costs + (window != c))
        skipped = np.append(costs[1:], far) + 1
        costs = np.minimum(changed, skipped)
        costs = np.minimum.accumulate(costs - offsets) + offsets
        costs[offsets + i + 1 > limit] = far
    return costs


def align(pattern: bytes, text: bytes, k: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of the whole pattern in the text, within k edits."""
    place = text.find(pattern)
    if place >= 0:
        return 0, place, place + len(pattern)
    if k == 0 or len(text) < len(pattern) - k:
        return None
    p, t = np.frombuffer(pattern, np.uint8), np.frombuffer(text, np.uint8)
    # Rows may also lag behind: the text is set off by k so that ends before len(pattern) fit.
    lead = np.concatenate([np.full(k, 0, np.uint8), t])
    width = max(1, len(lead) - len(pattern) + k + 1)
    first = np.zeros(width, np.int64)
    costs = _last_row(p, lead, first)
    end = int(np.argmin(costs))
    edits = int(costs[end])
    if edits > k:
        return None
    stop = min(len(t), max(0, end + len(pattern) - k))
    back = t[:stop][::-1]
    start_costs = _last_row(p[::-1], np.concatenate([np.full(k, 0, np.uint8), back]),
                            np.concatenate([np.arange(k, -1, -1), np.arange(1, k + 1)]).astype(np.int64))
    offset = int(np.argmin(start_costs))
    start = max(0, stop - (offset + len(pattern) - k))
    return edits, start, stop


def _scan(column: pa.Array, index: Index) -> Iterator[tuple[int, int, int, int, int]]:
    offsets, data = utf8(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        last = int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, side="right")) - 1
        last = min(max(last, row + 1), n)
        part = data[offsets[row]:offsets[last]]
        normal, starts = normal_rows(part, offsets[row:last + 1] - offsets[row])
        for found in index.matches(normal, starts):
            yield row + found[0], *found[1:]
        row = last


def folded_items(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(`key`, `text`) of each distinct text, and (`key`, `item`) of each row; NULL and empty texts are no items."""
    rows = benchmark.select(F.col(item).cast("long").alias("item"), F.col(text).cast("string").alias("text"))
    rows = rows.where(F.length("text") > 0)
    texts = materialize(rows.select("text").distinct().withColumn("key", F.monotonically_increasing_id()))
    return texts.select("key", "text"), rows.join(texts, "text").select("key", "item")


def item_blocks(items: DataFrame, budget: Budget) -> Iterator[Broadcast]:
    """Broadcast indexes of the items, block by block.

    `items` are those of `folded_items`, no two of them equal, so their hashes deal them evenly: blocks
    are of half the size asked for on average. A block holds one item at least, whatever its length.
    """
    total = items.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    blocks = max(1, -(-2 * total // budget.block_bytes))
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block)
        items_of = [(r["key"], r["text"]) for r in own.collect()]
        if items_of:
            yield items.sparkSession.sparkContext.broadcast(Index(items_of, budget))


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, budget: Budget = Budget(), id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """`id`, `item_id`, `edits`, `start`, `end`: the best place of every item in every document.

    Places are bytes of the document's normal form. Items whose normal form is shorter than q
    must stand as whole words, without edits; empty and NULL items and documents match nothing.
    Repeated documents (also of one id) and repeated items have rows of their own: equal items are
    searched for once, and the places found get the ids of all of them by a join. Other columns are not
    read. Whole texts are scanned; only what was found is shuffled.
    """
    rows = docs.select(F.col(id).cast("long").alias("id"), F.lower(F.col(text).cast("string")).alias("text"))
    schema = "id long, key long, edits int, start long, end long"
    items, known = folded_items(benchmark)

    def leaks(batches: Iterator[pa.RecordBatch], index: Broadcast) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_scan(batch.column(1), index.value))
            if found:
                rows, item, edits, start, end = (np.array(c) for c in zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(list(item), pa.int64()),
                     pa.array(edits.astype(np.int32)), pa.array(start.astype(np.int64)), pa.array(end.astype(np.int64))],
                    ["id", "key", "edits", "start", "end"],
                )

    out = None
    for block in item_blocks(items, budget):
        part = rows.mapInArrow(lambda batches, block=block: leaks(batches, block), schema)
        out = part if out is None else out.unionAll(part)
    if out is None:
        out = rows.limit(0).selectExpr("id", "0L key", "0 edits", "0L start", "0L end")
    named = out.join(splittable(known), "key")
    return named.select(F.col("id").alias(id), F.col("item").alias("item_id"), "edits", "start", "end")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, budget: Budget = Budget(), text: str = "text") -> DataFrame:
    """The rows of `docs`, all their columns, whose text holds no item. Nothing of `docs` is shuffled.

    Each row stays or goes for itself, repeated ones too. NULL and empty texts hold no item, NULL and
    empty items are held by no text; an empty table stays empty. Columns keep their names, whatever they are.
    """
    def clean(batches: Iterator[pa.RecordBatch], index: Broadcast) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[row for row, *_ in _scan(batch.column(batch.num_columns - 1), index.value)]] = False
            kept = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays(kept.columns[:-1], kept.schema.names[:-1])

    lower = "lower"
    while lower in docs.columns:
        lower += "_"
    for block in item_blocks(folded_items(benchmark)[0], budget):
        lowered = docs.select("*", F.lower(F.col(text).cast("string")).alias(lower))
        docs = lowered.mapInArrow(lambda batches, block=block: clean(batches, block), docs.schema)
    return docs
