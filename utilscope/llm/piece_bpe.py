"""Merge-type SentencePiece encoding by a score-ordered agenda, checked against the library.

A text's spaces become the space mark, one mark is put in front, and characters are the first
symbols. Every adjacent pair that forms a piece waits in an agenda; the pair of the highest
score (the leftmost among equals) is merged, and its new neighbours join the agenda. Symbols
that are no piece fall back to byte pieces.

No merge can join two characters that never stand side by side inside a piece, so a text falls
into independent parts there, and the ids of a part can be kept for its next occurrence. In
particular, where no piece has a space mark behind another character, the words of a text with
the marks before them are independent; such words are the units that are kept and checked.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Units and parts of units whose ids a worker keeps, twice: those met lately, and those before them.
KEPT_UNITS, KEPT_PARTS = 120_000, 50_000  # some 70 MB
#: Parts up to this length keep their agenda in a list, which is quicker than a heap there.
SHORT = 40
#: The rank of a pair that forms no piece; bits of a symbol in a pair.
NEVER, SHIFT = 1 << 60, 24
LOW = (1 << SHIFT) - 1
#: Characters of a batch of texts that are encoded and checked at once; a longer text is a batch.
BATCH_CHARS = 500_000
# Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGE_MODEL = 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        size = varint() if size is None else size
        yield tag >> 3, data[at:at + size]
        at += size


class PieceBpe:
    """Vocabulary and agenda of one merge-type model file."""

    def __init__(self, model_file: str, kept_units: int | None = None):
        pieces, trainer, normalizer = [], {}, {}
        for number, value in _fields(Path(model_file).read_bytes()):
            if number == 1:
                piece = dict(_fields(value))
                score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                pieces.append((piece[1].decode("utf-8"), score, piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        kinds = {kind for _, _, kind in pieces}
        plain = normalizer.get(1) == b"identity" and not normalizer.get(2) and not normalizer.get(4, 1)
        if trainer.get(3) != MERGE_MODEL or kinds & {USER_DEFINED, UNUSED} or not plain:
            raise ValueError("a merge-type model with the identity normalizer and plain pieces is needed")
        self.front = MARK if normalizer.get(3, 1) else ""
        normal = [(p, score, i) for i, (p, score, kind) in enumerate(pieces) if kind == NORMAL]
        self.ids = {p: i for p, _, i in normal}
        # Symbols are pieces, and characters that are no piece but occur in some.
        letters = sorted({c for p in self.ids for c in p} - set(self.ids))
        symbol = {**self.ids, **{c: len(pieces) + i for i, c in enumerate(letters)}}
        self.symbols = {c: symbol[c] for c in symbol if len(c) == 1}
        self.plain, self.letters = len(pieces), letters
        order = {score: rank for rank, score in enumerate(sorted({score for _, score, _ in normal}, reverse=True))}
        #: (left symbol, right symbol) -> rank and symbol of the piece that they form.
        self.merges = {
            symbol[p[:k]] << SHIFT | symbol[p[k:]]: order[score] << SHIFT | i
            for p, score, i in normal for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol
        }
        pieces_of = Counter(score for _, score, _ in normal)
        #: Where ranks begin that several pieces share.
        self.tied = min((order[score] for score, n in pieces_of.items() if n > 1), default=NEVER >> SHIFT) << SHIFT
        self.unknown = next(i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.neighbours = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        whole_words = all(MARK not in p.lstrip(MARK) for p in self.ids)
        self.units = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if whole_words else r"(?s).+")
        self.fresh: list[str] = []  # units encoded since they were last checked
        units = kept_units or KEPT_UNITS
        self.kept: dict[str, bytes] = _Kept(self._unit, units)
        self._parts: dict[str, bytes] = _Kept(self._part, max(1, units * KEPT_PARTS // KEPT_UNITS))

    def _fallback(self, symbol: int) -> list[int]:
        """Byte pieces of a character that is no piece."""
        if not self.bytes:
            return [self.unknown]
        character = chr(-1 - symbol) if symbol < 0 else self.letters[symbol - self.plain]
        return [self.bytes[b] for b in character.encode("utf-8")]

    def _merged(self, part: str) -> list[int]:
        """Ids of a part: its symbols after all merges, with byte pieces for those that are no piece."""
        known = self.symbols
        symbols = [known[c] if c in known else -1 - ord(c) for c in part]
        symbols = self._short(symbols) if len(part) <= SHORT else self._long(symbols)
        if min(symbols) >= 0 and max(symbols) < self.plain:
            return symbols
        return [i for s in symbols for i in ([s] if 0 <= s < self.plain else self._fallback(s))]

    def _short(self, symbols: list[int]) -> list[int]:
        """Symbols after all merges; the agenda is the list of the pairs' ranks."""
        get = self.merges.get
        agenda = [get(a << SHIFT | b, NEVER) for a, b in zip(symbols, symbols[1:])]
        while agenda:
            best = min(agenda)
            if best == NEVER:
                break
            if best >= self.tied:  # the leftmost among equal ranks
                best = next(pair for pair in agenda if pair >> SHIFT == best >> SHIFT)
            i = agenda.index(best)
            piece = symbols[i] = best & LOW
            del symbols[i + 1], agenda[i]
            if i < len(agenda):
                agenda[i] = get(piece << SHIFT | symbols[i + 1], NEVER)
            if i:
                agenda[i - 1] = get(symbols[i - 1] << SHIFT | piece, NEVER)
        return symbols

    def _long(self, symbols: list[int]) -> list[int]:
        """Symbols after all merges; the agenda is a heap of (rank of the piece, place) in one integer."""
        get, n = self.merges.get, len(symbols)
        shift = n.bit_length()
        low = (1 << shift) - 1
        pairs = [get(a << SHIFT | b, NEVER) for a, b in zip(symbols, symbols[1:])]
        agenda = [pair >> SHIFT << shift | i for i, pair in enumerate(pairs) if pair != NEVER]
        heapq.heapify(agenda)
        following, preceding, gone = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)
        while agenda:
            entry = heapq.heappop(agenda)
            i = entry & low
            j = following[i]
            if gone[i] or j == n:
                continue
            pair = get(symbols[i] << SHIFT | symbols[j], NEVER)
            if pair >> SHIFT != entry >> shift:
                continue  # one of the two has been merged since
            piece = symbols[i] = pair & LOW
            gone[j] = 1
            k = following[i] = following[j]
            if k < n:
                preceding[k] = i
                after = get(piece << SHIFT | symbols[k])
                if after is not None:
                    heapq.heappush(agenda, after >> SHIFT << shift | i)
            h = preceding[i]
            if h >= 0:
                before = get(symbols[h] << SHIFT | piece)
                if before is not None:
                    heapq.heappush(agenda, before >> SHIFT << shift | h)
        return [symbol for symbol, dead in zip(symbols, gone) if not dead]

    def _part(self, part: str) -> bytes:
        ids = self._merged(part)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _unit(self, unit: str) -> bytes:
        """Packed ids of a unit: of its parts between characters that never join."""
        self.fresh.append(unit)
        neighbours = self.neighbours
        cuts = [i for i in range(1, len(unit)) if unit[i - 1:i + 1] not in neighbours]
        if cuts:
            return b"".join([self._parts[unit[a:b]] for a, b in zip([0, *cuts], [*cuts, len(unit)])])
        return self._part(unit)

    def check_fresh(self, library: sentencepiece.SentencePieceProcessor) -> None:
        """Hold all units encoded since the last call against the library.

        The library puts the front mark by itself; the mark alone would be its empty text.
        """
        units = [unit for unit in self.fresh if unit != self.front]
        theirs = library.encode([unit[len(self.front):].replace(MARK, " ") for unit in units], num_threads=1)
        for unit, ids in zip(units, theirs):
            if self.kept[unit] != struct.pack(f"<{len(ids)}I", *ids):
                raise NotAsLibrary(f"other ids than the library's for {unit[:80]!r}")
        self.fresh = []

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers, without begin and end ids."""
        if not text:
            return b""
        return b"".join(map(self.kept.__getitem__, self.units.findall(self.front + text.replace(" ", MARK))))


class _Kept(dict):
    """Packed ids by text, made on demand. A full store is set aside; what is met again comes back."""

    def __init__(self, make, most: int):
        self.make, self.most, self.aside = make, most, {}

    def __missing__(self, text: str) -> bytes:
        ids = self.aside.get(text)
        if ids is None:
            ids = self.make(text)
        if len(self) >= self.most:
            self.aside = dict(self)
            self.clear()
        self[text] = ids
        return ids


_loaded: dict[str, tuple] = {}


def _model(model_file: str, kept_units: int) -> tuple[PieceBpe, sentencepiece.SentencePieceProcessor]:
    """One vocabulary and store per worker process."""
    key = model_file, kept_units
    if key not in _loaded:
        library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        _loaded[key] = PieceBpe(model_file, kept_units), library
    return _loaded[key]


class NotAsLibrary(RuntimeError):
    """The agenda and the library disagree about a text."""


def _texts(column: pa.Array) -> Iterator[list[str]]:
    """The texts (NULL as empty), some at a time."""
    start = size = 0
    lengths = pa.compute.fill_null(pa.compute.utf8_length(column), 0).to_pylist()
    for i, length in enumerate(lengths):
        size += length
        if size >= BATCH_CHARS or i == len(lengths) - 1:
            yield [t or "" for t in column.slice(start, i + 1 - start).to_pylist()]
            start, size = i + 1, 0


def _encoded(batches: Iterator[pa.RecordBatch], model_file: str, packed: bool, check: str, kept_units: int = KEPT_UNITS):
    """The rows with `ids` and `decoded` behind their other columns; the text is the last column."""
    bpe, library = _model(model_file, kept_units)
    begin, end = (np.array([i], "<u4").tobytes() for i in (library.bos_id(), library.eos_id()))
    for batch in batches:
        done = 0
        for texts in _texts(batch.column(batch.num_columns - 1)):
            ids = [begin + bpe.encode(text) + end for text in texts]
            numbers = [np.frombuffer(i, "<u4") for i in ids]
            lists = [i.tolist() for i in numbers]
            if check == "units":
                bpe.check_fresh(library)
            elif check == "texts":
                for text, ours, theirs in zip(texts, lists, library.encode(texts, num_threads=1)):
                    if ours[1:-1] != theirs:
                        raise NotAsLibrary(f"other ids than the library's for the text {text[:80]!r}")
            offsets = np.concatenate([[0], np.cumsum([len(i) for i in numbers])]).astype(np.int32)
            column = pa.array(ids, pa.binary()) if packed else pa.ListArray.from_arrays(
                pa.array(offsets), pa.array(np.concatenate(numbers).astype(np.int32))
            )
            rest = batch.slice(done, len(texts))
            done += len(texts)
            yield pa.RecordBatch.from_arrays(
                [*rest.columns[:-1], column, pa.array(library.decode(lists), pa.string())],
                [*rest.schema.names[:-1], "ids", "decoded"],
            )


def encode_texts(
    docs: DataFrame, model_file: str, keep: list[str], text: str = "text", packed: bool = False, check: str = "units",
    kept_units: int = KEPT_UNITS,
) -> DataFrame:
    """The columns `keep`, `ids` (with begin and end ids) and `decoded` for every row of `docs`.

    `ids` is array<int>, or little-endian unsigned 32-bit integers in a BINARY if `packed`.
    `decoded` is the library's decode(ids). In every Arrow batch the library encodes the units
    that the worker has not met before (`check="units"`) or all whole texts (`check="texts"`); a
    difference stops the job (`NotAsLibrary`). A worker keeps the ids of up to twice `kept_units`
    units: more of them cost memory and save time, and change no result. NULL texts are empty: begin and end
    id alone. Whole texts are encoded, row by row: nothing is shuffled. `keep` must not name
    `ids` or `decoded`.
    """
    if check not in ("units", "texts"):
        raise ValueError(f"no such check: {check}")
    if {"ids", "decoded"} & set(keep):
        raise ValueError("columns named ids or decoded can't be kept beside the result's")
    rows = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    schema = f"{fields}{', ' if fields else ''}ids {'binary' if packed else 'array<int>'}, decoded string"
    return rows.mapInArrow(lambda batches: _encoded(batches, model_file, packed, check, kept_units), schema)
