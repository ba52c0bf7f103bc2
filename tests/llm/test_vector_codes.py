"""Vector codes against every part compared with every entry, in Python integers."""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from utilscope.llm.vector_codes import Cells, Coding, encode_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long, id string, vector int"


def plain(rows, coding):
    kept = [(i, [math.floor(coding.scale * float(x)) for x in v], label) for i, v, label in rows
            if v and None not in v and all(map(math.isfinite, v))]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // coding.parts
    cut = [[v[p * width:(p + 1) * width] for p in range(coding.parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:coding.entries]] for p in range(coding.parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(coding.rounds):
        for p, book in enumerate(books):
            used = defaultdict(list)
            for c in cut:
                used[nearest(c[p], book)[1]].append(c[p])
            books[p] = [[sum(col) // len(used[e]) for col in zip(*used[e])] if e in used else c for e, c in enumerate(book)]
    found = [[nearest(c[p], books[p]) for p in range(coding.parts)] for c in cut]
    errors = defaultdict(int)
    for (_, _, label), f in zip(kept, found):
        errors[label] += sum(d for d, _ in f)
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), errors[label], digest)
                   for (i, _, label), f in zip(kept, found)), key=str)


def coded(spark, rows, coding=Coding()):
    df = spark.createDataFrame([(i, v, label, "a", 1, "b", 2) for i, v, label in rows], SCHEMA)
    return sorted((tuple(r) for r in encode_vectors(df, coding).collect()), key=str)


def vectors(n, d, seed=0, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, d))
    return (centres[rng.integers(0, 5, n)] + spread * rng.normal(size=(n, d))).astype(np.float32).tolist()


@pytest.mark.parametrize("cell,cells", [(64, 1 << 14), (512, 3), (4096, 1 << 14)])
def test_all_rows_as_plain(spark, cell, cells):
    rows = [(i, v, i % 3 or None) for i, v in enumerate(vectors(150, 24))]
    rows += [(7, rows[7][1], 1), (None, rows[3][1], 2), (None, rows[9][1], None)] + [(900 + i, rows[5][1], 9) for i in range(40)]
    coding = Coding(cell=cell, cells=cells)
    assert coded(spark, rows, coding) == plain(rows, coding)


def test_unusable_vectors_are_dropped(spark):
    rows = [(i, v, 1) for i, v in enumerate(vectors(30, 16))]
    odd = [None, [], [1.0] * 15 + [None], [float("nan")] * 16, [float("-inf")] + [0.0] * 15]
    assert coded(spark, rows + [(100 + i, v, 1) for i, v in enumerate(odd)]) == plain(rows, Coding())
    zeros = [(200, [0.0] * 16, 1), (201, [-0.0] * 16, 1)]
    assert coded(spark, rows + zeros) == plain(rows + zeros, Coding())


def test_few_rows_other_lengths_and_none(spark):
    rows = [(i, v, None) for i, v in enumerate(vectors(4, 8))]
    assert coded(spark, rows + [(50, [1.0, 2.0], 1)]) == plain(rows, Coding())
    assert coded(spark, []) == []
    odd = [(i, v + [0.5, 0.25], 1) for i, v in enumerate(vectors(40, 9))]
    filled = [(i, v + [0.0] * 5, label) for i, v, label in odd]
    assert coded(spark, odd) == plain(filled, Coding())


def test_components_without_exact_distances_stop_the_job(spark):
    with pytest.raises(Exception, match="exact 64-bit sums"):
        coded(spark, [(1, [1e9] * 8, 1)])


@pytest.mark.parametrize("side", [1, 7, 64, 1000])
def test_cells_leave_every_nearest_entry(side):
    rng = np.random.default_rng(side)
    points, book = rng.integers(-300, 300, (3000, 3)), rng.integers(-300, 300, (20, 3))
    book[7] = book[3]
    cells = Cells(book, side, 500)
    far = ((points[:, None] - book) ** 2).sum(2)
    kept = cells.candidates(points)
    assert kept[np.arange(len(points)), far.argmin(1)].all()
    index, distance = cells.nearest(points)
    assert (index == far.argmin(1)).all() and (distance == far.min(1)).all()
    if side < 64:
        assert kept.mean() < 0.3


def test_cells_that_share_a_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr("utilscope.llm.vector_codes.mix", lambda x, seed: x & np.uint64(1))
    rng = np.random.default_rng(3)
    points, book = rng.integers(-300, 300, (500, 2)), rng.integers(-300, 300, (9, 2))
    far = ((points[:, None] - book) ** 2).sum(2)
    assert (Cells(book, 16, 100).nearest(points)[0] == far.argmin(1)).all()
