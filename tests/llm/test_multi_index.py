"""Nearest vectors against the distances of all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from utilscope.llm.multi_index import Search, nearest_vectors, walked

SCHEMA = "vec_id long, embedding array<float>, label int, id long, node int, vector int, rank string, region int"
SMALL = Search(neighbours=5, cell_rows=2, gathered=20, block=16, queries=8)
EXACT = Search(neighbours=5, cell_rows=2, gathered=8, block=16, queries=8, reach=2.0)


def plain(rows, k, every):
    usable = [(i, np.array(v, np.float32).astype(float)) for i, v in rows
              if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = []
    for n, (i, v) in enumerate(usable):
        if i % every == 0:
            near = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for m, (j, w) in enumerate(usable) if m != n)
            out += [(i, rank + 1, j, d) for rank, (d, j) in enumerate(near[:k])]
    return sorted(out)


def search(spark, rows, settings, every=10):
    df = spark.createDataFrame([(i, v, 1, 2, 3, 4, "5", 6) for i, v in rows], SCHEMA)
    return sorted(tuple(r) for r in nearest_vectors(df, lambda id: id % every == 0, settings).collect())


def same(found, wanted):
    assert [r[:3] for r in found] == [r[:3] for r in wanted]
    assert np.allclose([r[3] for r in found], [r[3] for r in wanted], rtol=1e-14, atol=0)


def vectors(n, d, groups, spread, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d))
    return (centres[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, d))).astype(np.float32).tolist()


def test_a_reach_of_two_loses_nothing(spark):
    rows = list(enumerate(vectors(400, 12, 9, 0.4)))
    same(search(spark, rows, EXACT), plain(rows, 5, 10))


@pytest.mark.parametrize("spread", [0.1, 0.6])
def test_recall(spark, spread):
    rows = list(enumerate(vectors(1500, 32, 25, spread, 4)))
    found = search(spark, rows, Search(neighbours=10, gathered=100))
    wanted = plain(rows, 10, 10)
    assert len(found) == len(wanted)
    hits = {r[::2] for r in found} & {r[::2] for r in wanted}
    assert len(hits) >= 0.95 * len(wanted)


def test_groups_of_copies_and_ties(spark):
    rows = list(enumerate(vectors(60, 6, 4, 0.5)))
    rows += [(1000 + i, rows[3][1]) for i in range(40)] + [(2000 + 10 * i, rows[10][1]) for i in range(3)]
    rows += [(20, rows[20][1]), (30, rows[5][1])]  # a repeated row, and an id of two vectors
    axes = np.eye(6, dtype=np.float32).tolist()
    rows += [(3000 + i, a) for i, a in enumerate(axes)]
    same(search(spark, rows, EXACT), plain(rows, 5, 10))


def test_unusable_rows_take_no_part(spark):
    rows = list(enumerate(vectors(50, 4, 3, 0.5)))
    odd = [None, [], [0.0] * 4, [1.0, None, 1.0, 1.0], [float("nan")] * 4, [float("inf"), 0.0, 0.0, 0.0]]
    found = search(spark, rows + [(100 * i, v) for i, v in enumerate(odd, 1)] + [(None, rows[0][1]), (700, [1.0])], EXACT)
    same(found, plain(rows, 5, 10))


def test_few_rows_short_vectors_and_none(spark):
    rows = [(i, [float(i + 1)]) for i in range(4)]
    same(search(spark, rows, SMALL, every=1), plain(rows, 5, 1))
    assert search(spark, rows[:1], SMALL, every=1) == []
    assert search(spark, rows[1:], SMALL, every=100) == []
    assert search(spark, [], SMALL) == []


def test_walk_visits_cells_by_summed_distance():
    rng = np.random.default_rng(2)
    for shape in ((1, 1), (1, 6), (7, 5)):
        a, b = rng.random(shape[0]), rng.random(shape[1])
        sizes = rng.integers(0, 4, shape)
        total = (a[:, None] + b).ravel()
        order = [c for c in np.argsort(total) if sizes.ravel()[c]]
        assert walked(a, b, sizes, sizes.sum() + 1).tolist() == order
        for enough in (1, 5, 20):
            part = walked(a, b, sizes, enough).tolist()
            assert part == order[:len(part)]
            assert sizes.ravel()[part].sum() >= min(enough, sizes.sum()) and sizes.ravel()[part[:-1]].sum() < enough
