"""Embedding classes against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from utilscope.llm.embedding_dedup import Hashing, bucket_keys, embedding_classes, hadamard

SCHEMA = "vec_id long, embedding array<float>, label int, node long, key long, links int"


def plain(rows, least):
    usable = [i for i, (_, v, label) in enumerate(rows) if label is not None and v and None not in v
              and np.isfinite(v).all() and np.any(v)]
    links = {i: set() for i in range(len(rows))}
    for i in usable:
        for j in usable:
            a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if i != j and rows[i][2] == rows[j][2] and len(a) == len(b):
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least:
                    links[i].add(j)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        low = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(links[i]), low, rows[i][0] == low))
    return sorted(out, key=str)


def vectors(seed, groups, size, spread, d=48):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        base = rng.normal(size=d)
        for _ in range(size):
            rows.append((base + rng.normal(size=d) * spread).astype(np.float32).tolist())
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, 2, 3) for i, v, label in rows], SCHEMA)


@pytest.mark.parametrize("block", [1024, 16])
def test_links_and_classes_of_all_pairs(spark, block):
    found = vectors(1, 12, 5, 0.15) + vectors(2, 1, 90, 0.05) + vectors(3, 120, 1, 0)
    rows = [(i, v, i % 2 if i < 60 else 0) for i, v in enumerate(found)]
    rows += [(300 + i, rows[i][1], rows[i][2]) for i in range(5)] + [(3, rows[3][1], rows[3][2]), (None, rows[4][1], 0)]
    got = [tuple(r) for r in embedding_classes(frame(spark, rows), Hashing(block=block)).collect()]
    assert sorted(got, key=str) == plain(rows, 0.93)


def test_unusable_vectors_link_with_nothing(spark):
    one = [1.0, 2.0, 3.0]
    odd = [None, [], [0.0, 0.0, 0.0], [1.0, None, 3.0], [float("nan"), 1.0, 1.0], [float("inf"), 1.0, 1.0], [1.0, 2.0]]
    rows = [(i, v, 1) for i, v in enumerate(odd)] + [(50, one, None), (51, one, 1), (52, [2.0, 4.0, 6.0], 1), (53, one, 2)]
    got = [tuple(r) for r in embedding_classes(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == plain(rows, 0.93)
    assert embedding_classes(frame(spark, rows).limit(0)).collect() == []


def test_recall_at_the_threshold():
    rng = np.random.default_rng(9)
    a = rng.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    left, right = bucket_keys(a, Hashing()), bucket_keys(b, Hashing())
    met = (left[:, :, None] == right[:, None, :]).any((1, 2))
    assert met.mean() > 0.97


def test_hadamard_keeps_lengths_and_is_its_own_inverse():
    x = np.random.default_rng(1).normal(size=(5, 16))
    assert np.allclose(hadamard(hadamard(x)), x) and np.allclose(np.linalg.norm(hadamard(x), axis=1), np.linalg.norm(x, axis=1))
