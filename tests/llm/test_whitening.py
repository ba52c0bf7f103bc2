"""Whitened components against numpy's eigenvectors and Python integers."""

from __future__ import annotations

import math

import numpy as np
import pytest

from utilscope.llm.whitening import Spectrum, Whitening, leading_pairs, positive_pivots, products, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, n int, id long, vector int, place int, component int"


def whitened(spark, rows, settings=Whitening()):
    df = spark.createDataFrame([(i, v, 1, 2, 3, 4, 5, 6) for i, v in rows], SCHEMA)
    return whiten(df, settings).collect()


def plain(rows, settings=Whitening()):
    """By id: exact deviation and whitened components up to sign; explained shares."""
    kept = [(i, [math.floor(settings.scale * float(x)) + settings.offset for x in v]) for i, v in rows
            if v and None not in v and all(map(math.isfinite, v))]
    n, sums = len(kept), [sum(col) for col in zip(*(x for _, x in kept))]
    centred = np.array([[float((n * a - s)) / n for a, s in zip(x, sums)] for _, x in kept])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:settings.components]
    order = [k for k in order if values[k] > 1e-9 * values.max()]
    projected = centred @ vectors[:, order] / np.sqrt(values[order])
    deviations = [sum((n * a - s) ** 2 for a, s in zip(x, sums)) for _, x in kept]
    return n, [i for i, _ in kept], deviations, projected, values[order] / values.sum()


def check(found, rows, settings=Whitening()):
    n, ids, deviations, projected, shares = plain(rows, settings)
    assert len(found) == len(ids) * len(shares)
    by_id = {(r.vec_id, r.component): r for r in found}
    for k, share in enumerate(shares):
        got = [by_id[i, k + 1] for i in ids]
        column = np.array([r.whitened for r in got])
        sign = 1 if column @ projected[:, k] > 0 else -1
        assert np.allclose(column, sign * projected[:, k], atol=1e-8)
        assert [int(r.deviation) for r in got] == deviations
        assert {r.n for r in got} == {n} and all(abs(r.explained - share) < 1e-9 for r in got)
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9


def vectors(n, d, seed=0):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) * np.linspace(1, 0.2, d) @ rng.normal(size=(d, d)) * 0.2).astype(np.float32).tolist()


def test_all_rows_as_numpy(spark):
    rows = list(enumerate(vectors(300, 20)))
    check(whitened(spark, rows), rows)


def test_unusable_vectors_are_left_out(spark):
    rows = list(enumerate(vectors(60, 12)))
    odd = [None, [], [1.0] * 11 + [None], [float("nan")] * 12, [float("inf")] + [0.0] * 11]
    check(whitened(spark, rows + [(100 + i, v) for i, v in enumerate(odd)]), rows)
    zeros = rows + [(200, [0.0] * 12)]
    check(whitened(spark, zeros + [(300, [1.0])]), zeros)


def test_few_dimensions_large_components_and_constant_ones(spark):
    rows = [(i, v) for i, v in enumerate(vectors(50, 3))]
    check(whitened(spark, rows), rows)
    large = [(i, [x * 2.0**20 for x in v]) for i, v in rows]
    check(whitened(spark, large), large)
    flat = [(i, [*v, 7.5, 0.0, v[0]]) for i, v in rows]
    check(whitened(spark, flat), flat)
    with pytest.raises(Exception, match="exact 64-bit sums"):
        whitened(spark, [(1, [1e12]), (2, [0.0])])


def test_no_variance_gives_no_rows(spark):
    assert whitened(spark, []) == []
    assert whitened(spark, [(1, [1.0, 2.0])]) == []
    assert whitened(spark, [(i, [1.0, 2.0]) for i in range(5)]) == []


def test_repeated_rows_and_null_ids(spark):
    rows = list(enumerate(vectors(20, 4)))
    found = whitened(spark, rows + [rows[0], (None, rows[1][1])])
    assert len(found) == 22 * 4 and sum(r.vec_id == 0 for r in found) == 8 and sum(r.vec_id is None for r in found) == 4


def test_pivots_count_positive_eigenvalues():
    rng = np.random.default_rng(5)
    for size in (1, 2, 5, 30):
        q = np.linalg.qr(rng.normal(size=(size, size)))[0]
        values = rng.normal(size=size)
        assert positive_pivots(q * values @ q.T) == (values > 0).sum()
    assert positive_pivots(np.array([[0.0, 1.0], [1.0, 0.0]])) == 1
    assert positive_pivots(np.zeros((3, 3))) == 0


def test_equal_and_close_eigenvalues():
    rng = np.random.default_rng(6)
    q = np.linalg.qr(rng.normal(size=(12, 12)))[0]
    given = np.array([5, 5, 5, 3, 3 - 1e-9, 2, 1, 1, 0.5, 1e-6, 0, 0])
    matrix = q * given @ q.T
    values, found = leading_pairs((matrix + matrix.T) / 2, 12)
    assert np.allclose(values, given[:len(values)], atol=1e-12) and len(values) == 10
    assert np.allclose(found.T @ found, np.eye(10), atol=1e-12)
    assert np.abs(matrix @ found - found * values).max() < 1e-12


def test_counts_certify_the_numbering():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 40))
    covariance = x.T @ x / 400
    spectrum = Spectrum(covariance)
    exact = np.linalg.eigvalsh(covariance)[::-1]
    for number in (1, 3, 17):
        low, high = spectrum.isolated(number)
        assert low < exact[number - 1] <= high and ((exact > low) & (exact <= high)).sum() == 1
        value, _ = spectrum.pair(number, np.zeros((40, 0)))
        assert abs(value - exact[number - 1]) < 1e-13


def test_products_are_exact():
    rng = np.random.default_rng(8)
    for size in (1 << 10, 1 << 38):
        values = rng.integers(-size, size, (5000, 3))
        whole = values.astype(object)
        assert (products(values) == whole.T @ whole).all()
