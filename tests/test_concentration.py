"""Gini, HHI, Pareto shares and Lorenz points on literal vectors."""

import math

import pytest

from utilscope.operators.concentration import concentration, lorenz_curve, pareto_shares
from utilscope.operators.ranking import RankedValues
from utilscope.workspace import Workspace


@pytest.fixture(scope="module")
def order_of(spark, tmp_path_factory):
    workspace = Workspace(spark, str(tmp_path_factory.mktemp("concentration")))
    made = iter(range(1000))

    def build(values):
        rows = [(1, str(i), v) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, "year int, npi string, x double")
        return RankedValues(workspace, f"v{next(made)}", df, ["year"], "x", ["npi"])

    return build


@pytest.mark.parametrize("values, gini, hhi, top1, top20", [
    ([1, 2, 3, 4], 0.25, 0.3, 0.4, 0.4),
    ([5, 5, 5, 5], 0, 0.25, 0.25, 0.25),
    ([0, 0, 0, 10], 0.75, 1, 1, 1),
    ([10], 0, 1, 1, 1),
    ([11, 11, 12.5, 30.2, 99.9, 500], 0.6844718627746, 0.5915651942629, 0.7523322299127, 0.9026482094493),
    ([0, 0], 0, 0, 0, 0),
    ([None, 1, 2, 3, 4], 0.25, 0.3, 0.4, 0.4),
])
def test_measures(order_of, values, gini, hhi, top1, top20):
    row = concentration(order_of([None if v is None else float(v) for v in values]), 1).first()
    found = (row.gini, row.hhi, row.top_1_share, row.top_20_share)
    assert found == pytest.approx((gini, hhi, top1, top20), abs=1e-11)


def test_negative_values_are_left_out_of_gini(order_of):
    assert concentration(order_of([-5.0, 1.0, 2.0, 3.0, 4.0]), 1).first().gini == pytest.approx(0.25)


def test_lorenz_of_four(order_of):
    points = {r.provider_pct: r.fill_pct for r in lorenz_curve(order_of([1.0, 2.0, 3.0, 4.0]), 1).collect()}
    expected = {0: 0, 12: 0, 14: 10, 36: 10, 38: 30, 50: 30, 62: 30, 64: 60, 86: 60, 88: 100, 100: 100}
    assert len(points) == 51
    assert {p: points[p] for p in expected} == pytest.approx(expected)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 25, 50, 75, 100, 333])
def test_lorenz_against_brute_force(order_of, n):
    values = [float((i * 37) % 91) for i in range(n)]
    total, ordered = sum(values), sorted(values)
    points = {r.provider_pct: r.fill_pct for r in lorenz_curve(order_of(values), 1).collect()}
    for pct in range(0, 101, 2):
        held = sum(ordered[: min(n, round(n * pct / 100))])
        assert points[pct] == pytest.approx(100 * held / total if total else 0), pct


def test_shares_grow_with_the_percentage(order_of):
    rows = pareto_shares(order_of([float(i * i % 53) for i in range(230)]), 1).orderBy("top_percent").collect()
    shares = [r.fill_share for r in rows]
    assert shares == sorted(shares)
    assert [r.providers for r in rows] == [max(1, math.ceil(230 * p / 100)) for p in (1, 5, 10, 20)]


def test_lorenz_is_monotone_and_below_the_diagonal(order_of):
    curve = lorenz_curve(order_of([float(i % 17 + 1) for i in range(400)]), 1).orderBy("provider_pct")
    points = [(r.provider_pct, r.fill_pct) for r in curve.collect()]
    assert all(a[1] <= b[1] for a, b in zip(points, points[1:]))
    assert all(fill <= pct + 1e-9 for pct, fill in points)
