"""Winsorizing, benchmark gap and scores on worked examples."""

import pytest
from pyspark.sql import functions as F

from utilscope.operators import opportunity, ranking
from utilscope.rules import OPPORTUNITY_WEIGHTS
from utilscope.workspace import Workspace

SEGMENTS = [  # name, fills 2022, fills 2024, selected 2024, completeness
    ("A", 100.0, 144.0, 14.4, 0.90), ("B", 200.0, 200.0, 40.0, 0.80), ("C", 0.0, 50.0, 0.0, 0.50),
    ("D", None, 80.0, 4.0, 0.70), ("E", 50.0, 40.0, 20.0, 0.60), ("F", 300.0, 363.0, 36.0, 0.95),
    ("Gone", 70.0, None, 1.0, 0.5),
]
EXPECTED = {  # winsorized growth, gap, then score and rank of each scenario, rank range
    "A": (0.185, 3.044470, 73.333333, 2, 79.166667, 2, 69.166667, 2, 0),
    "B": (0, 0, 53.75, 4, 49.166667, 5, 47.5, 5, 1),
    "C": (0.05, 13.044470, 53.75, 4, 54.166667, 4, 62.5, 4, 0),
    "D": (0.05, 8.044470, 60.416667, 3, 60, 3, 65, 3, 0),
    "E": (-0.089737, 0, 21.25, 6, 20.833333, 6, 22.5, 6, 0),
    "F": (0.1, 3.127114, 87.5, 1, 86.666667, 1, 83.333333, 1, 0),
}


@pytest.fixture(scope="module")
def workspace(spark, tmp_path_factory):
    return Workspace(spark, str(tmp_path_factory.mktemp("opportunity")))


@pytest.fixture(scope="module")
def segments(spark):
    rows = []
    for name, first, last, selected, complete in SEGMENTS:
        rows += [(2022, name, first, 0.0, 1.0)] if first is not None else []
        rows += [(2024, name, last, selected, complete)] if last is not None else []
        rows += [(2023, name, 999.0, 1.0, 1.0)]
    schema = ("year int, state string, total_30day_fills double, selected_class_fills double, "
              "beneficiary_completeness double")
    return spark.createDataFrame(rows, schema)


def table(workspace, segments):
    return opportunity.opportunity_table(workspace, segments, "state", 2022, 2024, OPPORTUNITY_WEIGHTS)


def test_scores(workspace, segments):
    columns = ["winsorized_cagr", "peer_gap_pp", "score_primary", "rank_primary", "score_growth_led",
               "rank_growth_led", "score_gap_led", "rank_gap_led", "rank_range"]
    rows = {r.state: tuple(r[c] for c in columns) for r in table(workspace, segments).collect()}
    assert rows.keys() == EXPECTED.keys()
    for state, expected in EXPECTED.items():
        assert rows[state] == pytest.approx(expected, abs=1e-6), state


def test_interpretation_follows_the_gap(workspace, segments):
    labels = {r.state: r.observed_interpretation for r in table(workspace, segments).collect()}
    assert labels["A"] == opportunity.WITH_GAP and labels["B"] == opportunity.WITHOUT_GAP


def test_published_example():
    """Components 53/55, 28/55, 48/55 and 52/55 give 82.4545 under the primary weights."""
    w = OPPORTUNITY_WEIGHTS.scenarios["primary"]
    parts = dict(scale=53 / 55, growth=28 / 55, class_gap=48 / 55, completeness=52 / 55)
    assert 100 * sum(w[c] * parts[c] for c in w) == pytest.approx(82.4545, abs=1e-4)


@pytest.mark.parametrize("values, expected", [
    ([1.0, 2.0, 3.0, 10.0, None], [1.15, 2, 3, 8.95, 2.5]),
    ([1.0, 2.0, 100.0, None], [1, 2, 100, 0]),
    ([None, None], [0, 0]),
    ([1.0, 2.0, 3.0, 10.0, float("inf"), float("nan")], [1.15, 2, 3, 8.95, 2.5, 2.5]),
])
def test_winsorize(spark, workspace, values, expected):
    df = spark.createDataFrame(list(enumerate(values)), "i int, x double")
    rows = opportunity.winsorize(workspace, df, "x", "w").orderBy("i").collect()
    assert [r.w for r in rows] == pytest.approx(expected)


def test_growth_needs_a_base(spark):
    df = spark.createDataFrame([(0.0, 5.0), (None, 5.0), (4.0, 9.0)], "a double, b double")
    got = df.select(
        opportunity.cagr(F.col("a"), F.col("b"), 2).alias("g"),
        opportunity.cagr(F.col("a"), F.col("b"), 1).alias("h"),
    ).collect()
    assert [r.g for r in got] == [None, None, 0.5] and got[2].h == 1.25


def test_pivot(segments):
    row = opportunity.segment_pivot(segments, "state", [2022, 2024]).filter("state = 'D'").first()
    assert (row.fills_2022, row.fills_2024) == (None, 80.0)


def test_search_export(workspace, segments):
    export = opportunity.search_export(table(workspace, segments), "state", "f", 20)
    assert export.columns == ["rank", "state", "score", "fills", "cagr", "selected_class_share",
                              "gap_pp", "rank_range"]
    assert [r.state for r in export.collect()] == ["F"]


def test_allow_list(segments):
    kept = opportunity.allow_listed(segments, "state", ["A", "Z"]).select("state").distinct()
    assert [r.state for r in kept.collect()] == ["A"]
