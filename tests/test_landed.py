"""A fact that follows replaced and withdrawn files, and row-wise reconciliation."""

import os

import pytest
from raw_fixture import raw_row, write_year

from utilscope.operators.quality import reconcile_rows
from utilscope.rules import DIABETES_RULES
from utilscope.sources.files import read_strict_csv
from utilscope.streaming.ingest import typed_fact
from utilscope.streaming.landed import LandedFact


@pytest.fixture
def landed(spark, tmp_path):
    return LandedFact(spark, str(tmp_path / "landing"), str(tmp_path / "out"), DIABETES_RULES)


def check(spark, landed):
    rebuilt = typed_fact(read_strict_csv(spark, landed.landing), DIABETES_RULES)
    fact = landed.fact()
    assert fact.exceptAll(rebuilt.select(fact.columns)).count() == 0 and rebuilt.count() == fact.count()


def changes(landed):
    return [(path.split("/")[-1], change) for path, change in landed.follow()]


def test_the_fact_is_that_of_the_files_that_lie_there(spark, tmp_path, landed):
    folder = tmp_path / "landing"
    write_year(folder, 2023, [raw_row(Prscrbr_NPI=str(i)) for i in range(5)], "a.csv")
    write_year(folder, 2023, [raw_row(Prscrbr_NPI="77")], "b.csv")
    write_year(folder, 2024, [raw_row(Prscrbr_NPI="5"), raw_row(Brnd_Name="Wegovy")], "a.csv")
    assert sorted(changes(landed)) == [("a.csv", "new"), ("a.csv", "new"), ("b.csv", "new")]
    check(spark, landed)
    assert changes(landed) == []
    write_year(folder, 2023, [raw_row(Prscrbr_NPI="9")], "a.csv")
    os.remove(folder / "year=2023" / "b.csv")
    write_year(folder, 2024, [raw_row(Gnrc_Name="Aspirin")], "a.csv")  # keeps no row
    write_year(folder, 2022, [raw_row()], "c.csv")
    assert sorted(changes(landed)) == [("a.csv", "changed"), ("a.csv", "changed"), ("b.csv", "gone"), ("c.csv", "new")]
    check(spark, landed)


def test_a_run_that_died_is_repeated(spark, tmp_path, landed, monkeypatch):
    folder = tmp_path / "landing"
    write_year(folder, 2023, [raw_row(Prscrbr_NPI=str(i)) for i in range(3)])
    landed.follow()
    write_year(folder, 2023, [raw_row(Prscrbr_NPI="4")])
    with monkeypatch.context() as broken:
        broken.setattr(LandedFact, "_replace", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            landed.follow()
    assert changes(landed) == [("extract.csv", "changed")]
    check(spark, landed)


SCHEMA = "k string, y int, v double, only_left int"


@pytest.mark.parametrize("buckets", [1, 8, 4096])
def test_differing_rows_are_named_and_no_others(spark, buckets):
    left = [(str(i), i % 3, float(i), 1) for i in range(200)] + [(None, 1, 1.0, 1), ("twice", 1, 1.0, 1), ("twice", 1, 1.0, 1)]
    right = [r for r in left if r[0] != "17"] + [("new", 0, 0.0, 1), ("new", 0, 0.0, 1)]
    right = [(k, y, -1.0, n) if k in ("42", None) else (k, y, v, n) for k, y, v, n in right]
    right.remove(("twice", 1, 1.0, 1))
    found = reconcile_rows(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA).drop("only_left"), ["y", "k"], buckets)
    assert sorted(map(tuple, found.select("k", "left_rows", "right_rows", "difference").collect()), key=str) == sorted([
        ("17", 1, 0, "missing"), ("42", 1, 1, "changed"), (None, 1, 1, "changed"), ("new", 0, 2, "extra"), ("twice", 2, 1, "changed"),
    ], key=str)


def test_equal_and_empty_layers(spark):
    df = spark.createDataFrame([("a", 1, 2.0, 3)], SCHEMA)
    assert reconcile_rows(df, df, ["k"]).collect() == []
    assert [r.difference for r in reconcile_rows(df.limit(0), df, ["k"]).collect()] == ["extra"]
