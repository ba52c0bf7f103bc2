"""Settings of jobs that write large tables."""

import pytest
from raw_fixture import raw_row

from utilscope.schema import RAW_COLUMNS
from utilscope.sources import files
from utilscope.workspace import OPEN_WRITERS, SMALL_TASKS, Workspace, spread

WANTED = OPEN_WRITERS | SMALL_TASKS


def settings(spark):
    return {key: spark.conf.get(key, None) for key in WANTED}


def test_settings_hold_inside_only_and_own_ones_stay(spark):
    key, before = "spark.sql.files.maxPartitionBytes", settings(spark)
    with pytest.raises(ZeroDivisionError), spread(spark):
        assert settings(spark) == WANTED
        with spread(spark, small_tasks=False):
            assert settings(spark) == WANTED
        assert settings(spark) == WANTED
        1 / 0
    assert settings(spark) == before
    spark.conf.set(key, "1g")
    try:
        with spread(spark):
            assert settings(spark) == WANTED | {key: "1g"}
        assert spark.conf.get(key) == "1g"
    finally:
        spark.conf.unset(key)


def test_the_landed_text_is_compressed_and_the_same(spark, tmp_path):
    rows = [tuple(raw_row(Prscrbr_NPI=str(i), Prscrbr_City=' a "b", c ').values()) + (2020 + i % 3,) for i in range(30)]
    raw = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in RAW_COLUMNS) + ", year int")
    files.write_raw_csv(raw, str(tmp_path / "landing"))
    found = files.read_strict_csv(spark, str(tmp_path / "landing")).select(*RAW_COLUMNS, "year")
    blank = lambda rows: sorted(tuple(v or "" for v in r) for r in rows)
    assert blank(found.collect()) == blank(rows)
    names = [p.name for p in (tmp_path / "landing").rglob("part-*")]
    assert names and all(n.endswith(".csv.gz") for n in names)


def test_years_are_written_without_a_sort(spark, tmp_path):
    """A task whose rows alternate between the years keeps a file of each open, in the order of the rows."""
    df = spark.range(0, 40, numPartitions=1).selectExpr("id", "cast(2020 + id % 2 as int) as year")
    Workspace(spark, str(tmp_path)).table("t", lambda: df, ["year"])
    files.write_fact(df, str(tmp_path / "fact"))
    for folder in (tmp_path / "fact", next(tmp_path.glob("utilscope/*/t"))):
        assert len(list(folder.rglob("*.parquet"))) == 2
        assert spark.read.parquet(str(folder)).count() == 40
