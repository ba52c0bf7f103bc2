"""Exact distributed ranks against Spark's own windows, with hot values and NULLs."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from utilscope.operators import ranking
from utilscope.operators.ranking import GlobalOrder, RankedValues
from utilscope.workspace import Workspace


@pytest.fixture(scope="module")
def workspace(spark, tmp_path_factory):
    return Workspace(spark, str(tmp_path_factory.mktemp("ranks")))


@pytest.fixture(scope="module")
def providers(spark):
    """Two years; a third of all rows share one value, a few values are NULL."""
    n = F.col("id")
    value = F.when(n % 3 == 0, F.lit(50.0)).when(n % 101 == 0, F.lit(None)).otherwise(
        (n * 7919 % 400).cast("double")
    )
    return spark.range(6000).select(
        (2023 + n % 2).cast("int").alias("year"), F.lpad(n.cast("string"), 10, "0").alias("npi"),
        value.alias("x"),
    )


@pytest.fixture(scope="module")
def order(spark, workspace, providers):
    # Many sort slices, so the hot value spans several of them.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        return GlobalOrder(workspace, "order", providers, ["year"], "x", ["npi"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.fixture(scope="module")
def ranked(spark, workspace, providers):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        return RankedValues(workspace, "ranked", providers, ["year"], "x", ["npi"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def same(left, right):
    assert left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


def test_hot_value_spans_slices(order):
    slices = order.numbered().filter("x = 50").select("year", "_slice").distinct().count()
    assert slices > 3


def test_row_number_and_ties(order, providers):
    by_value = Window.partitionBy("year").orderBy(F.col("x").desc_nulls_last())
    total = by_value.orderBy(F.col("x").desc_nulls_last(), "npi")
    ties = Window.partitionBy("year", "x")
    expected = providers.withColumns({
        "row_number": F.row_number().over(total).cast("bigint"),
        "tie_first": F.rank().over(by_value).cast("bigint"),
        "tie_last": F.rank().over(by_value) + F.count(F.lit(1)).over(ties) - 1,
    })
    same(order.with_ties().select(expected.columns), expected)


def test_deciles(ranked, providers):
    w = Window.partitionBy("year").orderBy(F.col("x").desc_nulls_last(), "npi")
    expected = providers.withColumn("volume_decile", F.ntile(10).over(w))
    same(ranking.volume_deciles(ranked).select(expected.columns), expected)


@pytest.mark.parametrize("rows", [1, 3, 9, 10, 11, 25, 100])
@pytest.mark.parametrize("buckets", [4, 10])
def test_ntile_sizes(spark, rows, buckets):
    df = spark.range(1, rows + 1).select("id", F.lit(rows).cast("bigint").alias("n"))
    got = df.select("id", ranking.ntile(F.col("id"), F.col("n"), buckets).alias("b"))
    want = df.select("id", F.ntile(buckets).over(Window.partitionBy().orderBy("id")).alias("b"))
    same(got, want)


def test_percentile_without_nulls(spark, workspace, providers):
    known = providers.filter("x IS NOT NULL")
    order = RankedValues(workspace, "known", known, ["year"], "x", ["npi"])
    expected = known.withColumn(
        "volume_percentile", F.cume_dist().over(Window.partitionBy("year").orderBy("x"))
    )
    same(ranking.volume_percentile(order).select(expected.columns), expected)
    both = ranking.volume_ranks(order)
    assert {"volume_decile", "volume_percentile"} <= set(both.columns)


def test_average_percentile(spark, workspace):
    values = [1.0, 2.0, 2.0, None, 5.0]
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "k string, x double")
    expected = [0.25, 0.625, 0.625, 0.5, 1.0]
    ranked = ranking.add_average_percentiles(workspace, df, {"x": "p"}).orderBy("k")
    assert [r.p for r in ranked.collect()] == expected


def test_ranks_keep_null_and_repeated_keys(spark, workspace):
    df = spark.createDataFrame([("a", 3.0), ("a", 3.0), (None, 5.0), ("b", None)], "k string, x double")
    ranked = ranking.add_ranks(workspace, df, {"x": "r"})
    assert sorted((r.k or "", r.r) for r in ranked.collect()) == [("", 1), ("a", 2), ("a", 2), ("b", 4)]


@pytest.mark.parametrize("rows", [3, 200_000])
def test_ranks_and_percentiles_of_any_size_are_those_of_a_window(spark, workspace, rows):
    df = spark.range(rows).select(F.col("id").alias("k"), (F.xxhash64("id") % 1000).cast("double").alias("x"))
    everything = Window.partitionBy()
    expected = df.withColumn("r", F.rank().over(everything.orderBy(F.col("x").desc())))
    same(ranking.add_ranks(workspace, df, {"x": "r"}), expected)
    rank = F.rank().over(everything.orderBy("x"))
    ties = F.count(F.lit(1)).over(Window.partitionBy("x"))
    expected = df.withColumn("p", (rank + (ties - 1) / 2.0) / F.lit(float(rows)))
    same(ranking.add_average_percentiles(workspace, df, {"x": "p"}), expected)
    shares = [0.05, 0.5, 0.95]
    limits = ranking.quantiles(workspace, df, "x", shares).first()
    plain = df.agg(F.percentile("x", F.array(*map(F.lit, shares)))).first()[0]
    assert limits["known"] == rows and limits["q"] == pytest.approx(plain)


@pytest.mark.parametrize("k, threshold", [(25, 0.99), (25, 0.0), (3, 0.9), (5000, 0.5)])
def test_top_percentile(providers, k, threshold):
    known = providers.filter("x IS NOT NULL AND year = 2024")
    rank = F.percent_rank().over(Window.partitionBy().orderBy("x"))
    expected = known.withColumn("cost_percentile", rank).filter(F.col("cost_percentile") >= threshold)
    expected = expected.orderBy(F.col("x").desc(), "npi").limit(k)
    same(ranking.top_percentile(known, "x", ["npi"], threshold, k), expected)


def test_top_percentile_of_one_row(spark):
    one = spark.createDataFrame([("a", 1.0)], "k string, x double")
    assert ranking.top_percentile(one, "x", ["k"], 0.0, 5).first().cost_percentile == 0.0


def test_leaders_break_ties_by_label(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0)], "k string, x double")
    assert [r.k for r in ranking.leaders(df, "x", ["k"], 2).collect()] == ["c", "a"]


def test_collapse_rare(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 1.0), ("c", 3.0)], "k string, x double")
    merged = ranking.collapse_rare(df, df, "k", "x", 2, "Other")
    assert sorted(r.k for r in merged.collect()) == ["Other", "a", "c"]


def test_tie_groups_from_the_counts_of_values(ranked, order):
    columns = ["year", "npi", "x", "tie_first", "tie_last", "group_rows", "group_values"]
    same(ranked.placed().select(columns), order.with_ties().select(columns))


def test_distinct_values_are_shuffled_not_rows(ranked, providers):
    """The bins span several slices, and their aggregation combines on the map side."""
    assert ranked.bins.count() == providers.select("year", "x").distinct().count()
    plan = ranked._sorted_bins()._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan
    order = ranked.rows.select("x").distinct().count()
    assert ranked._sorted.select("_slice").distinct().count() > 3 and order < 500


@pytest.mark.parametrize("rows", [0, 1, 7, 1000])
def test_deciles_and_shares_of_one_value(spark, workspace, rows):
    df = spark.range(rows).select(F.lit(1).alias("year"), F.col("id").alias("k"), F.lit(2.0).alias("x"))
    order = RankedValues(workspace, f"one-{rows}", df, ["year"], "x", ["k"])
    w = Window.partitionBy("year").orderBy("k")
    same(ranking.volume_deciles(order).select("k", "volume_decile"), df.select("k", F.ntile(10).over(w)))
