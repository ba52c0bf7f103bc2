"""The heaviest of many labels against a plain grouping of all of them."""

import random
import re

import pytest
from pyspark.sql import functions as F

from utilscope.operators import heavy, ranking

SCHEMA = "k string, x double"


@pytest.fixture(autouse=True)
def nothing_cached(spark):
    """A table that one test has cached stands in the plans of the next."""
    yield
    spark.catalog.clearCache()


def plain(df, k):
    return [tuple(r) for r in ranking.leaders(df.groupBy("k").agg(F.sum("x").alias("t")), "t", ["k"], k).collect()]


def million(spark):
    """A million labels of about equal weight, and a hundred heavy ones spread over all partitions."""
    tail = spark.range(0, 1_000_000, numPartitions=8).select(F.concat(F.lit("rare "), "id").alias("k"), F.lit(1.0).alias("x"))
    head = spark.range(0, 40_000, numPartitions=8).select(
        F.concat(F.lit("heavy "), F.col("id") % 100).alias("k"), (F.col("id") % 100 + 1).cast("double").alias("x"))
    return tail.unionAll(head)


def test_of_a_million_labels_few_are_grouped(spark):
    df = million(spark)
    running = heavy.heavy_rows(df, "k", "x", 20).cache()
    assert plain(running, 20) == plain(df, 20)
    assert running.select("k").distinct().count() < 200
    merged = ranking.collapse_rare(df, df, "k", "x", 20, "Other")
    assert merged.select("k").distinct().count() == 21
    assert merged.where("k = 'Other'").count() == 1_040_000 - 20 * 400


def test_no_grouping_of_all_labels_is_planned(spark):
    """The grouping by label stands above both bucket filters, which Spark pushes into both parts of the union."""
    df = million(spark)
    plan = ranking.collapse_rare(df, df, "k", "x", 20, "Other")._jdf.queryExecution().optimizedPlan().toString()
    grouped = plan.index("Aggregate [k")
    assert len(re.findall("Join LeftSemi", plan[grouped:])) == 4 and "Join LeftSemi" not in plan[:grouped]


@pytest.mark.parametrize("seed", range(4))
def test_any_labels_and_weights(spark, seed, monkeypatch):
    """Few buckets, so that many labels share one: negative, NULL, NaN and infinite weights, ties and a NULL label."""
    monkeypatch.setattr(heavy, "WIDTH", 16)
    draw = random.Random(seed)
    weights = [None, -3.0, 0.0, 1.0, 2.0, 7.0] + ([float("nan"), float("inf")] if seed == 3 else [])
    rows = [(draw.choice([None, *[f"l{draw.randint(0, 60)}" for _ in range(9)]]), draw.choice(weights)) for _ in range(400)]
    rows += [(f"big{i % 3}", 90.0) for i in range(9)]
    df = spark.createDataFrame(rows, SCHEMA)
    for k in (1, 3, 10, 70):
        assert str(plain(heavy.heavy_rows(df, "k", "x", k), k)) == str(plain(df, k))


def test_empty_few_and_weightless_labels(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert heavy.heavy_rows(empty, "k", "x", 3).count() == 0
    same = spark.createDataFrame([("a", 0.0), ("b", None), ("c", -1.0), ("d", 0.0)], SCHEMA)
    assert heavy.heavy_rows(same, "k", "x", 2).count() == 4
    one = spark.createDataFrame([("a", 5.0)], SCHEMA)
    assert heavy.heavy_rows(one, "k", "x", 3).count() == 1
    assert heavy.heavy_rows(one, "k", "x", 0).count() == 1
