"""Text, number and formatting functions on literal cases."""

import pytest
from pyspark.sql import functions as F

from utilscope.functions import formatting, numbers, text


def evaluate(spark, value, function, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(function(F.col("c"))).first()[0]


@pytest.mark.parametrize("value, expected", [
    ("7", "0000000007"), ("1003000126.0", "1003000126"), ("12345678901", "12345678901"), (None, None),
])
def test_provider_id(spark, value, expected):
    assert evaluate(spark, value, text.provider_id) == expected


def test_masked_id(spark):
    assert evaluate(spark, "1003000126", text.masked_id) == "NPI-******0126"


@pytest.mark.parametrize("value, expected", [("\tMD ", "MD"), (None, ""), ("  a b ", "a b")])
def test_strip_text(spark, value, expected):
    assert evaluate(spark, value, text.strip_text) == expected


@pytest.mark.parametrize("value, expected", [
    ("Insulin Pen,reusable,bt Lispro", "insulin pen reusable bt lispro"),
    ("Brand#13", "brand 13"), (None, ""), ("--", ""),
])
def test_normalize_text(spark, value, expected):
    assert evaluate(spark, value, text.normalize_text) == expected


@pytest.mark.parametrize("value, expected", [("", "Unknown"), (None, "Unknown"), ("CA", "CA")])
def test_or_unknown(spark, value, expected):
    assert evaluate(spark, value, text.or_unknown) == expected


@pytest.mark.parametrize("value, expected, rejected", [
    (" 12 ", 12, False), ("1e3", 1000, False), ("12.0", 12, False), ("1,234", None, False),
    ("", None, False), (None, None, False), ("0x10", None, False), ("12.5", None, True),
    ("inf", None, True), ("NaN", None, False), ("1e40", None, True), ("1d", None, False),
])
def test_integers(spark, value, expected, rejected):
    assert evaluate(spark, value, numbers.to_bigint) == expected
    assert evaluate(spark, value, numbers.not_integral) is rejected


@pytest.mark.parametrize("value, expected", [
    ("12.5", 12.5), (" 1e-2", 0.01), ("inf", None), ("NaN", None), ("1f", None), ("", None),
])
def test_doubles(spark, value, expected):
    assert evaluate(spark, value, numbers.to_double) == expected


def test_ratio_of_zero_is_null(spark):
    row = spark.range(1).select(
        numbers.ratio(F.lit(10), F.lit(0)).alias("a"), numbers.ratio(F.lit(1), F.lit(4)).alias("b")
    ).first()
    assert (row.a, row.b) == (None, 0.25)


def test_exact_sum_has_no_rounding_noise(spark):
    values = spark.range(1000).select(F.lit(0.1).alias("x"))
    assert values.agg(numbers.exact_sum(F.col("x"), 1)).first()[0] == 100.0


@pytest.mark.parametrize("value, expected", [
    (50712600298.58, "$50.71B"), (1_250_000.0, "$1.2M"), (104160.4, "$104,160"), (0.0, "$0"),
])
def test_money(spark, value, expected):
    # 1.25 is a tie in binary; either neighbour is acceptable text for a headline.
    shown = evaluate(spark, value, formatting.money, "double")
    assert shown == expected or (value == 1_250_000.0 and shown == "$1.3M")


def test_percent(spark):
    assert evaluate(spark, 0.1280162706, formatting.percent, "double") == "12.8%"
    assert evaluate(spark, None, formatting.percent, "double") == "—"


def test_more_decimals_than_published_are_an_error(spark):
    df = spark.createDataFrame([(0.25,), (0.25,), (0.24,)], "total_30day_fills double").coalesce(1)  # of several tasks any may fail first
    with pytest.raises(Exception, match="more than 1 decimals: 0.25"):
        df.agg(numbers.sum_of("total_30day_fills")).collect()
    exact = spark.createDataFrame([(0.1,), (0.2,), (None,)], "total_30day_fills double")
    assert exact.agg(numbers.sum_of("total_30day_fills")).first()[0] == 0.3


def test_a_fraction_beyond_the_decimal_scale_is_no_integer(spark):
    texts = ["12.00000000001", "12.0", "9007199254740993.0", "1.2e1", "0.00000000000000000001"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(numbers.to_bigint(F.col("t")).alias("n"), numbers.not_integral(F.col("t")).alias("bad")).collect()
    assert [r.n for r in rows] == [None, 12, 9007199254740993, 12, None]
    assert [r.bad for r in rows] == [True, False, False, False, True]


def test_words_are_sought_in_one_search_and_mean_themselves(spark):
    from utilscope.functions.text import contains_any

    words = ["a.c", "(", "x|y", "\\E", "#13", "Käse", " "]
    texts = ["abc", "a.c", "f(x", "x", "x|y", "\\E", "Brand#13", "Käse", "a b", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = df.select("t", contains_any(df.t, words).alias("hit"), contains_any(df.t, []).alias("none"))
    assert {r.t: r.hit for r in found.collect()} == {t: None if t is None else any(w in t for w in words) for t in texts}
    assert not any(r.none for r in found.collect())
    plan = df.where(contains_any(F.lower("t"), words))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1
