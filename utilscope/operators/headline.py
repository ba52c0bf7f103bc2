"""Headline figures in long form, raw and formatted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utilscope.functions.formatting import compact_amount, money, percent
from utilscope.functions.numbers import ratio
from utilscope.operators.aggregates import PRODUCT
from utilscope.operators.ranking import leaders

FILLS = "total_30day_fills"


def market_size_and_growth(market: DataFrame) -> DataFrame:
    """Yearly totals with growth over the previous year."""
    return with_growth(market).select(
        "year", "total_claims", FILLS, "total_drug_cost", "prescribers", "yoy_fill_growth",
        "selected_class_share",
    )


def with_growth(market: DataFrame) -> DataFrame:
    """Adds `yoy_fill_growth`. One row per reporting year goes in."""
    prior = F.lag(FILLS).over(Window.partitionBy().orderBy("year"))
    return market.withColumn("yoy_fill_growth", ratio(F.col(FILLS), prior) - 1)


def segment_leaders(segments: DataFrame, dimension: str, year: int, k: int) -> DataFrame:
    """Largest segments of a year with their selected-class share."""
    share = ratio(F.col("selected_class_fills"), F.col(FILLS))
    return leaders(segments.filter(F.col("year") == year), FILLS, [dimension], k).select(
        dimension, "total_claims", FILLS, "total_drug_cost", "prescribers",
        share.alias("selected_class_share"),
    )


def product_leaders(products: DataFrame, year: int, k: int) -> DataFrame:
    labels = ["brand_name", "generic_name", "drug_class", "marketed_name_type"]
    return leaders(products.filter(F.col("year") == year), FILLS, labels, k).select(
        "brand_name", "generic_name", "drug_class", "total_claims", FILLS, "total_drug_cost",
        "avg_cost_per_claim",
    )


def headline_leaders(
    classes: DataFrame, products: DataFrame, states: DataFrame, specialties: DataFrame, year: int
) -> DataFrame:
    """The single largest class, product, state and specialty of a year."""

    def top(kind: str, df: DataFrame, label: Column, ties: list[str]) -> DataFrame:
        best = leaders(df.filter(F.col("year") == year), FILLS, ties, 1)
        return best.select(F.lit(f"top_{kind}").alias("metric"), label.alias("label"),
                           F.col(FILLS).alias("value"))

    return reduce(DataFrame.unionByName, [
        top("class", classes, F.col("drug_class"), ["drug_class"]),
        top("product", products, F.concat_ws(" / ", "brand_name", "generic_name"),
            [*PRODUCT[1:], PRODUCT[0]]),
        top("state", states, F.col("provider_state"), ["provider_state"]),
        top("specialty", specialties, F.col("provider_specialty"), ["provider_specialty"]),
    ])


def top_rows(
    classes: DataFrame, products: DataFrame, states: DataFrame, specialties: DataFrame, year: int
) -> dict[str, DataFrame]:
    """The whole row of the largest class, product, state and specialty of a year."""
    kinds = {
        "class": (classes, ["drug_class"]), "product": (products, [*PRODUCT[1:], PRODUCT[0]]),
        "state": (states, ["provider_state"]), "specialty": (specialties, ["provider_specialty"]),
    }
    return {
        f"top_{kind}": leaders(df.filter(F.col("year") == year), FILLS, ties, 1)
        for kind, (df, ties) in kinds.items()
    }


def _long(df: DataFrame, prefix: str, columns: list[str]) -> DataFrame:
    doubles = [F.col(c).cast("double").alias(f"{prefix}{c}") for c in columns]
    return df.select(*doubles).unpivot(
        [], [f"{prefix}{c}" for c in columns], "metric", "value"
    ).select("metric", F.lit("").alias("label"), "value")


def headline_metrics(
    market: DataFrame, tops: DataFrame, concentration: DataFrame, opportunities: DataFrame,
    dimension: str, year: int,
) -> DataFrame:
    """(metric, label, value): the latest year, its leaders, concentration, best segments."""
    latest = F.col("year") == year
    figures = with_growth(market).filter(latest)
    spread = concentration.filter(latest)
    best = leaders(opportunities, "score_primary", [dimension], 10)
    return reduce(DataFrame.unionByName, [
        _long(figures, "", [c for c in figures.columns if c != "year"]),
        tops,
        _long(spread, "concentration_", [c for c in concentration.columns if c != "year"]),
        best.select(
            F.concat(F.lit("opportunity_rank_"), F.col("rank_primary")).alias("metric"),
            F.col(dimension).alias("label"), F.col("score_primary").alias("value"),
        ),
    ])


def headline_formatted(market: DataFrame) -> DataFrame:
    """Yearly totals as report text."""
    return market.select(
        "year",
        compact_amount(F.col(FILLS)).alias("fills_text"),
        compact_amount(F.col("total_claims")).alias("claims_text"),
        money(F.col("total_drug_cost")).alias("cost_text"),
        percent(F.col("selected_class_share")).alias("share_text"),
    )
