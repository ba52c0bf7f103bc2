"""Reusable yearly aggregates of the fact.

All of them are ratio-of-sums and combine on the map side.  One distinct count per
aggregate keeps Spark's two-step plan (dedupe on group + provider, then count), which
spreads a hot group over many tasks; two distinct counts would multiply the rows instead,
so they are taken by separate aggregates and joined on the year.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utilscope.functions.numbers import exact_sum_where, ratio, scaled, sum_of, unscaled
from utilscope.functions.text import or_unknown

MEASURES = ["total_claims", "total_30day_fills", "total_drug_cost"]
PRODUCT = ["drug_class", "brand_name", "generic_name", "marketed_name_type"]
CELL = ["provider_state", "provider_specialty", "drug_class", "marketed_name_type"]


def measure_sums() -> list[Column]:
    return [sum_of(name) for name in MEASURES]


def prescribers() -> Column:
    return F.count_distinct(F.col("provider_npi")).alias("prescribers")


def selected_fills() -> Column:
    return exact_sum_where(F.col("is_selected_class"), "total_30day_fills").alias(
        "selected_class_fills"
    )


def unit_costs() -> dict[str, Column]:
    cost = F.col("total_drug_cost")
    return {
        "avg_cost_per_claim": ratio(cost, F.col("total_claims")),
        "avg_cost_per_30day_fill": ratio(cost, F.col("total_30day_fills")),
    }


def selected_share() -> Column:
    return ratio(F.col("selected_class_fills"), F.col("total_30day_fills"))


def market_year(fact: DataFrame) -> DataFrame:
    """Totals, prescribers, products, unit costs and selected share of each year."""
    totals = fact.groupBy("year").agg(*measure_sums(), prescribers(), selected_fills())
    products = (
        fact.select("year", "brand_name", "generic_name").distinct()
        .groupBy("year").agg(F.count(F.lit(1)).alias("products"))
    )
    # One row per reporting year on both sides.
    return (
        totals.join(F.broadcast(products), "year")
        .withColumns({**unit_costs(), "selected_class_share": selected_share()})
        .select(
            "year", *MEASURES, "prescribers", "products", "avg_cost_per_claim",
            "avg_cost_per_30day_fill", "selected_class_share",
        )
    )


def class_year(fact: DataFrame) -> DataFrame:
    """Totals of each class and its share of the year's fills."""
    per_class = fact.groupBy("year", "drug_class").agg(*measure_sums(), prescribers())
    year_units = F.sum(scaled(F.col("total_30day_fills"), 1)).over(Window.partitionBy("year"))
    return per_class.withColumn(
        "fill_share", ratio(F.col("total_30day_fills"), unscaled(year_units, 1))
    )


def product_year(fact: DataFrame) -> DataFrame:
    return (
        fact.groupBy("year", *PRODUCT).agg(*measure_sums(), prescribers()).withColumns(unit_costs())
    )


def segment_year(fact: DataFrame, dimension: str) -> DataFrame:
    """Totals by year and one provider attribute, with beneficiary completeness.

    Completeness is the share of claims in rows whose beneficiary count is published.
    """
    known_claims = F.sum(
        F.when(F.col("total_beneficiaries").isNotNull(), F.col("total_claims")).otherwise(F.lit(0))
    )
    return (
        fact.groupBy("year", or_unknown(F.col(dimension)).alias(dimension))
        .agg(*measure_sums(), prescribers(), selected_fills(), known_claims.alias("_known"))
        .withColumn("beneficiary_completeness", ratio(F.col("_known"), F.col("total_claims")))
        .drop("_known")
    )


def city_year(fact: DataFrame) -> DataFrame:
    keys = [or_unknown(F.col(c)).alias(c) for c in ("provider_state", "provider_city")]
    return fact.groupBy("year", *keys).agg(*measure_sums(), prescribers())


def provider_totals(fact: DataFrame) -> DataFrame:
    """One row per year and provider; attributes are the smallest seen, so repeatable.

    The fact is first collapsed with the attributes as keys, which Spark can hash; the
    smallest text is then taken over the few variants that a provider has.
    """
    attributes = ["provider_masked_id", "provider_state", "provider_city", "provider_specialty"]
    variants = fact.groupBy("year", "provider_npi", *attributes).agg(
        *measure_sums(), selected_fills()
    )
    return variants.groupBy("year", "provider_npi").agg(
        *[F.min(c).alias(c) for c in attributes], *measure_sums(), sum_of("selected_class_fills")
    )


def class_row_counts(fact: DataFrame) -> DataFrame:
    return fact.groupBy("year", "drug_class").agg(F.count(F.lit(1)).alias("row_count"))


def name_type_mix(fact: DataFrame) -> DataFrame:
    return fact.groupBy("year", "marketed_name_type").agg(*measure_sums(), prescribers())


def selected_class_share(fact: DataFrame) -> DataFrame:
    """Selected fills against all fills, by year."""
    return (
        fact.groupBy("year").agg(sum_of("total_30day_fills"), selected_fills())
        .withColumn("selected_class_share", selected_share())
    )


def suppression_profile(fact: DataFrame) -> DataFrame:
    """Rows without a published beneficiary count, by year."""
    return (
        fact.groupBy("year").agg(
            F.count(F.lit(1)).alias("row_count"),
            F.count_if(F.col("beneficiary_count_suppressed")).alias("suppressed_rows"),
        )
        .withColumn("suppressed_share", ratio(F.col("suppressed_rows"), F.col("row_count")))
    )


def duplicate_grain(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("duplicate_count"))
        .filter(F.col("duplicate_count") > 1)
    )


def provider_cells(fact: DataFrame) -> DataFrame:
    """Fact collapsed to year x provider x cube labels: one row per prescriber in a cell.

    Rows are dealt by year and provider, so a join with a provider's ranks needs no second shuffle; a
    provider has at most a row per product in a year.
    """
    labels = [or_unknown(F.col(c)).alias(c) for c in ("provider_state", "provider_specialty")]
    return fact.repartition("year", "provider_npi").groupBy(
        "year", "provider_npi", *labels, "drug_class", "marketed_name_type"
    ).agg(*measure_sums(), selected_fills())


def dashboard_cube(fact: DataFrame, deciles: DataFrame) -> DataFrame:
    """Filterable cube by year, labels and provider volume decile.

    The fact is collapsed to provider cells before the join, so a provider with very many
    rows costs the join a handful of rows, and prescribers are a plain count.
    `deciles` holds year, provider_npi and volume_decile.
    """
    return (
        provider_cells(fact)
        .join(deciles.select("year", "provider_npi", "volume_decile"), ["year", "provider_npi"])
        .groupBy("year", *CELL, "volume_decile")
        .agg(
            *measure_sums(),
            F.count(F.lit(1)).alias("prescribers"),
            sum_of("selected_class_fills"),
        )
    )
