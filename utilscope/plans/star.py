"""Provider x product x year cells from star-schema order tables.

lineitem, orders, customer, nation and part play the roles of dispensings, prescriber and
product, which gives the operators a fact of any size to run on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utilscope.functions.numbers import scaled, unscaled
from utilscope.functions.text import masked_id
from utilscope.operators.classify import candidate_filter, classify, included
from utilscope.operators.clean import add_unit_costs
from utilscope.rules import Combination, ScopeRules, Term
from utilscope.schema import FACT_COLUMNS, RAW_TO_STANDARD, STANDARD_COLUMNS

RANKED_STATES = tuple(f"NATION_{i}" for i in range(22))  # leaves three nations off the list

STAR_RULES = ScopeRules(
    terms=(
        Term("hot", "H", 10), Term("widget", "W", 20), Term("cold", "C", 30),
        Term("gear", "G", 40), Term("ring", "R", 50), Term("rod", "D", 60),
        Term("plate", "P", 70), Term("gizmo", "Z", 80), Term("bolt", "B", 80),
    ),
    combinations=(
        Combination(("G", "H"), "Fixed G/H"), Combination(("W", "C"), "W/C combination"),
    ),
    excluded_patterns=("anvil",),
    excluded_brands=("brand 13",),
    selected_classes=("H", "Fixed G/H"),
    excluded_term="anvil",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_years(spark: SparkSession, sf_dir: str) -> list[int]:
    """The reporting years: every year from the first order to the last."""
    year = F.year("o_orderdate")
    first, last = table(spark, sf_dir, "orders").agg(F.min(year), F.max(year)).first()
    return list(range(first, last + 1))


def product_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part key with its brand and generic label; small sizes are sold under the generic name."""
    brand = F.when(F.col("p_size") <= 10, F.col("p_name")).otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), brand.alias("brand_name"),
        F.col("p_name").alias("generic_name"),
    )


def _prescriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders with their customer's attributes."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment"
    )
    return orders.select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.year("o_orderdate").alias("year")
    ).join(customers, "o_custkey")


def cells(spark: SparkSession, sf_dir: str, labels: DataFrame) -> DataFrame:
    """One typed row per year, provider and product, for the products in `labels`.

    Lines are collapsed to order x label before they meet the orders, so distinct orders become a plain
    count, and label filters cut lines ahead of the first shuffle. Rows are shuffled twice: lines by order,
    which serves the grouping and the join, then by year and provider. An order or provider with very many
    rows is one task's work, but folds there to a row per label. As a provider's year is written by one
    task, later groupings by provider combine it on the map side.
    """
    older = F.col("l_linestatus") == "F"  # stands in for the 65+ part of a cell

    def part_of(value):
        return F.sum(F.when(older, value).otherwise(F.lit(0)))

    cents = scaled(F.col("l_extendedprice"), 2)
    units = scaled(F.col("l_quantity"), 1)
    per_order = (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_linestatus")
        .join(labels, "l_partkey")
        .repartition("l_orderkey")
        .groupBy("l_orderkey", "brand_name", "generic_name")
        .agg(
            F.count(F.lit(1)).alias("lines"), F.sum(units).alias("units"),
            F.sum(cents).alias("cents"), part_of(F.lit(1)).alias("old_lines"),
            part_of(units).alias("old_units"), part_of(cents).alias("old_cents"),
        )
    )
    sums = ["lines", "units", "cents", "old_lines", "old_units", "old_cents"]
    grouped = (
        per_order.join(_prescriptions(spark, sf_dir), "l_orderkey")
        .repartition("year", "o_custkey")
        .groupBy("year", "o_custkey", "c_nationkey", "c_mktsegment", "brand_name", "generic_name")
        .agg(*[F.sum(c).alias(c) for c in sums], F.count(F.lit(1)).alias("orders"))
    )
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    key, older_lines = F.col("o_custkey"), F.col("old_lines") > 0
    older_only = {
        "age65_total_claims": F.col("old_lines"),
        "age65_total_30day_fills": unscaled(F.col("old_units"), 1),
        "age65_total_drug_cost": unscaled(F.col("old_cents"), 2),
        "age65_total_day_supply": F.col("old_units") * 3,
    }
    return grouped.join(nations, "c_nationkey").select(
        "year",
        F.lpad(key.cast("string"), 10, "0").alias("provider_npi"),
        F.concat(F.lit("Customer, "), key.cast("string")).alias("provider_last_org_name"),
        F.lit("").alias("provider_first_name"),
        F.concat("n_name", F.lit(" "), (key % 20).cast("string")).alias("provider_city"),
        F.col("n_name").alias("provider_state"),
        F.col("c_nationkey").cast("string").alias("provider_state_fips"),
        F.when(key % 97 == 0, F.lit("")).otherwise(F.col("c_mktsegment")).alias("provider_specialty"),
        F.lit("S").alias("provider_type_source"),
        "brand_name",
        "generic_name",
        F.col("lines").alias("total_claims"),
        unscaled(F.col("units"), 1).alias("total_30day_fills"),
        (F.col("units") * 3).alias("total_day_supply"),
        unscaled(F.col("cents"), 2).alias("total_drug_cost"),
        F.when(F.col("units") >= 110, F.col("orders")).alias("total_beneficiaries"),
        F.when(older_lines, F.lit("")).otherwise(F.lit("*")).alias("age65_suppression_flag"),
        *[F.when(older_lines, value).alias(name) for name, value in older_only.items()],
        F.lit("#").alias("age65_bene_suppression_flag"),
        F.lit(None).cast("bigint").alias("age65_total_beneficiaries"),
    )


def star_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classified fact. Labels are classified once, and filtered before any line is read."""
    labels = product_labels(spark, sf_dir)
    names = ["brand_name", "generic_name"]
    decided = included(classify(candidate_filter(labels.select(*names).distinct(), STAR_RULES), STAR_RULES))
    typed = cells(spark, sf_dir, labels.join(decided.select(*names), names)).withColumn(
        "provider_masked_id", masked_id(F.col("provider_npi"))
    )
    return add_unit_costs(typed.join(decided, names)).select(*FACT_COLUMNS)


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unfiltered cells as the 22 raw text columns plus `year`.

    Numbers are written as the source writes them; some identifiers carry a trailing '.0'
    and cities are padded, as input for the cleaning operators.
    """
    typed = cells(spark, sf_dir, product_labels(spark, sf_dir))
    to_raw = {standard: raw for raw, standard in RAW_TO_STANDARD.items()}
    number = F.col("provider_npi").cast("bigint")
    plain = number.cast("string")
    text = {
        "provider_npi": F.when(number % 7 == 0, F.concat(plain, F.lit(".0"))).otherwise(plain),
        "provider_city": F.concat(F.lit(" "), F.col("provider_city"), F.lit(" ")),
        **{c: F.col(c).cast("decimal(18,1)") for c in ("total_30day_fills", "age65_total_30day_fills")},
        **{c: F.col(c).cast("decimal(18,2)") for c in ("total_drug_cost", "age65_total_drug_cost")},
    }
    columns = [
        F.coalesce(text.get(c, F.col(c)).cast("string"), F.lit("")).alias(to_raw[c])
        for c in STANDARD_COLUMNS
    ]
    return typed.select(*columns, "year")
