"""Slices of the dashboard cube, dictionary encoding, headline figures."""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from utilscope.functions.numbers import ratio, sum_of
from utilscope.operators.aggregates import CELL, MEASURES
from utilscope.operators.ranking import leaders
from utilscope.workspace import literal_rows

FILLS = "total_30day_fills"
YEAR = T.StructType([T.StructField("year", T.IntegerType())])


@dataclass(frozen=True)
class Slice:
    """Equality filters on the cube; None means all."""

    year: int | None = None
    provider_state: str | None = None
    provider_specialty: str | None = None
    drug_class: str | None = None
    marketed_name_type: str | None = None
    volume_decile: int | None = None

    def conditions(self, ignore: tuple[str, ...] = ()) -> list[Column]:
        chosen = {f.name: getattr(self, f.name) for f in fields(self) if f.name not in ignore}
        return [F.col(name) == value for name, value in chosen.items() if value is not None]


def apply_slice(df: DataFrame, s: Slice, ignore: tuple[str, ...] = ()) -> DataFrame:
    return reduce(DataFrame.filter, s.conditions(ignore), df)


def _or_zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).alias(name)


def slice_kpis(cube: DataFrame, s: Slice) -> DataFrame:
    """Totals of a slice; the denominators are at least 1, so an empty slice gives zeros."""
    names = [*MEASURES, "selected_class_fills"]
    totals = apply_slice(cube, s).agg(*map(sum_of, names)).select(*map(_or_zero, names))
    at_least_one = F.greatest(F.col(FILLS), F.lit(1.0))
    return totals.withColumns({
        "cost_per_fill": F.col("total_drug_cost") / at_least_one,
        "selected_class_share": F.col("selected_class_fills") / at_least_one,
    })


def slice_yoy(cube: DataFrame, s: Slice) -> DataFrame:
    """Growth over the year before under the same filters, in one scan of both years."""
    both = apply_slice(cube, s, ignore=("year",)).filter(F.col("year").isin(s.year - 1, s.year))
    per_year = both.groupBy("year").agg(sum_of(FILLS))

    def fills_in(year: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("year") == year, F.col(FILLS))), F.lit(0.0))

    return per_year.agg(
        fills_in(s.year).alias("fills"), fills_in(s.year - 1).alias("prior_fills")
    ).withColumn("yoy_fill_growth", ratio(F.col("fills"), F.col("prior_fills")) - 1)


def slice_trend(cube: DataFrame, s: Slice, years: list[int]) -> DataFrame:
    """Fills of every reporting year under the other filters, with growth over the previous."""
    filtered = apply_slice(cube, s, ignore=("year",))
    per_year = filtered.groupBy("year").agg(sum_of(FILLS))
    calendar = literal_rows(cube.sparkSession, [(y,) for y in years], YEAR)
    # One row per reporting year.
    trend = calendar.join(per_year, "year", "left").select("year", _or_zero(FILLS))
    prior = F.lag(FILLS).over(Window.partitionBy().orderBy("year"))
    return trend.withColumn("growth", ratio(F.col(FILLS), prior) - 1)


def slice_leaders(
    cube: DataFrame, s: Slice, label: str, k: int, ignore: tuple[str, ...] = ()
) -> DataFrame:
    """Top labels of a slice by fills. The class panel ignores the class filter."""
    per_label = apply_slice(cube, s, ignore).groupBy(label).agg(sum_of(FILLS))
    return leaders(per_label, FILLS, [label], k)


def slice_products(products: DataFrame, s: Slice, k: int) -> DataFrame:
    """Top products under the filters a product row can answer: year, class and name type."""
    ignored = ("provider_state", "provider_specialty", "volume_decile")
    return leaders(
        apply_slice(products, s, ignore=ignored), FILLS,
        ["brand_name", "generic_name", "drug_class", "marketed_name_type"], k,
    )


def filter_options(cube: DataFrame) -> DataFrame:
    """Distinct labels of each filter with their place in label order, from one scan."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("filter_name"), F.col(c).alias("label")) for c in CELL
    ]))
    options = cube.select(pairs.alias("p")).select("p.*").distinct()
    place = F.row_number().over(Window.partitionBy("filter_name").orderBy("label"))
    return options.withColumn("position", place)


def cube_collapsed(cube: DataFrame) -> DataFrame:
    """Cube regrouped after rare labels were merged.

    Prescribers are summed over cells, so one seen in two merged cells counts twice; the
    column is therefore named `prescriber_cells`.
    """
    return cube.groupBy("year", *CELL, "volume_decile").agg(
        *map(sum_of, MEASURES),
        F.sum("prescribers").alias("prescriber_cells"),
        sum_of("selected_class_fills"),
    )


def dictionaries(cube: DataFrame) -> DataFrame:
    """`filter_name`, `label`, `code`: codes count from 0 in label order."""
    return filter_options(cube).select(
        "filter_name", "label", (F.col("position") - 1).alias("code")
    )


def dictionary_encode(cube: DataFrame, codes: DataFrame) -> DataFrame:
    """Label columns as dictionary codes, measures rounded to their published decimals.

    Dictionaries hold the cube's labels (hundreds), never fact keys.
    """
    for c in CELL:
        lookup = codes.filter(F.col("filter_name") == c).select(
            F.col("label").alias(c), F.col("code").alias(f"{c}_code")
        )
        cube = cube.join(lookup, c)
    rounded = {
        "total_30day_fills": F.bround("total_30day_fills", 1),
        "total_drug_cost": F.bround("total_drug_cost", 2),
        "selected_class_fills": F.bround("selected_class_fills", 1),
    }
    return cube.withColumns(rounded).drop(*CELL)


def dictionary_decode(coded: DataFrame, codes: DataFrame) -> DataFrame:
    for c in CELL:
        lookup = codes.filter(F.col("filter_name") == c).select(
            F.col("code").alias(f"{c}_code"), F.col("label").alias(c)
        )
        coded = coded.join(lookup, f"{c}_code").drop(f"{c}_code")
    return coded


def product_scatter(products: DataFrame, year: int, k: int) -> DataFrame:
    """Largest products of a year with their cost per fill."""
    labels = ["brand_name", "generic_name", "drug_class", "marketed_name_type"]
    top = leaders(products.filter(F.col("year") == year), FILLS, labels, k)
    cost = ratio(F.col("total_drug_cost"), F.col(FILLS))
    return top.select(*labels, FILLS, "total_drug_cost", "prescribers", cost.alias("cost_per_fill"))
