"""Exact and estimated prescribers of merged cells against distinct counts over the rows."""

import pytest
from pyspark.sql import functions as F

from utilscope.operators import prescribers
from utilscope.operators.aggregates import CELL
from utilscope.operators.cube import Slice
from utilscope.plans import catalog
from utilscope.workspace import Workspace

SF_DIR = "/root/testdata/sf0.001"
PROVIDERS = 100_000  # several ranges of numbers


@pytest.fixture(scope="module")
def rows(spark):
    """Providers seen in several cells: state by number, specialty and class by year."""
    n = F.col("id")
    return spark.range(PROVIDERS * 3).select(
        (2022 + n % 3).cast("int").alias("year"), F.lpad((n % PROVIDERS).cast("string"), 10, "0").alias("provider_npi"),
        F.when(n % PROVIDERS < 7, F.lit(None)).otherwise(F.concat(F.lit("S"), (n % PROVIDERS % 5).cast("string"))).alias("provider_state"),
        F.when(n % 11 == 0, F.lit("")).otherwise(F.concat(F.lit("T"), (n % 4).cast("string"))).alias("provider_specialty"),
        F.concat(F.lit("C"), (n % 7).cast("string")).alias("drug_class"), F.lit("brand").alias("marketed_name_type"),
        F.lit(12).cast("bigint").alias("total_claims"), F.lit(1.5).alias("total_30day_fills"), F.lit(2.25).alias("total_drug_cost"),
        (n % 2 == 0).alias("is_selected_class"), (n % 10 + 1).cast("int").alias("volume_decile"),
    )


@pytest.fixture(scope="module")
def cells(spark, rows, tmp_path_factory):
    workspace = Workspace(spark, str(tmp_path_factory.mktemp("prescribers")))
    deciles = rows.groupBy("year", "provider_npi").agg(
        F.min("volume_decile").alias("volume_decile"), F.min("provider_state").alias("provider_state"),
        F.min("provider_specialty").alias("provider_specialty"))
    deciles = workspace.write(workspace.path("deciles"), deciles)
    numbers = prescribers.provider_numbers(workspace, deciles)
    assert numbers.agg(F.min("provider_number"), F.max("provider_number"), F.count_distinct("provider_number")).first()[:] == (
        1, PROVIDERS, PROVIDERS)
    return workspace.table("cells", lambda: prescribers.prescriber_cube(rows, deciles, numbers))


def plain(rows, by):
    shown = rows.withColumns({c: F.when(F.col(c) != "", F.col(c)).otherwise("Unknown") for c in ("provider_state", "provider_specialty")})
    return sorted(map(tuple, shown.groupBy(*by).agg(F.count_distinct("provider_npi")).collect()), key=str)


@pytest.mark.parametrize("by", [["year"], ["provider_state"], ["year", "provider_specialty"], [*CELL], []])
def test_merged_cells_count_each_prescriber_once(rows, cells, by):
    assert sorted(map(tuple, prescribers.distinct_prescribers(cells, by).collect()), key=str) == plain(rows, by)


@pytest.mark.parametrize("by", [["year"], ["provider_state"], ["drug_class", "year"], [*CELL]])
def test_estimates_keep_their_bound(cells, by):
    found = prescribers.compared_prescribers(cells, by).collect()
    assert found and all(r.within_bound for r in found)
    assert any(r.prescribers_estimate != r.prescribers for r in found if r.prescribers > 5000) or len(by) > 2


def test_slices_over_the_years(rows, cells):
    s = Slice(year=2023, provider_state="S1", provider_specialty="T2")
    of = rows.where("provider_state = 'S1' and provider_specialty = 'T2'")
    found = {r.year: r.prescribers for r in prescribers.slice_prescribers(cells, s).collect()}
    assert found == {**dict(plain(of, ["year"])), None: of.select("provider_npi").distinct().count()}
    none = prescribers.slice_prescribers(cells, Slice(provider_state="nowhere")).collect()
    assert [(r.year, r.prescribers) for r in none] == [(None, 0)]


def test_cells_alone_are_read(spark):
    market = catalog.star_market(spark, SF_DIR)
    market.prescriber_cube  # noqa: B018
    plan = catalog.CATALOG["slice_prescribers"](market)._jdf.queryExecution().executedPlan().toString()
    assert "bits:binary" in plan
    assert "provider_npi" not in plan and "sketch" not in plan
