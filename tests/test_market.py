"""Aggregates, cube, slices, checks and the whole batch job on a small raw extract."""

import random

import pytest
from pyspark.sql import functions as F
from raw_fixture import raw_row, write_year

from utilscope.operators import aggregates, cube, headline, profile, quality
from utilscope.operators.cube import Slice
from utilscope.plans import batch
from utilscope.plans.market import MarketSettings
from utilscope.rules import DIABETES_RULES
from utilscope.sources import files

PRODUCTS = [("Ozempic", "Semaglutide"), ("Metformin Hcl", "Metformin Hcl"), ("Januvia", "Sitagliptin Phosphate"),
            ("Lantus", "Insulin Glargine"), ("V-Go 20", "Sub-Q Insulin Device, 20 Unit"),
            ("Wegovy", "Semaglutide"), ("Aspirin", "Aspirin")]
YEARS = [2022, 2023, 2024]


@pytest.fixture(scope="module")
def landing(tmp_path_factory):
    rng = random.Random(7)
    folder = tmp_path_factory.mktemp("landing")
    for year in YEARS:
        rows = []
        for npi in range(60):
            state = ["FL", "CA", "TX", "NY", "ZZ", ""][npi % 6]
            for brand, generic in PRODUCTS:
                if rng.random() < 0.8:
                    claims = rng.randint(11, 400)
                    rows.append(raw_row(
                        Prscrbr_NPI=str(1003000000 + npi), Prscrbr_State_Abrvtn=state,
                        Prscrbr_Type=["Endocrinology", "Family Practice", ""][npi % 3],
                        Prscrbr_City=f"City {npi % 8}", Brnd_Name=brand, Gnrc_Name=generic,
                        Tot_Clms=str(claims), Tot_30day_Fills=f"{claims * 1.3:.1f}",
                        Tot_Day_Suply=str(claims * 30), Tot_Drug_Cst=f"{claims * 17.37:.2f}",
                        Tot_Benes=str(rng.randint(11, 50)) if rng.random() < 0.7 else "",
                    ))
        write_year(folder, year, rows)
    return str(folder)


@pytest.fixture(scope="module")
def built(spark, landing, tmp_path_factory):
    paths = batch.BatchPaths(landing, str(tmp_path_factory.mktemp("published")))
    settings = MarketSettings(years=YEARS, kept_specialties=1, outlier_min_fills=50, outlier_percentile=0.9)
    return batch.run(spark, paths, settings), paths


@pytest.fixture(scope="module")
def market(built):
    return built[0]


def published(spark, built, name):
    return spark.read.json(built[1].under(name))


def test_batch_publishes_and_passes_every_check(spark, built):
    verdicts = published(spark, built, "checks").collect()
    assert len(verdicts) == 12 and all(r.passed for r in verdicts)
    headline_rows = {r.metric: r.value for r in published(spark, built, "headline").collect()}
    assert headline_rows["prescribers"] == headline_rows["concentration_prescribers"] == 60
    assert headline_rows["total_claims"] > 0 and "top_state" in headline_rows
    assert published(spark, built, "state_opportunity").count() == 4  # ZZ and Unknown are not ranked
    assert published(spark, built, "lorenz").count() == 51 * 3


def test_profile_and_manifest(spark, built, landing):
    row = published(spark, built, "manifest").filter("year = 2024").first()
    kept = published(spark, built, "profile_rows").filter("year = 2024").first()
    assert row.filtered_row_count == kept.row_count < row.source_rows_scanned
    assert kept.column_count == 22
    by_file = published(spark, built, "manifest_files").filter("year = 2024")
    assert by_file.agg({"candidate_rows": "sum"}).first()[0] == row.filtered_row_count
    blanks = published(spark, built, "profile_blanks").filter(
        "year = 2024 AND column_name = 'GE65_Tot_Benes'").first()
    assert blanks.blank_count == kept.row_count
    ranges = published(spark, built, "profile_numbers").filter("column_name = 'Tot_Clms'").collect()
    assert all(11 <= r.min_value <= r.max_value <= 400 for r in ranges)
    assert published(spark, built, "profile_duplicates").agg(F.sum("duplicate_keys")).first()[0] == 0


def test_scope(market):
    labels = {r.brand_name for r in market.fact.select("brand_name").distinct().collect()}
    assert labels == {"Ozempic", "Metformin Hcl", "Januvia", "Lantus"}


def test_unmapped_label_stops_the_job(spark, landing, tmp_path):
    from dataclasses import replace
    from utilscope.operators.classify import classify, unmapped

    rules = replace(DIABETES_RULES, terms=DIABETES_RULES.terms[:10])
    labels = spark.createDataFrame([(2024, "x", "aspirin")], "year int, brand_name string, generic_name string")
    assert unmapped(classify(labels, rules), rules).count() == 1


def test_shares_of_a_year_add_up(market):
    for row in market.class_year().groupBy("year").agg(F.sum("fill_share").alias("s")).collect():
        assert row.s == pytest.approx(1)


def test_prescribers_are_distinct(market):
    row = market.market_year().filter("year = 2024").first()
    brute = market.fact.filter("year = 2024").select("provider_npi").distinct().count()
    assert (row.prescribers, row.products) == (brute, 4)


def test_unknown_bucket(market):
    states = {r.provider_state for r in market.state_year().collect()}
    assert "Unknown" in states and "" not in states


def test_cube_prescribers_match_a_distinct_count(market):
    keys = ["year", "provider_state", "provider_specialty", "drug_class", "marketed_name_type", "volume_decile"]
    from utilscope.functions.text import or_unknown

    fact = market.fact.withColumns({c: or_unknown(F.col(c)) for c in keys[1:3]})
    deciles = market.provider_deciles().select("year", "provider_npi", "volume_decile")
    brute = fact.join(deciles, ["year", "provider_npi"]).groupBy(keys).agg(
        F.count_distinct("provider_npi").alias("prescribers"))
    assert market.cube.select(brute.columns).exceptAll(brute).count() == 0
    assert market.cube.count() == brute.count()


def test_slices_compose(market):
    c = market.cube
    whole = cube.slice_kpis(c, Slice(year=2024)).first()
    parts = [cube.slice_kpis(c, Slice(year=2024, provider_state=s)).first().total_claims
             for s in ("FL", "CA", "TX", "NY", "ZZ", "Unknown")]
    assert sum(parts) == whole.total_claims
    empty = cube.slice_kpis(c, Slice(year=2024, provider_state="nowhere")).first()
    assert (empty.total_claims, empty.cost_per_fill) == (0, 0.0)


def test_slice_growth(market):
    s = Slice(year=2024, drug_class="Insulin")
    trend = {r.year: r for r in cube.slice_trend(market.cube, s, YEARS).collect()}
    yoy = cube.slice_yoy(market.cube, s).first()
    assert yoy.yoy_fill_growth == pytest.approx(trend[2024].growth)
    assert trend[2022].growth is None
    first = cube.slice_yoy(market.cube, Slice(year=2022)).first()
    assert first.yoy_fill_growth is None and first.prior_fills == 0


def test_class_panel_ignores_the_class_filter(market):
    s = Slice(year=2024, drug_class="Insulin")
    assert cube.slice_leaders(market.cube, s, "drug_class", 8, ignore=("drug_class",)).count() == 4
    assert cube.slice_leaders(market.cube, s, "drug_class", 8).count() == 1
    assert cube.slice_products(market.product_year(), s, 10).first().brand_name == "Lantus"


def test_dictionary_round_trip(market):
    codes = cube.dictionaries(market.cube)
    back = cube.dictionary_decode(cube.dictionary_encode(market.cube, codes), codes)
    assert back.select(market.cube.columns).exceptAll(market.cube).count() == 0
    states = codes.filter("filter_name = 'provider_state'").orderBy("code").collect()
    assert [r.code for r in states] == list(range(6)) and [r.label for r in states] == sorted(r.label for r in states)


def test_collapsed_cube_keeps_totals(market):
    collapsed = market.cube_collapsed()
    assert {r[0] for r in collapsed.select("provider_specialty").distinct().collect()} >= {"Other specialties"}
    assert collapsed.agg(F.sum("total_claims")).first() == market.cube.agg(F.sum("total_claims")).first()
    assert "prescriber_cells" in collapsed.columns


def test_deciles_differ_by_at_most_one(market):
    sizes = market.provider_deciles().groupBy("year", "volume_decile").count().collect()
    for year in YEARS:
        counts = [r["count"] for r in sizes if r.year == year]
        assert len(counts) == 10 and max(counts) - min(counts) <= 1


def test_checks_find_damage(market):
    fact = market.fact
    doubled = fact.unionByName(fact.limit(1))
    assert quality.check_grain(doubled).first().violations == 1
    broken = fact.limit(3).withColumns({
        "provider_npi": F.lit("12"), "total_claims": F.lit(5).cast("bigint"),
        "drug_class": F.lit("Unmapped"), "brand_name": F.lit("Wegovy"),
    })
    failed = {
        r.check_name
        for check in (quality.check_required(broken), quality.check_domains(broken),
                      quality.check_scope(broken, DIABETES_RULES))
        for r in check.filter(~F.col("passed")).collect()
    }
    assert failed == {"provider_npi_length", "total_claims_below_minimum", "unmapped_class", "excluded_brand"}
    years = quality.check_years(fact, [2023, 2024, 2025]).filter("NOT passed").collect()
    assert {r.year for r in years} == {2022, 2025}
    with pytest.raises(quality.CheckFailed):
        quality.require(quality.check_grain(doubled))


def test_layers_disagree_when_rows_are_lost(market):
    left, right = quality.layer_totals(market.fact), quality.layer_totals(market.fact.filter("year > 2022"))
    rows = quality.compare_layers(left, right, ["rows", "total_claims"]).collect()
    assert {(r.year, r.passed) for r in rows} == {(2022, False), (2023, True), (2024, True)}


def test_missing_rate_and_suppression_agree(spark, market, landing):
    rate = aggregates.suppression_profile(market.fact).filter("year = 2024").first()
    assert 0 < rate.suppressed_share < 1
    raw = files.read_strict_csv(spark, landing)
    assert profile.profile_missing_rate(raw).count() == 3


def test_growth_of_the_first_year_is_null(market):
    rows = headline.market_size_and_growth(market.market_year()).orderBy("year").collect()
    assert rows[0].yoy_fill_growth is None
    assert rows[1].yoy_fill_growth == pytest.approx(
        rows[1].total_30day_fills / rows[0].total_30day_fills - 1)
