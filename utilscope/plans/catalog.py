"""The query catalog: one callable per operator, over the star tables in a folder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from utilscope.functions.numbers import not_integral, to_bigint, to_double
from utilscope.functions.text import masked_id, normalize_text, provider_id
from utilscope.operators import aggregates, concentration, cube, headline, labels, opportunity, profile
from utilscope.operators import prescribers, quality, ranking
from utilscope.operators.classify import (
    candidate_filter, classify, included, label_hits, observed_labels, scope_audit, unmapped,
)
from utilscope.operators.clean import rename_raw, standardize
from utilscope.operators.containment import contained_terms
from utilscope.operators.cube import Slice
from utilscope.plans.market import FILLS, Market, MarketSettings
from utilscope.plans.star import (
    RANKED_STATES, STAR_RULES, order_years, product_labels, raw_rows, star_fact, table,
)
from utilscope.schema import FACT_COLUMNS, GRAIN, RAW_COLUMNS
from utilscope.sources import files, manifest, rule_files
from utilscope.streaming import ingest
from utilscope.streaming.landed import LandedFact
from utilscope.streaming.upkeep import Upkeep
from utilscope.workspace import Workspace, literal_rows, remove, stamp

OTHER = "Other specialties"
RAW_BRAND, RAW_GENERIC = "Brnd_Name", "Gnrc_Name"
LINE = T.StructType([T.StructField("value", T.StringType())])
INGEST_COUNTS = T.StructType([
    T.StructField("ingest_run", T.IntegerType()), T.StructField("scanned", T.LongType()),
    T.StructField("kept", T.LongType()),
])
SOURCE_TABLES = ("lineitem", "orders", "customer", "nation", "part")


class StarMarket(Market):
    """The market of one star-schema folder, and its raw text extract."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        settings = MarketSettings(
            years=order_years(spark, sf_dir), rules=STAR_RULES, ranked_states=RANKED_STATES,
            kept_specialties=3, outlier_min_fills=20, outlier_percentile=0.99,
        )
        super().__init__(Workspace(spark), lambda: star_fact(spark, sf_dir), settings)
        self.spark, self.sf_dir = spark, sf_dir
        self._landing: str | None = None

    @property
    def landing(self) -> str:
        """Folder with the raw CSV extract, one directory per year."""
        if self._landing is None:
            path = self.workspace.path("landing")
            files.write_raw_csv(raw_rows(self.spark, self.sf_dir), path)
            self._landing = path
        return self._landing

    @property
    def latest(self) -> int:
        return self.settings.latest_year

    @property
    def slice(self) -> Slice:
        return Slice(year=self.latest, provider_specialty=OTHER, marketed_name_type="brand-identifiable")

    def raw(self) -> DataFrame:
        return files.read_strict_csv(self.spark, self.landing)

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def labels(self) -> DataFrame:
        return product_labels(self.spark, self.sf_dir).select("brand_name", "generic_name")


_markets: dict[tuple, StarMarket] = {}


def star_market(spark: SparkSession, sf_dir: str) -> StarMarket:
    """The market of a folder, rebuilt when the session or the files behind it change."""
    stamps = [stamp(spark, f"{sf_dir}/{name}.parquet") for name in SOURCE_TABLES]
    key = (spark.sparkContext.applicationId, sf_dir, *stamps)
    if key not in _markets:
        _markets[key] = StarMarket(spark, sf_dir)
    return _markets[key]


# --- sources and sinks -------------------------------------------------------------


def fact_parquet_roundtrip(m: StarMarket) -> DataFrame:
    path = m.workspace.fresh_path("fact_copy")
    files.write_fact(m.fact, path)
    return files.read_fact(m.spark, path, m.fact.schema).select(*FACT_COLUMNS)


def load_class_map(m: StarMarket) -> DataFrame:
    """The map as read from its file, with the product labels each term occurs in."""
    path = m.workspace.fresh_path("class_map")
    rows = [(t.text, t.label_class, t.priority, None) for t in STAR_RULES.terms]
    literal_rows(m.spark, rows, rule_files.CLASS_MAP_SCHEMA).write.option("header", True).csv(path)
    hits = label_hits(m.labels(), STAR_RULES).groupBy("match_term").agg(
        F.count(F.lit(1)).alias("labels")
    )
    mapping = rule_files.read_class_map(m.spark, path)
    return mapping.select("match_term", "component_class", "priority").join(
        hits, "match_term", "left"
    )


def load_exclusions(m: StarMarket) -> DataFrame:
    """Excluded brands as read from their line list, with the parts sold under them."""
    path = m.workspace.fresh_path("excluded_brands")
    lines = ["# excluded brands", "", "  BRAND#13 ", "Brand 13", "#Brand#7", "Brand#21"]
    literal_rows(m.spark, [(line,) for line in lines], LINE).write.text(path)
    excluded = rule_files.read_term_list(m.spark, path)
    parts = m.labels().groupBy(normalize_text(F.col("brand_name")).alias("term")).agg(
        F.count(F.lit(1)).alias("parts")
    )
    return excluded.join(parts, "term")


def json_records_roundtrip(m: StarMarket) -> DataFrame:
    share = F.col("selected_class_fills") / F.col(FILLS)
    segments = m.state_year().withColumn("signal", F.sqrt(share - 0.12))  # NaN below 0.12
    path = m.workspace.fresh_path("segments_json")
    files.write_json_records(segments, path)
    return files.read_json_records(m.spark, path, segments.schema)


def opportunity_export(m: StarMarket) -> DataFrame:
    export = opportunity.search_export(m.state_opportunity(), "provider_state", "Nation_1", 20)
    path = m.workspace.fresh_path("opportunity_csv")
    files.write_csv_report(export, path)
    return m.spark.read.schema(export.schema).option("header", True).csv(path)


def extract_manifest(m: StarMarket) -> DataFrame:
    path = m.workspace.fresh_path("extract")
    counts = manifest.extract(m.raw(), STAR_RULES, m.settings.years, path)
    return manifest.manifest(counts, STAR_RULES)


def extract_fingerprint(m: StarMarket) -> DataFrame:
    return manifest.extract_counts(m.raw(), STAR_RULES).select("year", "fingerprint")


def _ingest_paths(m: StarMarket, name: str) -> ingest.IngestPaths:
    root = m.workspace.fresh_path(name)
    return ingest.IngestPaths(
        landing=f"{root}/landing", sink=f"{root}/sink", checkpoint=f"{root}/checkpoint",
        partials=f"{root}/partials",
    )


def _land(m: StarMarket, paths: ingest.IngestPaths, years: list[int]) -> None:
    """Some years arrive in the landing folder."""
    files.write_raw_csv(m.raw().filter(F.col("year").isin(years)), paths.landing, mode="append")


def _arrivals(m: StarMarket) -> list[list[int]]:
    """The latest year lands after all others."""
    return [m.settings.years[:-1], m.settings.years[-1:]]


def incremental_ingest(m: StarMarket) -> DataFrame:
    """Two arrivals, then a run that finds nothing new."""
    paths = _ingest_paths(m, "ingest")
    for run, years in enumerate([*_arrivals(m), []]):
        if years:
            _land(m, paths, years)
        ingest.ingest_available(m.spark, paths, STAR_RULES, ingest.raw_candidates, run)
    return m.spark.read.parquet(paths.sink).select(*RAW_COLUMNS, "year", "ingest_run")


def ingest_counts(m: StarMarket) -> DataFrame:
    """Rows scanned and kept by each run, over all its micro-batches."""
    paths, seen = _ingest_paths(m, "ingest_counts"), []
    for run, years in enumerate(_arrivals(m)):
        _land(m, paths, years)
        batches = ingest.ingest_available(m.spark, paths, STAR_RULES, ingest.raw_candidates, run)
        seen.append((run, sum(b["scanned"] for b in batches), sum(b["kept"] for b in batches)))
    return literal_rows(m.spark, seen, INGEST_COUNTS)


def _kept_up(m: StarMarket, name: str) -> Upkeep:
    """The fact and totals after two arrivals, each taken by a run of its own."""
    upkeep = Upkeep(m.spark, _ingest_paths(m, name), STAR_RULES)
    for run, years in enumerate(_arrivals(m)):
        _land(m, upkeep.paths, years)
        upkeep.ingest_available(run)
    return upkeep


def incremental_market_year(m: StarMarket) -> DataFrame:
    return _kept_up(m, "ingest_market").market_year()


def incremental_prescribers(m: StarMarket) -> DataFrame:
    """Prescribers of each year as kept up, and whether the estimate from the batches' sketches is in bound."""
    upkeep = _kept_up(m, "ingest_prescribers")
    exact = upkeep.market_year().select("year", "prescribers")
    off = F.abs(F.col("prescribers_estimate") - F.col("prescribers"))
    bound = F.greatest(F.lit(1.0), F.col("prescribers") * prescribers.SKETCH_BOUND)
    return exact.join(upkeep.estimated_prescribers(), "year").select("year", "prescribers", (off <= bound).alias("within_bound"))


def ingest_replaced_file(m: StarMarket) -> DataFrame:
    """The fact after the first year was withdrawn and the latest one delivered anew without odd customers."""
    paths = _ingest_paths(m, "landed")
    landed = LandedFact(m.spark, paths.landing, paths.sink, STAR_RULES)
    _land(m, paths, m.settings.years)
    landed.follow()
    even = (F.col("year") == m.latest) & (F.col("Prscrbr_NPI").cast("double") % 2 == 0)
    remove(m.spark, f"{paths.landing}/year={m.settings.first_year}")
    remove(m.spark, f"{paths.landing}/year={m.latest}")
    files.write_raw_csv(m.raw().filter(even), paths.landing, mode="append")
    landed.follow()
    return landed.fact()


# --- cleaning and classification ----------------------------------------------------


def provider_id_normalize(m: StarMarket) -> DataFrame:
    npi = provider_id(F.col("Prscrbr_NPI"))
    return m.raw().select("Prscrbr_NPI").distinct().select(
        "Prscrbr_NPI", npi.alias("provider_npi"), masked_id(npi).alias("provider_masked_id")
    )


def numeric_coerce(m: StarMarket) -> DataFrame:
    """Quantities written in eight textual forms, coerced and summed by form."""
    quantity = F.col("l_quantity").cast("bigint").cast("string")
    form = ((F.col("l_orderkey") + F.col("l_linenumber")) % 8).cast("int")
    text = (
        F.when(form == 0, quantity)
        .when(form == 1, F.concat(F.lit(" "), quantity, F.lit(" ")))
        .when(form == 2, F.concat(quantity, F.lit(".0")))
        .when(form == 3, F.concat(quantity, F.lit("e2")))
        .when(form == 4, F.concat(quantity, F.lit(".5")))
        .when(form == 5, F.concat(F.lit("1,"), quantity))
        .when(form == 6, F.concat(quantity, F.lit(".25")))
        .otherwise(F.concat(quantity, F.lit(".00000000001")))
    )
    lines = m.table("lineitem").select(form.alias("form"), text.alias("text")).select(
        "form", to_bigint(F.col("text")).alias("whole"), to_double(F.col("text")).alias("number"),
        not_integral(F.col("text")).alias("rejected"),
    )
    return lines.groupBy("form").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("whole").alias("integers"),
        F.sum("whole").alias("integer_sum"),
        F.round(F.sum("number"), 4).alias("double_sum"),
        F.count_if("rejected").alias("rejects"),
    )


def normalize_labels(m: StarMarket) -> DataFrame:
    return m.labels().distinct().select(
        "brand_name", "generic_name",
        normalize_text(F.col("brand_name")).alias("brand_norm"),
        normalize_text(F.col("generic_name")).alias("generic_norm"),
    )


def many_terms_contained(m: StarMarket) -> DataFrame:
    """Which part numbers of three digits or more stand in which customers' names."""
    names = m.table("customer").select("c_name")
    numbers = m.table("part").filter("p_partkey >= 100").select(F.col("p_partkey").cast("string").alias("number"))
    return contained_terms(names, "c_name", numbers, "number")


def raw_labels(m: StarMarket) -> DataFrame:
    return m.labels().distinct()


def fact_by_labels(m: StarMarket) -> DataFrame:
    """The fact from the raw text, decisions taken from the written label dimension."""
    return labels.fact_of(m.raw(), m.workspace.table(
        "label_dimension", lambda: labels.label_dimension(raw_labels(m), STAR_RULES)
    ))


def labels_after_rule_change(m: StarMarket) -> DataFrame:
    """The label dimension after the last term has left the rules."""
    short = replace(STAR_RULES, terms=STAR_RULES.terms[:-1])
    return labels.reclassified(labels.label_dimension(raw_labels(m), STAR_RULES), STAR_RULES, short)


def check_unmapped(m: StarMarket) -> DataFrame:
    """The labels that a rule set without its last term would leave unmapped."""
    short = replace(STAR_RULES, terms=STAR_RULES.terms[:-1])
    found = rename_raw(m.raw()).select("year", "brand_name", "generic_name")
    return unmapped(classify(found, short), short)


# --- ranks, slices, scores ----------------------------------------------------------


def percentile_rank_avg(m: StarMarket) -> DataFrame:
    ranked = ranking.average_percentile(m.provider_order, "fills_percentile")
    return ranked.select("year", "provider_npi", FILLS, "fills_percentile")


def _state_segments(m: StarMarket) -> DataFrame:
    return opportunity.write_segments(
        m.workspace, m.ranked_states(), "provider_state", m.settings.first_year, m.latest
    )


def winsorize(m: StarMarket) -> DataFrame:
    return opportunity.winsorize(m.workspace, _state_segments(m), "fill_cagr", "winsorized_cagr").select(
        "provider_state", "fill_cagr", "winsorized_cagr"
    )


def benchmark_gap(m: StarMarket) -> DataFrame:
    return opportunity.with_benchmark_gap(_state_segments(m)).select(
        "provider_state", "selected_class_share", "benchmark_share", "peer_gap_pp"
    )


def opportunity_components(m: StarMarket) -> DataFrame:
    parts = opportunity.opportunity_components(m.workspace, _state_segments(m))
    return parts.select(
        "provider_state", "scale_component", "growth_component", "class_gap_component",
        "completeness_component",
    )


def cube_dictionary_encode(m: StarMarket) -> DataFrame:
    return cube.dictionary_encode(m.cube_collapsed(), m.dictionaries())


def cube_dictionary_roundtrip(m: StarMarket) -> DataFrame:
    codes = m.dictionaries()
    return cube.dictionary_decode(cube.dictionary_encode(m.cube_collapsed(), codes), codes)


def cube_prescribers_exact(m: StarMarket) -> DataFrame:
    """Prescribers of the collapsed cube's cells, beside the over-counting sum over cells."""
    cell = ["year", *aggregates.CELL, "volume_decile"]
    exact = prescribers.distinct_prescribers(m.prescriber_cells(), cell)
    return exact.join(m.cube_collapsed().select(*cell, "prescriber_cells"), cell)


def cube_prescribers_sketch(m: StarMarket) -> DataFrame:
    """Exact prescribers by state and specialty over all years, and whether the sketches' estimate is in bound."""
    by = ["provider_state", "provider_specialty"]
    return prescribers.compared_prescribers(m.prescriber_cells(), by).drop("prescribers_estimate")


# --- checks -------------------------------------------------------------------------


def parsed_extract(m: StarMarket) -> DataFrame:
    """The fact once more, parsed from the raw text: a layer independent of the stored one."""
    return included(standardize(candidate_filter(m.raw(), STAR_RULES, RAW_BRAND, RAW_GENERIC), STAR_RULES))


def published_market(m: StarMarket) -> DataFrame:
    """The yearly market as published: written as JSON records and read back."""
    path = m.workspace.fresh_path("market_year_json")
    files.write_json_records(m.market_year(), path)
    return files.read_json_records(m.spark, path, m.market_year().schema)


def with_late_arrival(m: StarMarket) -> DataFrame:
    """The fact with part of the latest year delivered twice."""
    again = (F.col("year") == m.latest) & (F.col("provider_npi").cast("bigint") % 7 == 0)
    return m.fact.unionByName(m.fact.filter(again))


def reconcile_counts(m: StarMarket) -> DataFrame:
    path = m.workspace.fresh_path("extract")
    counts = manifest.extract(m.raw(), STAR_RULES, m.settings.years, path)
    return quality.reconcile_counts(counts, manifest.read_extract(m.raw(), path), m.fact)


def reconcile_layers(m: StarMarket) -> DataFrame:
    return quality.compare_layers(
        quality.layer_totals(parsed_extract(m)), quality.layer_totals(m.fact),
        ["rows", *aggregates.MEASURES],
    )


def reconcile_rows(m: StarMarket) -> DataFrame:
    """The fact against a copy in which some rows of the latest year are lost, changed or doubled."""
    number, latest = F.col("provider_npi").cast("bigint"), F.col("year") == m.latest
    claims = F.when(latest & (number % 89 == 0), F.col("total_claims") + 1).otherwise(F.col("total_claims"))
    copy = m.fact.filter(~(latest & (number % 97 == 0))).withColumn("total_claims", claims)
    copy = copy.unionByName(m.fact.filter(latest & (number % 83 == 0) & (number % 89 != 0) & (number % 97 != 0)))
    return quality.reconcile_rows(m.fact, copy, GRAIN)


CATALOG: dict[str, Callable[[StarMarket], DataFrame]] = {
    # sources and sinks
    "csv_strict_scan": lambda m: m.raw(),
    "fact_parquet_roundtrip": fact_parquet_roundtrip,
    "load_class_map": load_class_map,
    "load_exclusions": load_exclusions,
    "json_records_roundtrip": json_records_roundtrip,
    "opportunity_export": opportunity_export,
    "extract_manifest": extract_manifest,
    "extract_fingerprint": extract_fingerprint,
    "incremental_ingest": incremental_ingest,
    "ingest_counts": ingest_counts,
    "incremental_market_year": incremental_market_year,
    "incremental_prescribers": incremental_prescribers,
    "ingest_replaced_file": ingest_replaced_file,
    # cleaning and classification
    "standardize_fact": lambda m: standardize(
        candidate_filter(m.raw(), STAR_RULES, RAW_BRAND, RAW_GENERIC), STAR_RULES
    ),
    "provider_id_normalize": provider_id_normalize,
    "normalize_labels": normalize_labels,
    "numeric_coerce": numeric_coerce,
    "row_unit_costs": lambda m: m.fact.select(
        "year", "provider_npi", "brand_name", "generic_name", "cost_per_claim",
        "cost_per_30day_fill", "beneficiary_count_suppressed",
    ),
    "suppression_profile": lambda m: aggregates.suppression_profile(m.fact),
    "candidate_filter": lambda m: candidate_filter(
        m.raw(), STAR_RULES, RAW_BRAND, RAW_GENERIC
    ).select("year", "Prscrbr_NPI", RAW_BRAND, RAW_GENERIC),
    "allowlist_semi_join": lambda m: m.ranked_states(),
    "headline_formatted": lambda m: headline.headline_formatted(m.market_year()),
    "classify_labels": lambda m: classify(m.labels().distinct(), STAR_RULES),
    "label_dimension": lambda m: labels.label_dimension(raw_labels(m), STAR_RULES),
    "fact_by_labels": fact_by_labels,
    "labels_after_rule_change": labels_after_rule_change,
    "many_terms_contained": many_terms_contained,
    "theta_contains_join": lambda m: label_hits(m.labels(), STAR_RULES),
    "scope_audit": lambda m: scope_audit(rename_raw(m.raw()), STAR_RULES),
    "scope_counts": lambda m: profile.scope_counts(scope_audit(rename_raw(m.raw()), STAR_RULES)),
    "observed_labels": lambda m: observed_labels(rename_raw(m.raw())),
    "selected_class_share": lambda m: aggregates.selected_class_share(m.fact),
    "name_type_mix": lambda m: aggregates.name_type_mix(m.fact),
    "check_unmapped": check_unmapped,
    # yearly aggregates
    "market_year": Market.market_year,
    "class_year": Market.class_year,
    "product_year": Market.product_year,
    "state_year": Market.state_year,
    "specialty_year": Market.specialty_year,
    "city_year": Market.city_year,
    "provider_year": Market.provider_year,
    "dashboard_cube": lambda m: m.cube,
    "cube_collapsed": Market.cube_collapsed,
    "class_row_counts": lambda m: aggregates.class_row_counts(m.fact),
    "grain_duplicates": lambda m: aggregates.duplicate_grain(
        m.table("lineitem"), ["l_orderkey", "l_linenumber"]
    ),
    # ranks and leaders
    "market_size_and_growth": lambda m: headline.market_size_and_growth(m.market_year()),
    "provider_deciles": lambda m: m.provider_deciles().select(
        "year", "provider_npi", FILLS, "volume_decile"
    ),
    "provider_percentile": lambda m: m.provider_percentile().select(
        "year", "provider_npi", FILLS, "volume_percentile"
    ),
    "percentile_rank_avg": percentile_rank_avg,
    "class_leaders": lambda m: ranking.leaders_per_group(
        m.class_year(), ["year"], FILLS, ["drug_class"], 10
    ),
    "city_top_n": lambda m: ranking.leaders_per_group(
        m.city_year(), ["year"], FILLS, ["provider_state", "provider_city"], 100
    ),
    "products_top_n_per_year": lambda m: ranking.leaders_per_group(
        m.product_year(), ["year"], FILLS, aggregates.PRODUCT, 60
    ),
    "product_leaders": lambda m: headline.product_leaders(m.product_year(), m.latest, 20),
    "state_leaders": lambda m: headline.segment_leaders(
        m.state_year(), "provider_state", m.latest, 20
    ),
    "specialty_leaders": lambda m: headline.segment_leaders(
        m.specialty_year(), "provider_specialty", m.latest, 20
    ),
    "outlier_review": Market.outlier_review,
    "product_scatter": lambda m: cube.product_scatter(m.product_year(), m.latest, 80),
    "collapse_rare": lambda m: m.collapsed(),
    # concentration
    "concentration": Market.concentration,
    "pareto_shares": lambda m: concentration.pareto_shares(m.provider_order, 1),
    "lorenz_curve": lambda m: concentration.lorenz_curve(m.provider_order, 1),
    # opportunity
    "segment_pivot": lambda m: opportunity.segment_pivot(
        m.state_year(), "provider_state", m.settings.years
    ),
    "segment_cagr": lambda m: opportunity.segment_cagr(
        m.state_year(), "provider_state", m.settings.first_year, m.latest
    ),
    "benchmark_gap": benchmark_gap,
    "winsorize": winsorize,
    "opportunity_components": opportunity_components,
    "opportunity_state": Market.state_opportunity,
    "opportunity_specialty": Market.specialty_opportunity,
    # cube slices
    "slice_kpis": lambda m: cube.slice_kpis(m.cube_collapsed(), m.slice),
    "slice_yoy": lambda m: cube.slice_yoy(m.cube_collapsed(), m.slice),
    "slice_trend": lambda m: cube.slice_trend(m.cube_collapsed(), m.slice, m.settings.years),
    "slice_class_leaders": lambda m: cube.slice_leaders(
        m.cube_collapsed(), replace(m.slice, drug_class="H"), "drug_class", 8, ignore=("drug_class",)
    ),
    "slice_state_leaders": lambda m: cube.slice_leaders(
        m.cube_collapsed(), m.slice, "provider_state", 10
    ),
    "slice_specialty_leaders": lambda m: cube.slice_leaders(
        m.cube_collapsed(), Slice(year=m.latest, volume_decile=1), "provider_specialty", 8
    ),
    "slice_products": lambda m: cube.slice_products(
        m.product_year(), replace(m.slice, drug_class="H"), 10
    ),
    "cube_prescribers_exact": cube_prescribers_exact,
    "cube_prescribers_sketch": cube_prescribers_sketch,
    "slice_prescribers": lambda m: prescribers.slice_prescribers(m.prescriber_cells(), m.slice),
    "filter_options": lambda m: cube.filter_options(m.cube_collapsed()),
    "cube_dictionary_encode": cube_dictionary_encode,
    "cube_dictionary_roundtrip": cube_dictionary_roundtrip,
    "headline_leaders": Market.headline_leaders,
    "headline_metrics": Market.headline_metrics,
    # profiles
    "profile_rows": lambda m: profile.profile_rows(m.raw()),
    "profile_blank_counts": lambda m: profile.profile_blank_counts(m.raw()),
    "profile_duplicate_keys": lambda m: profile.profile_duplicate_keys(
        m.table("lineitem"), ["l_returnflag"], ["l_orderkey", "l_linenumber"]
    ),
    "profile_label_pairs": lambda m: profile.profile_label_pairs(m.raw(), RAW_BRAND, RAW_GENERIC),
    "profile_numeric_range": lambda m: profile.profile_numeric_range(m.raw()),
    "profile_missing_rate": lambda m: profile.profile_missing_rate(m.raw()),
    # checks and reconciliation
    "check_years": lambda m: quality.check_years(m.fact, m.settings.years),
    "check_grain": lambda m: quality.check_grain(with_late_arrival(m)),
    "provider_grain_validation": lambda m: aggregates.duplicate_grain(with_late_arrival(m), GRAIN),
    "check_published_row": lambda m: quality.check_latest_row(
        published_market(m), m.market_year(), m.latest
    ),
    "check_required": lambda m: quality.check_required(m.fact),
    "check_domains": lambda m: quality.check_domains(m.fact),
    "check_scope": lambda m: quality.check_scope(m.fact, STAR_RULES),
    "check_suppression": lambda m: quality.check_suppression(m.fact),
    "check_score_bounds": lambda m: quality.check_score_bounds(
        m.state_opportunity(), list(m.settings.weights.scenarios)
    ),
    "reconcile_layers": reconcile_layers,
    "reconcile_rows": reconcile_rows,
    "reconcile_counts": reconcile_counts,
    "reconcile_published": lambda m: quality.compare_layers(
        published_market(m), quality.layer_totals(m.fact), aggregates.MEASURES
    ),
    "reconcile_class_rollup": lambda m: quality.reconcile_class_rollup(m.fact),
    "cube_join_fanout": lambda m: quality.cube_join_fanout(m.cube, m.fact),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(plan: Callable[[StarMarket], DataFrame]):
        return lambda spark, sf_dir: plan(star_market(spark, sf_dir))

    return {name: bind(plan) for name, plan in CATALOG.items()}
