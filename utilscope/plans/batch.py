"""The whole batch job: raw CSV extracts to the fact, its reports and the checks.

    spark-submit utilscope/plans/batch.py --landing <dir> --out <dir> --years 2022 2023 2024

`landing` holds one `year=YYYY` directory of CSV files per reporting year.
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utilscope.operators import aggregates, concentration, cube, headline, labels, profile, quality, ranking
from utilscope.operators.classify import included, scope_audit, unmapped
from utilscope.operators.clean import rename_raw, require_integral, standardize
from utilscope.plans.market import FILLS, Market, MarketSettings
from utilscope.rules import ScopeRules
from utilscope.schema import GRAIN
from utilscope.sources import files, manifest, rule_files
from utilscope.workspace import Workspace


class UnmappedLabels(ValueError):
    """Raised when included rows carry labels that no rule maps."""


@dataclass(frozen=True)
class BatchPaths:
    landing: str
    out: str

    def under(self, name: str) -> str:
        return f"{self.out}/{name}"


def extract(spark: SparkSession, paths: BatchPaths, settings: MarketSettings) -> tuple[DataFrame, DataFrame]:
    """One pass over the raw CSV: the candidate rows, stored, and their counts by year (published by file too).

    All later steps read the candidates, a small part of the source.
    """
    raw = files.read_strict_csv(spark, paths.landing)
    counts = manifest.extract(raw, settings.rules, settings.years, paths.under("candidates"))
    extracted = manifest.manifest(counts, settings.rules)
    files.write_json_records(
        extracted.join(files.file_sizes(spark, paths.landing), "year"), paths.under("manifest")
    )
    files.write_json_records(
        manifest.file_counts(spark, paths.under("candidates"), paths.landing), paths.under("manifest_files")
    )
    return manifest.read_extract(raw, paths.under("candidates")), counts


def build_fact(candidates: DataFrame, paths: BatchPaths, settings: MarketSettings) -> DataFrame:
    """Type, classify and store the fact; stops on rows or labels it cannot represent.

    Each distinct label is classified once; the decisions are published beside the fact.
    """
    decisions = labels.label_dimension(rename_raw(candidates), settings.rules)
    decisions.write.mode("overwrite").parquet(paths.under("labels"))
    dimension = candidates.sparkSession.read.schema(decisions.schema).parquet(paths.under("labels"))
    fact = labels.fact_of(require_integral(candidates), dimension)
    files.write_fact(fact, paths.under("fact"), balance=True)
    stored = files.read_fact(fact.sparkSession, paths.under("fact"), fact.schema)
    missing = unmapped(stored, settings.rules).limit(20).collect()
    if missing:
        raise UnmappedLabels(f"labels without a class: {missing}")
    return stored


def write_profiles(candidates: DataFrame, paths: BatchPaths, settings: MarketSettings) -> None:
    """Profiles of the candidate rows and the audit of every label decision."""
    audit = scope_audit(rename_raw(candidates), settings.rules)
    records = {
        "profile_rows": profile.profile_rows(candidates),
        "profile_blanks": profile.profile_blank_counts(candidates),
        "profile_duplicates": profile.profile_duplicate_keys(candidates, ["year"], profile.RAW_KEY),
        "profile_labels": profile.profile_label_pairs(candidates, "Brnd_Name", "Gnrc_Name"),
        "profile_numbers": profile.profile_numeric_range(candidates),
        "profile_missing": profile.profile_missing_rate(candidates),
        "scope_counts": profile.scope_counts(audit),
    }
    for name, df in records.items():
        files.write_json_records(df, paths.under(name))
    files.write_csv_report(audit.orderBy("year", "generic_name", "brand_name"), paths.under("scope_audit"))


def reports(market: Market) -> dict[str, DataFrame]:
    """Every published table by name."""
    s, order, products = market.settings, market.provider_order, market.product_year()
    states, specialties = market.state_opportunity(), market.specialty_opportunity()
    collapsed, codes = market.cube_collapsed(), market.dictionaries()
    leaders_of = ranking.leaders_per_group
    return {
        "market_year": headline.with_growth(market.market_year()),
        "class_year": market.class_year(),
        "product_year": products,
        "top_products": leaders_of(products, ["year"], FILLS, aggregates.PRODUCT, 60),
        "state_year": market.state_year(),
        "specialty_year": market.specialty_year(),
        "city_year": market.city_year(),
        "class_row_counts": aggregates.class_row_counts(market.fact),
        "top_cities": leaders_of(
            market.city_year(), ["year"], FILLS, ["provider_state", "provider_city"], 100
        ),
        "cube": cube.dictionary_encode(collapsed, codes),
        "cube_dictionaries": codes,
        "state_opportunity": states,
        "specialty_opportunity": specialties,
        "concentration": market.concentration(),
        "lorenz": concentration.lorenz_curve(order, 1),
        "product_scatter": cube.product_scatter(products, s.latest_year, 80),
        "class_leaders": leaders_of(market.class_year(), ["year"], FILLS, ["drug_class"], 10),
        "product_leaders": headline.product_leaders(products, s.latest_year, 20),
        "state_leaders": headline.segment_leaders(
            market.state_year(), "provider_state", s.latest_year, 20
        ),
        "specialty_leaders": headline.segment_leaders(
            market.specialty_year(), "provider_specialty", s.latest_year, 20
        ),
        "outlier_review": market.outlier_review(),
        "grain_duplicates": aggregates.duplicate_grain(market.fact, GRAIN),
        "headline": market.headline_metrics(),
        **headline.top_rows(
            market.class_year(), products, market.state_year(), market.specialty_year(), s.latest_year
        ),
        "top_opportunities": ranking.leaders(states, "score_primary", ["provider_state"], 10),
        "headline_text": headline.headline_formatted(market.market_year()),
    }


def transform_summary(counts: DataFrame, fact: DataFrame, rules: ScopeRules) -> DataFrame:
    """By year: candidate rows, rows excluded and kept, unmapped rows; `class_row_counts` has the classes."""
    kept = fact.groupBy("year").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col("drug_class") == rules.unmapped_class).alias("unmapped_rows"),
    )
    read = counts.select(
        "year", F.col("candidate_rows").alias("input_candidate_rows"),
        F.col("excluded_rows").alias("excluded_non_drug_rows"),
    )
    return read.join(kept, "year", "full")


def checks(market: Market, candidates: DataFrame, counts: DataFrame) -> dict[str, DataFrame]:
    """Every check of the built tables against the candidate rows and their counts."""
    fact, rules, s = market.fact, market.settings.rules, market.settings
    reparsed = included(standardize(candidates, rules))
    return {
        "years": quality.check_years(fact, s.years),
        "grain": quality.check_grain(fact),
        "required": quality.check_required(fact),
        "domains": quality.check_domains(fact),
        "scope": quality.check_scope(fact, rules),
        "suppression": quality.check_suppression(fact),
        "layers": quality.compare_layers(
            quality.layer_totals(reparsed), quality.layer_totals(fact),
            ["rows", *aggregates.MEASURES],
        ),
        "counts": quality.reconcile_counts(counts, candidates, fact),
        "class_rollup": quality.reconcile_class_rollup(fact),
        "cube_fanout": quality.cube_join_fanout(market.cube, fact),
        "scores": quality.check_score_bounds(market.state_opportunity(), list(s.weights.scenarios)),
    }


def run(spark: SparkSession, paths: BatchPaths, settings: MarketSettings, strict: bool = True) -> Market:
    """Build and publish everything under `paths.out`; with `strict`, fail on a failed check."""
    candidates, counts = extract(spark, paths, settings)
    write_profiles(candidates, paths, settings)
    fact = build_fact(candidates, paths, settings)
    market = Market(Workspace(spark), lambda: fact, settings, stored=True)
    published = reports(market) | {"transform_summary": transform_summary(counts, fact, settings.rules)}
    for name, df in published.items():
        files.write_json_records(df, paths.under(name))
    verdicts = quality.all_checks({
        **checks(market, candidates, counts),
        "published_market": quality.check_latest_row(
            files.read_json_records(spark, paths.under("market_year"), published["market_year"].schema),
            market.market_year(), settings.latest_year,
        ),
    })
    files.write_json_records(verdicts, paths.under("checks"))
    if strict:
        quality.require(files.read_json_records(spark, paths.under("checks"), verdicts.schema))
    return market


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("--landing", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--years", nargs="+", type=int, required=True)
    parser.add_argument("--class-map", help="CSV of match_term, component_class, priority, notes")
    parser.add_argument("--excluded-brands", help="text file, one brand per line")
    parser.add_argument("--excluded-patterns", help="text file, one generic pattern per line")
    parser.add_argument("--combinations", help="CSV of requires (classes joined by '|'), label_class")
    parser.add_argument("--selected-classes", help="text file, one class per line")
    parser.add_argument("--weights", help="JSON object of scenarios and their component weights")
    parser.add_argument("--states", help="text file, one state per line, that are ranked")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("market-utilization").getOrCreate()
    settings = MarketSettings(years=args.years)
    rules = settings.rules
    if args.class_map:
        rules = replace(rules, terms=rule_files.load_terms(spark, args.class_map))
    if args.excluded_brands:
        rules = replace(rules, excluded_brands=rule_files.load_term_list(spark, args.excluded_brands))
    if args.excluded_patterns:
        rules = replace(
            rules, excluded_patterns=rule_files.load_term_list(spark, args.excluded_patterns)
        )
    if args.combinations:
        rules = replace(rules, combinations=rule_files.load_combinations(spark, args.combinations))
    if args.selected_classes:
        rules = replace(rules, selected_classes=rule_files.load_lines(spark, args.selected_classes))
    settings = replace(settings, rules=rules)
    if args.weights:
        settings = replace(settings, weights=rule_files.load_weights(spark, args.weights))
    if args.states:
        settings = replace(settings, ranked_states=rule_files.load_lines(spark, args.states))
    run(spark, BatchPaths(args.landing, args.out), settings).workspace.remove()
    spark.stop()


if __name__ == "__main__":
    main()
