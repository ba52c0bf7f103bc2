"""Label classification by ingredient rules.

The rules compile to column expressions evaluated where the row is: no join, no
shuffle, no UDF, and the same code runs on a batch, a stream or a distinct-label list.
The rule rows are one literal array that is filtered per label, so generated code stays
small (and compiled) however many terms there are.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from utilscope.functions.text import contains_any, normalize_text
from utilscope.operators.containment import contained_terms
from utilscope.rules import ScopeRules
from utilscope.workspace import literal_rows

DECISION_COLUMNS = [
    "drug_class", "matched_terms", "is_selected_class", "marketed_name_type", "scope_status",
]
INCLUDED = "included"
EXCLUDED = "excluded_non_drug"
TERM = T.StructType([T.StructField("match_term", T.StringType())])


def _rule_hits(normalized: Column, rules: ScopeRules) -> Column:
    """Array of the rules (term, label_class) found in a label, highest precedence first."""
    rows = [
        F.struct(F.lit(t.text).alias("term"), F.lit(t.label_class).alias("label_class"))
        for t in rules.by_priority()
    ]
    if not rows:
        return F.array().cast("array<struct<term:string,label_class:string>>")
    return F.filter(F.array(*rows), lambda rule: F.contains(normalized, rule["term"]))


def _class_of(hits: Column, rules: ScopeRules) -> Column:
    """A combination that the hits cover, else the class of the first hit."""
    classes = hits["label_class"]
    chosen = F.coalesce(F.get(classes, F.lit(0)), F.lit(rules.unmapped_class))
    for combination in reversed(rules.combinations):
        covered = [F.array_contains(classes, F.lit(c)) for c in combination.requires]
        chosen = F.when(reduce(and_, covered), F.lit(combination.label_class)).otherwise(chosen)
    return chosen


def _matched_terms(hits: Column) -> Column:
    return F.sort_array(F.array_distinct(hits["term"]))


def classify(
    df: DataFrame, rules: ScopeRules, brand: str = "brand_name", generic: str = "generic_name"
) -> DataFrame:
    """Add the five decision columns to every row."""
    generic_norm, brand_norm, device = F.col("_generic"), F.col("_brand"), F.col("_device")
    hits = F.col("_hits")
    return (
        df.withColumns({"_generic": normalize_text(F.col(generic)), "_brand": normalize_text(F.col(brand))})
        .withColumns({
            "_device": contains_any(generic_norm, list(rules.excluded_patterns)),
            "_hits": _rule_hits(generic_norm, rules),
        })
        .withColumns({
            "drug_class": F.when(device, F.lit(rules.excluded_class)).otherwise(
                _class_of(hits, rules)
            ),
            "matched_terms": F.when(device, F.lit(rules.excluded_term)).otherwise(
                F.array_join(_matched_terms(hits), "|")
            ),
            "marketed_name_type": F.when(device, F.lit("not applicable"))
            .when(brand_norm == generic_norm, F.lit("generic-name listed"))
            .otherwise(F.lit("brand-identifiable")),
            "scope_status": F.when(device, F.lit(EXCLUDED)).otherwise(F.lit(INCLUDED)),
        })
        .withColumn("is_selected_class", F.col("drug_class").isin(list(rules.selected_classes)))
        .drop("_generic", "_brand", "_device", "_hits")
    )


def candidate_filter(
    df: DataFrame, rules: ScopeRules, brand: str = "brand_name", generic: str = "generic_name"
) -> DataFrame:
    """Rows whose raw generic text holds a mapped term and whose brand is not excluded."""
    return df.filter(in_scope(rules, brand, generic))


def in_scope(
    rules: ScopeRules, brand: str = "brand_name", generic: str = "generic_name"
) -> Column:
    raw_generic = F.lower(F.coalesce(F.col(generic), F.lit("")))
    wanted = contains_any(raw_generic, [t.lower() for t in rules.distinct_terms()])
    if not rules.excluded_brands:
        return wanted
    return wanted & ~normalize_text(F.col(brand)).isin(list(rules.excluded_brands))


def included(df: DataFrame) -> DataFrame:
    return df.filter(F.col("scope_status") == INCLUDED)


def observed_labels(df: DataFrame) -> DataFrame:
    """Distinct (year, brand, generic) labels."""
    return df.select("year", "brand_name", "generic_name").distinct()


def scope_audit(df: DataFrame, rules: ScopeRules) -> DataFrame:
    """Every observed label with its decision, and a flag for likely truncated combinations.

    A label that lists more ingredients (split by '/') than the map recognizes was probably
    abbreviated at the source, and its class may miss a component.
    """
    audit = classify(observed_labels(df), rules)
    hits = F.when(F.col("matched_terms") == "", F.lit(0)).otherwise(
        F.size(F.split("matched_terms", r"\|"))
    )
    parts = F.size(F.split("generic_name", "/"))
    return audit.withColumn("has_unrecognized_part", parts > hits).drop("is_selected_class")


def label_hits(df: DataFrame, rules: ScopeRules, label: str = "generic_name") -> DataFrame:
    """One row per distinct label and mapped term it contains."""
    labels = df.select(label).distinct().withColumn("_text", normalize_text(F.col(label)))
    terms = literal_rows(df.sparkSession, [(t,) for t in rules.distinct_terms()], TERM)
    hits = contained_terms(labels, "_text", terms, "match_term")
    return labels.join(hits, "_text").select(label, "match_term")


def unmapped(df: DataFrame, rules: ScopeRules) -> DataFrame:
    """Included rows that no rule maps: the labels, with their row counts."""
    return (
        included(df)
        .filter(F.col("drug_class") == rules.unmapped_class)
        .groupBy("year", "brand_name", "generic_name")
        .agg(F.count(F.lit(1)).alias("row_count"))
    )
