"""A written dimension of label decisions: each distinct label is classified once.

A fact has few labels and very many rows. The dimension carries the decisions of all of them, in scope
or not; rows get theirs, and rows out of scope go, by one join whose kind Spark chooses by the
dimension's size. After a change of the rules only labels that it can touch are classified again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utilscope.functions.text import contains_any, normalize_text
from utilscope.operators.classify import DECISION_COLUMNS, INCLUDED, classify, in_scope
from utilscope.operators.clean import add_unit_costs, clean_text, coerce_numbers, rename_raw
from utilscope.rules import ScopeRules
from utilscope.schema import FACT_COLUMNS

LABEL = ["brand_name", "generic_name"]


def decided(labels: DataFrame, rules: ScopeRules) -> DataFrame:
    """Labels with their decisions and whether they are in scope."""
    known = F.coalesce(in_scope(rules), F.lit(False)).alias("in_scope")
    return classify(labels.select(*LABEL), rules).select(*LABEL, *DECISION_COLUMNS, known)


def label_dimension(df: DataFrame, rules: ScopeRules) -> DataFrame:
    """The decisions of every distinct label of `df`."""
    return decided(df.select(*LABEL).distinct(), rules)


def with_decisions(df: DataFrame, dimension: DataFrame) -> DataFrame:
    """The rows of `df` whose label is in the dimension, with its decisions."""
    renamed = dimension.drop("in_scope").withColumnsRenamed({c: f"_{c}" for c in LABEL})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in LABEL]
    return df.join(renamed, same).drop(*[f"_{c}" for c in LABEL])


def fact_of(raw: DataFrame, dimension: DataFrame) -> DataFrame:
    """The included fact rows of raw text rows, as `included(standardize(candidates))` has them."""
    wanted = dimension.filter(F.col("in_scope") & (F.col("scope_status") == INCLUDED))
    typed = coerce_numbers(clean_text(with_decisions(rename_raw(raw), wanted)))
    return add_unit_costs(typed).select(*FACT_COLUMNS)


def touched(before: ScopeRules, after: ScopeRules) -> Column:
    """Whether a label's decision may differ between two rule sets.

    Terms, patterns and brands that only one set has touch the labels that hold them. A change of
    anything that classes are made from, or of the order of common terms, touches all.
    """
    def entries(rules):
        return {(t.text, t.label_class, t.priority) for t in rules.terms}

    common = entries(before) & entries(after)
    orders = [[t for t in rules.by_priority() if (t.text, t.label_class, t.priority) in common] for rules in (before, after)]
    shared = ("combinations", "selected_classes", "excluded_class", "excluded_term", "unmapped_class")
    if orders[0] != orders[1] or any(getattr(before, c) != getattr(after, c) for c in shared):
        return F.lit(True)
    terms = sorted({text for text, _, _ in entries(before) ^ entries(after)})
    patterns = sorted(set(before.excluded_patterns) ^ set(after.excluded_patterns))
    brands = sorted(set(before.excluded_brands) ^ set(after.excluded_brands))
    raw, normalized = F.lower(F.coalesce("generic_name", F.lit(""))), normalize_text(F.col("generic_name"))
    held = contains_any(normalized, [*terms, *patterns]) | contains_any(raw, [t.lower() for t in terms])
    return held | normalize_text(F.col("brand_name")).isin(brands) if brands else held


def reclassified(dimension: DataFrame, before: ScopeRules, after: ScopeRules) -> DataFrame:
    """The dimension under a new rule set; labels that the change can't touch keep their rows as they are."""
    again = touched(before, after)
    return dimension.filter(~again).unionByName(decided(dimension.filter(again), after))
