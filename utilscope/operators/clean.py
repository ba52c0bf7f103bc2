"""From raw text rows to the typed, classified fact."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utilscope.functions.numbers import not_integral, ratio, to_bigint, to_double
from utilscope.functions.text import masked_id, provider_id, strip_text
from utilscope.operators.classify import classify
from utilscope.rules import ScopeRules
from utilscope.schema import (
    FACT_COLUMNS, FLOAT_COLUMNS, INTEGER_COLUMNS, RAW_COLUMNS, RAW_TO_STANDARD, TEXT_COLUMNS,
)


def rename_raw(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(RAW_TO_STANDARD)


def rejected_rows(raw: DataFrame) -> DataFrame:
    """Raw rows with a fractional or infinite number in an integer column."""
    integer_raw = [c for c in RAW_COLUMNS if RAW_TO_STANDARD[c] in INTEGER_COLUMNS]
    return raw.filter(reduce(or_, [not_integral(F.col(c)) for c in integer_raw]))


def clean_text(df: DataFrame) -> DataFrame:
    """Identifier normalized, text stripped and never NULL."""
    # The identifier is padded before it is stripped, so inner padding counts as characters.
    npi = provider_id(F.col("provider_npi"))
    text = {c: strip_text(F.col(c)) for c in TEXT_COLUMNS if c != "provider_npi"}
    return df.withColumns(
        {**text, "provider_npi": strip_text(npi), "provider_masked_id": masked_id(npi)}
    )


def coerce_numbers(df: DataFrame) -> DataFrame:
    """Numeric columns typed; text that is no number becomes NULL, never 0."""
    integers = {c: to_bigint(F.col(c)) for c in INTEGER_COLUMNS}
    floats = {c: to_double(F.col(c)) for c in FLOAT_COLUMNS}
    return df.withColumns({**integers, **floats})


def add_unit_costs(df: DataFrame) -> DataFrame:
    cost = F.col("total_drug_cost")
    return df.withColumns({
        "cost_per_claim": ratio(cost, F.col("total_claims")),
        "cost_per_30day_fill": ratio(cost, F.col("total_30day_fills")),
        "beneficiary_count_suppressed": F.col("total_beneficiaries").isNull(),
    })


def standardize(raw: DataFrame, rules: ScopeRules, kept: tuple[str, ...] = ()) -> DataFrame:
    """Raw 22-column text rows (plus `year`) to typed rows with every derived column, and the columns `kept`.

    Rows of every scope status are kept; filter with `classify.included` for the fact.
    """
    typed = coerce_numbers(clean_text(rename_raw(raw)))
    return add_unit_costs(classify(typed, rules)).select(*FACT_COLUMNS, *kept)


class RejectedRows(ValueError):
    """Raised when raw rows hold numbers their integer columns cannot represent."""


def require_integral(raw: DataFrame) -> DataFrame:
    """`raw` itself, after checking that no row would have to be rejected."""
    examples = rejected_rows(raw).limit(5).collect()
    if examples:
        raise RejectedRows(f"fractional values in integer columns, for example {examples}")
    return raw
