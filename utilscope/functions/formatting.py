"""Human-readable amounts for headline reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def compact_amount(value: Column, prefix: str = "") -> Column:
    """1.23B from a billion on, 4.5M from a million on, else whole with separators."""
    v = value.cast("double")
    whole = F.format_number(v, 0)
    return F.concat(
        F.lit(prefix),
        F.when(v >= 1e9, F.format_string("%.2fB", v / 1e9))
        .when(v >= 1e6, F.format_string("%.1fM", v / 1e6))
        .otherwise(whole),
    )


def money(value: Column) -> Column:
    return compact_amount(value, "$")


def percent(value: Column, digits: int = 1) -> Column:
    """Percent text; a dash for a missing or non-finite share."""
    shown = F.format_string(f"%.{digits}f%%", value * 100)
    return F.when(value.isNull() | F.isnan(value), F.lit("—")).otherwise(shown)
