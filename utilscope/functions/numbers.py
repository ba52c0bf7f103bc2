"""Numeric coercion, exact sums and denominator-safe ratios.

Utilization measures are published with a fixed number of decimals.  Summing them as
scaled BIGINT is exact, so a total does not depend on the order in which tasks finish,
and it stays on Tungsten's primitive path (a wide DECIMAL buffer would not).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from utilscope.schema import SCALES

_NUMBER = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
_DIGITS = r"^\s*[+-]?[0-9]{1,18}\s*$"
_NUMERIC = rf"^\s*{_NUMBER}\s*$"
_NUMERIC_OR_INFINITE = rf"^\s*({_NUMBER}|[+-]?(?i:inf(inity)?))\s*$"


def to_double(text: Column) -> Column:
    """Plain or exponent notation to DOUBLE; all else, NaN and infinities to NULL."""
    return F.when(text.rlike(_NUMERIC), text.try_cast("double"))


def to_bigint(text: Column) -> Column:
    """As `to_double` for integers: '12', '12.0' and '1.2e1' give 12, '12.5' gives NULL.

    A failing integer cast is costly, so only text of plain digits is cast directly.
    """
    exact, near = text.try_cast("decimal(38,10)"), text.try_cast("double")
    # The decimal cuts off what lies beyond its scale; the double still sees it.
    whole = text.rlike(_NUMERIC) & (exact == F.floor(exact)) & (near == F.floor(near))
    return F.when(text.rlike(_DIGITS), text.try_cast("bigint")).when(
        whole, exact.try_cast("bigint")
    )


def not_integral(text: Column) -> Column:
    """True for a number that an integer column cannot hold (a row to reject)."""
    suspect = text.isNotNull() & ~text.rlike(_DIGITS)
    return suspect & text.rlike(_NUMERIC_OR_INFINITE) & to_bigint(text).isNull()


def finite(c: Column) -> Column:
    """NaN and infinities to NULL."""
    bad = F.isnan(c) | c.isin(float("inf"), float("-inf"))
    return F.when(~bad, c)


def ratio(numerator: Column, denominator: Column) -> Column:
    """DOUBLE quotient, NULL for a zero or missing denominator."""
    d = denominator.cast("double")
    return F.when(d != 0, numerator.cast("double") / d)


def scaled(c: Column, scale: int) -> Column:
    """A value with `scale` published decimals as a whole number of its last unit.

    A value with more decimals is an error, never rounded.
    """
    units = c * F.lit(float(10**scale))
    whole = F.rint(units)
    same = F.abs(units - whole) <= F.greatest(F.abs(units), F.lit(1.0)) * 1e-9
    message = F.concat(F.lit(f"more than {scale} decimals: "), c.cast("string"))
    return F.when(units.isNull() | same, whole.cast("bigint")).otherwise(
        F.raise_error(message).cast("bigint")
    )


def unscaled(units: Column, scale: int) -> Column:
    return units.cast("double") / F.lit(float(10**scale))


def exact_sum(c: Column, scale: int) -> Column:
    return unscaled(F.sum(scaled(c, scale)), scale)


def sum_of(name: str) -> Column:
    """Exact total of a named measure, under the same name."""
    column = F.col(name)
    total = exact_sum(column, SCALES[name]) if name in SCALES else F.sum(column)
    return total.alias(name)


def exact_sum_where(flag: Column, name: str) -> Column:
    """Total of a measure over flagged rows, 0 where none is flagged."""
    scale = SCALES[name]
    return unscaled(F.sum(F.when(flag, scaled(F.col(name), scale)).otherwise(F.lit(0))), scale)


def big(c: Column) -> Column:
    """BIGINT as a DECIMAL wide enough for sums of products of row numbers and measures."""
    return c.cast("decimal(19,0)")
