"""Concentration of a measure over providers: Gini, HHI, Pareto shares, Lorenz curve.

Everything is a plain aggregate of the bins of `RankedValues`: the row numbers of a bin stand in
for its stretch of the sorted array of the textbook formulas.  Sums of products are taken in exact
decimals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utilscope.functions.numbers import big, ratio, scaled
from utilscope.operators.ranking import RankedValues

PARETO_PERCENTS = (1, 5, 10, 20)
LORENZ_STEP = 2


def _measured(order: RankedValues, scale: int) -> DataFrame:
    """Bins: value `x` of `c` rows, `before` them in descending order, of `n` values in the group."""
    return order.bins.select(
        *order.by, "before", F.col("rows").alias("c"), F.col("group_values").alias("n"),
        scaled(F.col(order.value), scale).alias("x"),
    )


def _top_count(n: Column, percent: int) -> Column:
    """ceil(n * percent / 100) in integers, at least 1."""
    return F.greatest(F.lit(1), F.floor((n * percent + 99) / 100).cast("bigint"))


def concentration(order: RankedValues, scale: int) -> DataFrame:
    """`prescribers`, `gini`, `hhi` and `top_<p>_share` of every group."""
    x, c, before = F.col("x"), F.col("c"), F.col("before")
    kept = x >= 0  # negatives count in the shares but not in the Gini coefficient
    shares = {
        p: F.sum(x * F.greatest(F.lit(0), F.least(c, _top_count(F.col("n"), p) - before)))
        for p in PARETO_PERCENTS
    }
    numbers = big(c) * big(before) + big(F.expr("c * (c + 1) div 2"))  # the bin's row numbers, added up
    sums = _measured(order, scale).filter(x.isNotNull()).groupBy(*order.by).agg(
        F.sum(c).alias("prescribers"),
        F.sum(x * c).alias("total"),
        F.sum(big(x) * big(x) * big(c)).alias("squares"),
        F.sum(F.when(kept, c).otherwise(F.lit(0))).alias("m"),
        F.sum(F.when(kept, x * c)).alias("s"),
        F.sum(F.when(kept, numbers * big(x))).alias("weighted"),
        *[share.alias(f"top_{p}") for p, share in shares.items()],
    )
    # Non-negative values fill positions 1..m from the top, so ascending rank is m + 1 - row.
    m, s = F.col("m"), F.col("s")
    ascending = big(m + 1) * big(s) - F.col("weighted")
    gini = ratio(ascending.cast("double") * 2, m.cast("double") * s) - ratio(m + 1, m)
    total = F.col("total").cast("double")
    return sums.select(
        *order.by,
        "prescribers",
        F.round(F.coalesce(gini, F.lit(0.0)), 12).alias("gini"),
        F.round(F.coalesce(ratio(F.col("squares"), total * total), F.lit(0.0)), 12).alias("hhi"),
        *[
            F.coalesce(ratio(F.col(f"top_{p}"), total), F.lit(0.0)).alias(f"top_{p}_share")
            for p in PARETO_PERCENTS
        ],
    )


def pareto_shares(order: RankedValues, scale: int) -> DataFrame:
    """Long form: one row per group and top percentage, with its provider count."""
    wide = concentration(order, scale)
    points = F.explode(F.array(*[
        F.struct(
            F.lit(p).alias("top_percent"),
            _top_count(F.col("prescribers"), p).alias("providers"),
            F.col(f"top_{p}_share").alias("fill_share"),
        )
        for p in PARETO_PERCENTS
    ]))
    return wide.select(*order.by, points.alias("p")).select(*order.by, "p.*")


def lorenz_curve(order: RankedValues, scale: int) -> DataFrame:
    """Cumulative share of the measure held by the smallest 0, 2, .. 100 % of providers.

    Grid percentage p covers round(n * p / 100) providers, halves to even; a bin lies below that
    number, above it, or is cut by it.
    """
    x, c, n = F.col("x"), F.col("c"), F.col("n")
    grid = range(0, 101, LORENZ_STEP)

    def covered(percent: int) -> Column:
        """round(n * percent / 100) in integers."""
        rounded = F.expr(f"(n * {percent} + 50) div 100")
        on_the_half = (n * percent + 50) % 100 == 0
        return rounded - F.when(on_the_half & (rounded % 2 == 1), F.lit(1)).otherwise(F.lit(0))

    below = n - F.col("before") - c  # values smaller than the bin's
    held = {p: F.sum(x * F.greatest(F.lit(0), F.least(c, covered(p) - below))) for p in grid}
    sums = _measured(order, scale).groupBy(*order.by).agg(
        F.sum(x * c).alias("total"), F.array(*held.values()).alias("held")
    )
    points = F.posexplode("held").alias("place", "sum")
    share = ratio(F.col("sum"), F.col("total"))
    return sums.select(*order.by, "total", points).select(
        *order.by, (F.col("place") * LORENZ_STEP).cast("int").alias("provider_pct"),
        (F.coalesce(share, F.lit(0.0)) * 100).alias("fill_pct"),
    )
