"""Weighted, percentile-based opportunity score of market segments.

The input is one row per segment and year (`segment_year`).  It is folded to one row per
segment and written, so the benchmark, the clipping limits and the ranks read a small
table instead of the fact.  Growth, gaps and scores are rounded to ten places before they
are ranked: values that are equal on paper must tie, whatever the last bit of their
quotients.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utilscope.functions.numbers import exact_sum, finite, ratio
from utilscope.operators.ranking import add_average_percentiles, add_ranks, quantiles
from utilscope.rules import COMPONENTS, ScoreWeights
from utilscope.workspace import Workspace

PLACES = 10

# Wording of the interpretation column.
WITH_GAP = "Observed scale with selected-class share below the national benchmark"
WITHOUT_GAP = "Observed scale/growth signal without a positive selected-class gap"
# End of fixed values.


def segment_pivot(segments: DataFrame, dimension: str, years: list[int]) -> DataFrame:
    """Fills of each segment, one column per year, in one pass (no self-join)."""
    return segments.groupBy(dimension).agg(*[
        F.max(F.when(F.col("year") == y, F.col("total_30day_fills"))).alias(f"fills_{y}")
        for y in years
    ])


def cagr(first: Column, last: Column, periods: int) -> Column:
    """Compound growth per period; NULL without a positive base."""
    growth = ratio(last, first)
    root = F.sqrt(growth) if periods == 2 else F.pow(growth, F.lit(1.0 / periods))
    return F.round(root - 1, PLACES)


def latest_segments(
    segments: DataFrame, dimension: str, first_year: int, last_year: int
) -> DataFrame:
    """Last-year row of each segment with its first-year fills and growth, in one pass.

    Segments absent from the last year vanish.
    """
    last = F.col("year") == last_year
    measures = [c for c in segments.columns if c not in ("year", dimension)]
    first_fills, last_fills = F.col(f"fills_{first_year}"), F.col("total_30day_fills")
    folded = segments.filter(F.col("year").isin(first_year, last_year)).groupBy(dimension).agg(
        F.max(F.when(F.col("year") == first_year, last_fills)).alias(f"fills_{first_year}"),
        *[F.max(F.when(last, F.col(c))).alias(c) for c in measures],
        F.max("year").alias("year"),
    )
    return folded.filter(F.col("year") == last_year).withColumn(
        "fill_cagr", cagr(first_fills, last_fills, last_year - first_year)
    )


def segment_cagr(
    segments: DataFrame, dimension: str, first_year: int, last_year: int
) -> DataFrame:
    """Growth of the segments present in the last year."""
    return latest_segments(segments, dimension, first_year, last_year).select(
        dimension, f"fills_{first_year}",
        F.col("total_30day_fills").alias(f"fills_{last_year}"), "fill_cagr",
    )


def with_benchmark_gap(current: DataFrame) -> DataFrame:
    """Selected share against the share of all ranked segments together, in points."""
    benchmark = current.agg(ratio(
        exact_sum(F.col("selected_class_fills"), 1), exact_sum(F.col("total_30day_fills"), 1)
    )).scalar()
    share = ratio(F.col("selected_class_fills"), F.col("total_30day_fills"))
    gap = F.greatest(F.col("benchmark_share") - F.col("selected_class_share"), F.lit(0.0)) * 100
    known = F.col("selected_class_share").isNotNull()
    return current.withColumns(
        {"selected_class_share": share, "benchmark_share": benchmark}
    ).withColumn("peer_gap_pp", F.when(known, F.round(gap, PLACES)))


def winsorize(workspace: Workspace, df: DataFrame, value: str, out: str) -> DataFrame:
    """Clip to the 5th and 95th percentile; missing becomes the median.

    Below four known values nothing is clipped and missing becomes 0.
    """
    x = finite(F.col(value))
    limits = quantiles(workspace, df.select(x.alias("x")), "x", [0.05, 0.5, 0.95])
    limits = limits.select(F.struct("q", "known")).scalar()
    low, middle, high = (F.get(limits.getField("q"), F.lit(i)) for i in range(3))
    clipped = F.when(x.isNotNull(), F.least(F.greatest(x, low), high)).otherwise(middle)
    few = limits.getField("known") < 4
    result = F.when(few, F.coalesce(x, F.lit(0.0))).otherwise(clipped)
    return df.withColumn(out, F.round(result, PLACES))


def write_segments(
    workspace: Workspace, segments: DataFrame, dimension: str, first_year: int, last_year: int
) -> DataFrame:
    """`latest_segments`, written."""
    latest = latest_segments(segments, dimension, first_year, last_year)
    return workspace.write(workspace.fresh_path("segments"), latest)


def opportunity_components(workspace: Workspace, current: DataFrame) -> DataFrame:
    """The written segments with their four component percentiles."""
    current = winsorize(workspace, with_benchmark_gap(current), "fill_cagr", "winsorized_cagr")
    current = current.withColumns({
        # log1p keeps the order of fills, so the fills are ranked as they are.
        "_scale": F.col("total_30day_fills"),
        "_growth": F.col("winsorized_cagr"),
        "_class_gap": F.col("peer_gap_pp"),
        "_completeness": F.round("beneficiary_completeness", PLACES),
    })
    basis = {f"_{name}": f"{name}_component" for name in COMPONENTS}
    return add_average_percentiles(workspace, current, basis).drop(*basis)


def score(workspace: Workspace, components: DataFrame, weights: ScoreWeights) -> DataFrame:
    """Scenario scores and ranks (ties share the best rank), rank range, interpretation."""
    scenarios = weights.scenarios
    scored = components.withColumns({
        f"score_{scenario}": F.round(
            100 * reduce(add, [F.col(f"{c}_component") * w[c] for c in COMPONENTS]), PLACES
        )
        for scenario, w in scenarios.items()
    })
    ranked = {f"score_{scenario}": f"rank_{scenario}" for scenario in scenarios}
    scored = add_ranks(workspace, scored, ranked)
    ranks = [F.col(f"rank_{scenario}") for scenario in scenarios]
    spread = F.greatest(*ranks) - F.least(*ranks) if len(ranks) > 1 else F.lit(0)
    label = F.when(F.col("peer_gap_pp") > 0, F.lit(WITH_GAP)).otherwise(F.lit(WITHOUT_GAP))
    return scored.withColumns({"rank_range": spread, "observed_interpretation": label})


def opportunity_table(
    workspace: Workspace, segments: DataFrame, dimension: str, first_year: int, last_year: int,
    weights: ScoreWeights,
) -> DataFrame:
    """Scores of the segments present in the last year, every step above in turn."""
    current = write_segments(workspace, segments, dimension, first_year, last_year)
    return score(workspace, opportunity_components(workspace, current), weights)


def allow_listed(segments: DataFrame, dimension: str, allowed: list[str]) -> DataFrame:
    """Segments on a fixed list; the benchmark is then relative to that list."""
    return segments.filter(F.col(dimension).isin(list(allowed)))


def search_export(table: DataFrame, dimension: str, query: str, k: int) -> DataFrame:
    """The ranked-table export: segments whose name contains `query`, best first."""
    found = table.filter(F.contains(F.lower(dimension), F.lit(query.lower())))
    return (
        found.orderBy(F.col("score_primary").desc(), dimension).limit(k)
        .select(
            F.col("rank_primary").alias("rank"), dimension, F.col("score_primary").alias("score"),
            F.col("total_30day_fills").alias("fills"), F.col("fill_cagr").alias("cagr"),
            "selected_class_share", F.col("peer_gap_pp").alias("gap_pp"), "rank_range",
        )
    )
