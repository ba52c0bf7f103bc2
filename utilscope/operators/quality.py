"""Checks that return rows, and reconciliation of independently computed layers.

A check is a DataFrame with a BOOLEAN `passed`; `require` turns it into an error for jobs
that must stop.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from utilscope.functions.numbers import sum_of
from utilscope.functions.text import contains_any, normalize_text
from utilscope.operators.aggregates import MEASURES, class_year, duplicate_grain
from utilscope.operators.classify import INCLUDED
from utilscope.rules import ScopeRules
from utilscope.schema import GRAIN
from utilscope.workspace import literal_rows

EXPECTED_YEAR = T.StructType([
    T.StructField("year", T.IntegerType()), T.StructField("expected", T.BooleanType())
])
REQUIRED = ["brand_name", "generic_name", "drug_class", *MEASURES]


class CheckFailed(AssertionError):
    """Raised by `require` with the failing rows of a check."""


def require(check: DataFrame) -> None:
    """Raise if any row of a check did not pass."""
    failing = check.filter(~F.col("passed")).limit(20).collect()
    if failing:
        raise CheckFailed("\n".join(str(row.asDict()) for row in failing))


def close_enough(left: Column, right: Column, tolerance: float) -> Column:
    size = F.greatest(F.abs(left), F.abs(right), F.lit(1.0))
    return F.abs(left - right) <= F.lit(tolerance) * size


def _violations(fact: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break each rule, counted in one pass: (check_name, violations, passed)."""
    counts = fact.agg(*[
        F.count_if(F.coalesce(broken, F.lit(False))).alias(name) for name, broken in rules.items()
    ])
    return counts.unpivot([], list(rules), "check_name", "violations").withColumn(
        "passed", F.col("violations") == 0
    )


def check_years(fact: DataFrame, expected: list[int], min_columns: int = 30) -> DataFrame:
    """Each year seen or expected, and whether it is both; the column count is checked too."""
    wanted = literal_rows(fact.sparkSession, [(y, True) for y in expected], EXPECTED_YEAR)
    seen = fact.select("year").distinct().withColumn("observed", F.lit(True))
    both = wanted.join(seen, "year", "full")
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("expected", "observed")}
    width = len(fact.columns)
    return both.withColumns(flags).select(
        "year", "expected", "observed", F.lit(width).alias("column_count"),
        (F.col("expected") & F.col("observed") & F.lit(width >= min_columns)).alias("passed"),
    )


def check_grain(fact: DataFrame, keys: list[str] = GRAIN) -> DataFrame:
    """Number of keys that repeat."""
    return duplicate_grain(fact, keys).agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit("grain_unique").alias("check_name"), "violations",
        (F.col("violations") == 0).alias("passed"),
    )


def check_required(fact: DataFrame) -> DataFrame:
    """Required fields are set and identifiers have ten characters."""
    npi = F.col("provider_npi")
    return _violations(fact, {
        "provider_npi_length": npi.isNull() | (F.length(npi) != 10),
        **{f"{c}_missing": F.col(c).isNull() for c in REQUIRED},
    })


def check_domains(fact: DataFrame, min_claims: int = 11, min_beneficiaries: int = 11) -> DataFrame:
    """Counts respect the publication thresholds, measures are not negative."""
    return _violations(fact, {
        "total_claims_below_minimum": F.col("total_claims") < min_claims,
        "total_30day_fills_negative": F.col("total_30day_fills") < 0,
        "total_day_supply_negative": F.col("total_day_supply") < 0,
        "total_drug_cost_negative": F.col("total_drug_cost") < 0,
        "beneficiaries_below_minimum": F.col("total_beneficiaries") < min_beneficiaries,
    })


def check_scope(fact: DataFrame, rules: ScopeRules) -> DataFrame:
    """Every row is mapped and in scope; no excluded pattern or brand slipped through."""
    generic = normalize_text(F.col("generic_name"))
    brand = normalize_text(F.col("brand_name"))
    return _violations(fact, {
        "unmapped_class": F.col("drug_class") == rules.unmapped_class,
        "not_included": F.col("scope_status") != INCLUDED,
        "excluded_pattern": contains_any(generic, list(rules.excluded_patterns)),
        "excluded_brand": brand.isin(list(rules.excluded_brands)),
    })


def check_suppression(fact: DataFrame) -> DataFrame:
    """The suppression flag marks exactly the missing beneficiary counts, and there are some."""
    flagged, missing = F.col("suppressed_rows"), F.col("missing_rows")
    return fact.agg(
        F.count_if("beneficiary_count_suppressed").alias("suppressed_rows"),
        F.count_if(F.col("total_beneficiaries").isNull()).alias("missing_rows"),
    ).withColumn("passed", (flagged == missing) & (flagged > 0))


def check_score_bounds(table: DataFrame, scenarios: list[str]) -> DataFrame:
    """Scores outside 0 to 100, by scenario."""
    return _violations(table, {
        f"score_{s}": ~F.col(f"score_{s}").between(0, 100) | F.col(f"score_{s}").isNull()
        for s in scenarios
    })


def check_latest_row(table: DataFrame, source: DataFrame, year: int, tolerance: float = 1e-6) -> DataFrame:
    """A published yearly row against the aggregate it came from."""
    keep = F.col("year") == year
    return compare_layers(table.filter(keep), source.filter(keep), MEASURES, tolerance)


def layer_totals(fact: DataFrame) -> DataFrame:
    """Rows and core sums by year, from a pruned scan."""
    return fact.groupBy("year").agg(F.count(F.lit(1)).alias("rows"), *map(sum_of, MEASURES))


def compare_layers(
    left: DataFrame, right: DataFrame, metrics: list[str], tolerance: float = 1e-9,
    exact: tuple[str, ...] = ("rows", "total_claims"),
) -> DataFrame:
    """Two yearly aggregates side by side: (year, check_name, left, right, passed).

    A year that only one layer has fails.  Metrics in `exact` must be equal.
    """
    values = [
        F.struct(
            F.lit(m).alias("check_name"),
            F.col(f"l.{m}").cast("double").alias("left_value"),
            F.col(f"r.{m}").cast("double").alias("right_value"),
            F.lit(m in exact).alias("exact"),
        )
        for m in metrics
    ]
    both = left.alias("l").join(right.alias("r"), F.col("l.year") == F.col("r.year"), "full")
    rows = both.select(
        F.coalesce("l.year", "r.year").alias("year"), F.explode(F.array(*values)).alias("c")
    ).select("year", "c.*")
    lv, rv = F.col("left_value"), F.col("right_value")
    same = F.when(F.col("exact"), lv == rv).otherwise(close_enough(lv, rv, tolerance))
    return rows.withColumn("passed", F.coalesce(same, F.lit(False))).drop("exact")


def reconcile_counts(counts: DataFrame, candidates: DataFrame, fact: DataFrame) -> DataFrame:
    """Candidates kept by the scan = rows that the transform read = rows in the fact + documented
    exclusions, by year.

    `counts` comes from `extract_counts`; a year missing on any side fails.
    """
    read = candidates.groupBy("year").agg(F.count(F.lit(1)).alias("input_rows"))
    processed = fact.groupBy("year").agg(F.count(F.lit(1)).alias("processed_rows"))
    both = counts.drop("fingerprint").join(read, "year", "full").join(processed, "year", "full")
    balanced = (F.col("candidate_rows") == F.col("input_rows")) & (
        F.col("input_rows") == F.col("processed_rows") + F.col("excluded_rows")
    )
    return both.withColumn("passed", F.coalesce(balanced, F.lit(False)))


def reconcile_class_rollup(fact: DataFrame) -> DataFrame:
    """Class aggregates summed over classes against the fact, by year."""
    rollup = class_year(fact).groupBy("year").agg(*map(sum_of, MEASURES))
    return compare_layers(rollup, layer_totals(fact), MEASURES, 1e-10, exact=("total_claims",))


def cube_join_fanout(cube: DataFrame, fact: DataFrame) -> DataFrame:
    """Cube totals against fact totals: the provider join must not multiply rows."""
    rollup = cube.groupBy("year").agg(*map(sum_of, MEASURES))
    return compare_layers(rollup, layer_totals(fact), MEASURES, 1e-10, exact=("total_claims",))


def all_checks(checks: dict[str, DataFrame]) -> DataFrame:
    """Verdict of each named check: (check_name, failing_rows, passed)."""
    verdicts = [
        check.agg(F.count_if(~F.col("passed")).alias("failing_rows")).select(
            F.lit(name).alias("check_name"), "failing_rows",
            (F.col("failing_rows") == 0).alias("passed"),
        )
        for name, check in checks.items()
    ]
    return reduce(DataFrame.unionByName, verdicts)


#: Buckets that keys are dealt over before two layers are compared.
KEY_BUCKETS = 4096


def _digests(layer: DataFrame, by: list[Column], columns: list[str]) -> DataFrame:
    """Rows and an order-free digest of the rows of each group."""
    row_hash = F.xxhash64(*columns).cast("decimal(38,0)")
    return layer.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.sum(row_hash).alias("digest"))


def reconcile_rows(left: DataFrame, right: DataFrame, keys: list[str], buckets: int = KEY_BUCKETS) -> DataFrame:
    """The keys whose rows differ between two layers: `keys`, `left_rows`, `right_rows`, `difference`.

    Keys are dealt over buckets, and each layer is folded to a count and an order-free digest of every
    bucket. Only rows of buckets that differ are then grouped by key, so what is shuffled follows the
    differences. `difference` is 'missing' (not in `right`), 'extra' (not in `left`) or 'changed' (another
    number of rows, or other values). Columns that only one layer has are not compared; NULL keys are keys.
    """
    columns = sorted(set(left.columns) & set(right.columns))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("_bucket")
    sides = [layer.select(*columns, bucket) for layer in (left, right)]

    def differing(by: list[str], pair: list[DataFrame]) -> DataFrame:
        a, b = (_digests(layer, [F.col(c) for c in by], columns).alias(name) for layer, name in zip(pair, "ab"))
        same = reduce(and_, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by])
        alike = F.col("a.rows").eqNullSafe(F.col("b.rows")) & F.col("a.digest").eqNullSafe(F.col("b.digest"))
        known = F.col("a.rows").isNotNull()
        return a.join(b, same, "full").filter(~alike).select(
            *[F.when(known, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in by],
            F.coalesce("a.rows", F.lit(0)).alias("left_rows"), F.coalesce("b.rows", F.lit(0)).alias("right_rows"),
        )

    # One row a bucket at most, whatever the layers hold.
    suspects = F.broadcast(differing(["_bucket"], sides).select("_bucket"))
    found = differing(keys, [layer.join(suspects, "_bucket", "left_semi") for layer in sides])
    difference = F.when(F.col("right_rows") == 0, "missing").when(F.col("left_rows") == 0, "extra").otherwise("changed")
    return found.withColumn("difference", difference)
