"""Exact ranks over large tables, and top-k operators.

A window without a partition key (or with the year as its only key) would sort a whole
year in one task.  Ranks of values need no sort of the rows: `RankedValues` counts the rows
of each distinct value (combined on the map side), and sums the counts of the values before
it over range-partitioned slices of the distinct values.  Rows meet their value's bin by a join;
whatever is a function of values and counts (shares, Gini, quantiles) never meets the rows.

`GlobalOrder` numbers the rows themselves, where ties have to be told apart.  Spark range-partitions
and sorts the table once, numbers the rows of each sorted slice, and writes the result.  The
row number over the whole table is then the number inside the slice plus the size of the slices
before it; that second term is a table with one row per slice.  Rows that tie on the leading sort
column may span slices, because the sort key is made unique, so no value is too frequent.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utilscope.functions.numbers import ratio
from utilscope.operators.heavy import heavy_rows
from utilscope.workspace import Workspace

_POSITION_BITS = 33  # monotonically_increasing_id: slice number above, position below


class GlobalOrder:
    """A table in total order within each group (`by`), with exact row numbers.

    `value` is ranked descending with NULLs last; `tie_break` makes the order total, so
    (by, value, tie_break) must be unique.
    """

    def __init__(
        self, workspace: Workspace, name: str, df: DataFrame, by: list[str], value: str,
        tie_break: list[str],
    ):
        self.by, self.value = by, value
        # Grouping columns are compared with <=> further on, so NULL groups keep their rows.
        self._rows = workspace.table(f"{name}/rows", lambda: self._sorted(df, tie_break))
        self._slices = workspace.table(f"{name}/slices", self._slice_offsets)

    def _sorted(self, df: DataFrame, tie_break: list[str]) -> DataFrame:
        keys = [*map(F.col, self.by), F.col(self.value).desc_nulls_last(), *map(F.col, tie_break)]
        row_id = F.monotonically_increasing_id()
        return (
            df.repartitionByRange(*keys).sortWithinPartitions(*keys)
            .withColumn("_row_id", row_id)
            .withColumns({
                "_slice": F.shiftright("_row_id", _POSITION_BITS).cast("int"),
                "_position": F.col("_row_id").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)),
            })
            .drop("_row_id")
        )

    def _slice_offsets(self) -> DataFrame:
        """One row per group and slice: rows of the group before it, and in all."""
        group = Window.partitionBy(*self.by)
        before = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        return (
            self._rows.groupBy(*self.by, "_slice")
            .agg(
                F.min("_position").alias("_first"),
                F.count(F.lit(1)).alias("_rows"),
                F.count(self.value).alias("_values"),
            )
            .withColumns({
                "_before": F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first"),
                "group_rows": F.sum("_rows").over(group),
                "group_values": F.sum("_values").over(group),
            })
            .select(*self.by, "_slice", "_before", "group_rows", "group_values")
        )

    def groups(self) -> DataFrame:
        """Distinct groups, from the slice table."""
        return self._slices.select(*self.by).distinct()

    def numbered(self) -> DataFrame:
        """Rows with `row_number` (1 = highest value), `group_rows` and `group_values`.

        `group_values` counts the non-NULL values.
        """
        # One row per slice and group that it holds; Spark sees the size of the written table.
        rows, slices = self._rows.alias("r"), self._slices.alias("s")
        match = F.col("r._slice") == F.col("s._slice")
        for key in self.by:
            match = match & F.col(f"r.{key}").eqNullSafe(F.col(f"s.{key}"))
        number = F.col("r._position") + F.col("s._before") + 1
        return rows.join(slices, match).select(
            "r.*", number.alias("row_number"), "s.group_rows", "s.group_values"
        )

    def with_ties(self) -> DataFrame:
        """`numbered()` plus the first and last row number of each row's tie group.

        Ties are found per slice, then slices are merged, so even a value shared by most
        rows is grouped by one task per slice.
        """
        rows = self.numbered()
        tie = [*self.by, self.value]
        spans = rows.groupBy(*tie, "_slice").agg(
            F.min("row_number").alias("_low"), F.max("row_number").alias("_high")
        )
        whole = Window.partitionBy(*tie)
        spans = spans.withColumns({
            "tie_first": F.min("_low").over(whole), "tie_last": F.max("_high").over(whole),
        })
        match = F.col("r._slice") == F.col("t._slice")
        for key in tie:
            match = match & F.col(f"r.{key}").eqNullSafe(F.col(f"t.{key}"))
        return rows.alias("r").join(spans.alias("t"), match).select(
            "r.*", "t.tie_first", "t.tie_last"
        )

    def clean(self, df: DataFrame) -> DataFrame:
        """Without the helper columns of the order."""
        return df.drop(
            "_slice", "_position", "row_number", "group_rows", "group_values", "tie_first",
            "tie_last",
        )


class RankedValues:
    """A written table and, for each distinct value of a group (`by`), how many rows stand before it.

    Values are ranked descending with NULLs last. `bins` has a row for each group and distinct value:
    `rows` with it, rows `before` it, `group_rows` and `group_values` (not NULL) of the group. What is
    shuffled for the bins is their number, whatever the number of rows. A table that is read off a
    written one and ranked once (`once`) is not written again, nor are its bins.
    """

    def __init__(
        self, workspace: Workspace, name: str, df: DataFrame, by: list[str], value: str,
        tie_break: list[str] = (), once: bool = False,
    ):
        self.by, self.value = by, value
        self._workspace, self._name, self._tie_break = workspace, name, list(tie_break)
        self.rows = df if once else workspace.table(f"{name}/values", lambda: df)
        self._sorted = workspace.table(f"{name}/sorted", self._sorted_bins)
        self.bins = self._placed_bins() if once else workspace.table(f"{name}/bins", self._placed_bins)

    def _sorted_bins(self) -> DataFrame:
        counts = self.rows.groupBy(*self.by, self.value).agg(F.count(F.lit(1)).alias("rows"))
        keys = [*map(F.col, self.by), F.col(self.value).desc_nulls_last()]
        return counts.repartitionByRange(*keys).withColumn("_slice", F.spark_partition_id())

    def _placed_bins(self) -> DataFrame:
        """Rows before a bin: those of its slice and those of the group's slices before it."""
        group = Window.partitionBy(*self.by)
        earlier = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        known = F.when(F.col(self.value).isNotNull(), F.col("rows")).otherwise(F.lit(0))
        slices = self._sorted.groupBy(*self.by, "_slice").agg(
            F.sum("rows").alias("_rows"), F.sum(known).alias("_values")
        ).select(
            *[F.col(c).alias(f"_of_{c}") for c in self.by], F.col("_slice").alias("_of"),
            F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
            F.sum("_rows").over(group).alias("group_rows"), F.sum("_values").over(group).alias("group_values"),
        )
        inside = Window.partitionBy(*self.by, "_slice").orderBy(F.col(self.value).desc_nulls_last())
        so_far = F.sum("rows").over(inside.rowsBetween(Window.unboundedPreceding, -1))
        same = [F.col("_slice") == F.col("_of"), *[F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in self.by]]
        return self._sorted.withColumn("_so_far", F.coalesce(so_far, F.lit(0))).join(slices, same).select(
            *self.by, self.value, "rows", (F.col("_before") + F.col("_so_far")).alias("before"),
            "group_rows", "group_values",
        )

    def placed(self) -> DataFrame:
        """Rows with the first and last row number of their tie group, `group_rows` and `group_values`."""
        keys = [*self.by, self.value]
        same = [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys]
        return self.rows.alias("r").join(self.bins.alias("b"), same).select(
            "r.*", (F.col("b.before") + 1).alias("tie_first"), (F.col("b.before") + F.col("b.rows")).alias("tie_last"),
            "b.group_rows", "b.group_values",
        )

    def bucketed(self, name: str, buckets: int) -> DataFrame:
        """`placed()` with NTILE over the total order of values and `tie_break`.

        Only a tie group that spans several buckets has to be put in order, at most `buckets` - 1 of
        them in a group.
        """
        whole = lambda place: ntile(F.col(place), F.col("group_rows"), buckets)
        rows = self.placed().withColumns({name: whole("tie_first"), "_last": whole("tie_last")})
        settled = rows.filter(F.col(name) == F.col("_last")).drop("_last")
        split = GlobalOrder(
            self._workspace, f"{self._name}/split-{buckets}", rows.filter(F.col(name) != F.col("_last"))
            .withColumnsRenamed({c: f"_{c}" for c in ("tie_first", "tie_last", "group_rows", "group_values")}),
            self.by, self.value, self._tie_break,
        )
        # Numbered among the split groups alone: the place inside the own one is what counts.
        number = F.col("_tie_first") + F.col("row_number") - F.col("tie_first")
        found = split.with_ties().withColumn(name, ntile(number, F.col("_group_rows"), buckets))
        return settled.unionByName(found.select(*[
            F.col(f"_{c}").alias(c) if c in ("tie_first", "tie_last", "group_rows", "group_values") else F.col(c)
            for c in settled.columns
        ]))

    def clean(self, df: DataFrame) -> DataFrame:
        """Without the helper columns of the ranks."""
        return df.drop("group_rows", "group_values", "tie_first", "tie_last")


def ntile(row_number: Column, rows: Column, buckets: int) -> Column:
    """NTILE from a row number: the first `rows % buckets` buckets hold one row more."""
    size = F.floor(rows / buckets)
    larger = rows % buckets
    in_larger = larger * (size + 1)
    n = row_number - 1
    return (
        F.when(n < in_larger, F.floor(n / (size + 1)))
        .otherwise(larger + F.floor((n - in_larger) / F.greatest(size, F.lit(1))))
        .cast("int") + 1
    )


def _share_no_larger() -> Column:
    """Ascending CUME_DIST: in descending order, what starts at the tie group's first row."""
    return ratio(F.col("group_rows") - F.col("tie_first") + 1, F.col("group_rows"))


def volume_deciles(order: RankedValues) -> DataFrame:
    """`volume_decile` 1 (highest) to 10 for every row."""
    return order.clean(order.bucketed("volume_decile", 10))


def volume_percentile(order: RankedValues) -> DataFrame:
    """`volume_percentile`: the share of rows whose value is no larger."""
    return order.clean(order.placed().withColumn("volume_percentile", _share_no_larger()))


def volume_ranks(order: RankedValues) -> DataFrame:
    """Decile and percentile together."""
    return order.clean(order.bucketed("volume_decile", 10).withColumn("volume_percentile", _share_no_larger()))


def average_percentile(order: RankedValues, name: str) -> DataFrame:
    """Ascending percentile rank, ties averaged; a missing value gets 0.5 and is not counted."""
    # Descending position p among v values is ascending rank v + 1 - p.
    mean = F.col("group_values") + 1 - (F.col("tie_first") + F.col("tie_last")) / 2.0
    score = F.when(F.col(order.value).isNull(), F.lit(0.5)).otherwise(
        ratio(mean, F.col("group_values"))
    )
    return order.clean(order.placed().withColumn(name, score))


def add_average_percentiles(workspace: Workspace, df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Ascending average-tie percentile of each column in `names`, as its mapped name."""
    return _with_ranks(workspace, df, names, average_percentile)


def add_ranks(workspace: Workspace, df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Descending rank (ties share the best, NULL last) of each column in `names`, as its mapped name."""
    ranked = _with_ranks(workspace, df, names, _best_rank)
    return ranked.withColumns({out: F.col(out).cast("int") for out in names.values()})


def _with_ranks(workspace, df, names, rank_of) -> DataFrame:
    """Every row with the ranks of its columns: all columns are ranked together, by column.

    Rows are told apart by their place in the written table, so repeated and NULL keys keep theirs.
    """
    rows = workspace.write(
        workspace.fresh_path("ranked"), df.withColumn("_row", F.monotonically_increasing_id())
    )
    values = [F.struct(F.lit(out).alias("_rank"), F.col(c).cast("double").alias("_value")) for c, out in names.items()]
    order = RankedValues(
        workspace, f"order-{uuid4().hex}", rows.select("_row", F.inline(F.array(*values))), ["_rank"], "_value", once=True
    )
    ranked = rank_of(order, "_place").groupBy("_row").agg(*[
        F.max(F.when(F.col("_rank") == out, F.col("_place"))).alias(out) for out in names.values()
    ])
    return rows.join(ranked, "_row").drop("_row")


def _best_rank(order: RankedValues, name: str) -> DataFrame:
    return order.placed().withColumn(name, F.col("tie_first"))


def quantiles(workspace: Workspace, df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """One row: `known` (non-NULL values) and `q`, their interpolated quantiles (NULL without a value).

    The values next to each quantile are found by the counts of the distinct values.
    """
    order = RankedValues(
        workspace, f"order-{uuid4().hex}", df.select(F.col(value).cast("double").alias("_value")), [], "_value", once=True
    )
    known = order.bins.where(F.col("_value").isNotNull())
    # Descending row numbers before + 1 .. before + rows of v values are ascending places from here on.
    first_place = F.col("group_values") - F.col("before") - F.col("rows")

    def at(place: Column) -> Column:
        inside = (first_place <= place) & (place < first_place + F.col("rows"))
        return F.max(F.when(inside, F.col("_value")))

    def near(share: float) -> Column:
        exact = (F.col("group_values") - 1) * F.lit(share)
        first, second = at(F.floor(exact)), at(F.ceil(exact))
        return first + (second - first) * F.max(exact - F.floor(exact))

    found = known.agg(F.sum("rows").alias("known"), F.array(*[near(s) for s in shares]).alias("q"))
    return found.select(F.coalesce("known", F.lit(0)).alias("known"), "q")


def leaders(df: DataFrame, measure: str, labels: list[str], k: int) -> DataFrame:
    """Top `k` rows by a measure; the labels break ties."""
    return df.orderBy(F.col(measure).desc(), *labels).limit(k)


def leaders_per_group(
    df: DataFrame, group: list[str], measure: str, labels: list[str], k: int
) -> DataFrame:
    """Top `k` rows of each group by a measure; the labels break ties.

    Spark cuts each map partition to `k` rows per group before the shuffle.
    """
    order = Window.partitionBy(*group).orderBy(F.col(measure).desc(), *labels)
    return df.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).drop("_n")


def top_percentile(
    df: DataFrame, value: str, labels: list[str], threshold: float, k: int
) -> DataFrame:
    """The `k` highest rows whose PERCENT_RANK (ascending, over all rows) reaches a threshold.

    Rows above the k-th are all among the top k, so their ranks follow from the top k alone;
    only the ties of the k-th value are counted over the table.  NULL values must be removed
    first.
    """
    top = leaders(df, value, labels, k).agg(
        F.collect_list(F.struct("*")).alias("rows"), F.min(value).alias("lowest")
    )
    top = top.select(F.struct("rows", "lowest")).scalar()
    counted = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_if(F.col(value) >= top.getField("lowest")).alias("_at_or_above_lowest"),
    ).select("*", F.explode(top.getField("rows")).alias("row"))
    # From here on at most k rows.
    highest_first = Window.partitionBy().orderBy(F.col(f"row.{value}").desc())
    in_top = F.count(F.lit(1)).over(highest_first)
    is_lowest = F.col(f"row.{value}") == F.min(f"row.{value}").over(Window.partitionBy())
    below = F.col("_rows") - F.when(is_lowest, F.col("_at_or_above_lowest")).otherwise(in_top)
    rank = F.coalesce(ratio(below, F.col("_rows") - 1), F.lit(0.0))
    return (
        counted.withColumn("cost_percentile", rank)
        .filter(F.col("cost_percentile") >= threshold)
        .select("row.*", "cost_percentile")
    )


def collapse_rare(
    df: DataFrame, totals: DataFrame, label: str, measure: str, k: int, other: str
) -> DataFrame:
    """Labels outside the `k` largest (by `totals`) become `other`.

    Only labels that a sketch of fixed size leaves in the running are grouped.
    """
    running = heavy_rows(totals.select(label, measure), label, measure, k)
    kept = leaders(
        running.groupBy(label).agg(F.sum(measure).alias("_total")), "_total", [label], k
    ).select(F.col(label).alias("_kept"))
    joined = df.join(F.broadcast(kept), F.col(label) == F.col("_kept"), "left")  # at most k rows
    return joined.withColumn(label, F.coalesce("_kept", F.lit(other))).drop("_kept")
