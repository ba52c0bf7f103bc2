"""How often and how the star tables and the cube's cells are shuffled, and what comes of keys that repeat or are NULL."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from utilscope.operators import aggregates, prescribers
from utilscope.plans import star

SETTINGS = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.fixture
def no_broadcast(spark):
    before = {key: spark.conf.get(key, None) for key in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


PARTS = [(i, f"{'hot' if i % 2 else 'cold'} gear {i % 9}", f"Brand#{20 + i % 2}", 20) for i in range(30)] + [(3, "hot rod", "Brand#21", 20)]
CUSTOMERS = [(i, i % 3, "MACHINERY" if i % 2 else None) for i in range(12)] + [(5, 2, "MACHINERY"), (6, None, "BUILDING")]
ORDERS = [(i, i % 12, 1995 + i % 2) for i in range(60)] + [(7, 7, 1996), (7, 8, 1996), (8, 8, 1995), (None, 1, 1995), (61, None, 1996)]
LINES = [(i % 60, i % 30, float(i % 5 + 1), float(i), "F" if i % 3 else "O") for i in range(400)] + [
    (7, 2, 1.0, 9.0, "F")] * 3 + [(None, 2, 1.0, 1.0, "F"), (9, None, 1.0, 1.0, "O"), (99, 1, 1.0, 1.0, "O"), (61, 1, 1.0, 1.0, "O")]


@pytest.fixture
def tables(spark, tmp_path):
    made = {
        "part": (PARTS, "p_partkey long, p_name string, p_brand string, p_size int"),
        "customer": (CUSTOMERS, "c_custkey long, c_nationkey int, c_mktsegment string"),
        "lineitem": (LINES, "l_orderkey long, l_partkey long, l_quantity double, l_extendedprice double, l_linestatus string"),
        "nation": ([(i, f"NATION_{i}") for i in range(3)], "n_nationkey int, n_name string"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame(ORDERS, "o_orderkey long, o_custkey long, y int").select(
        "o_orderkey", "o_custkey", F.make_date("y", F.lit(6), F.lit(1)).alias("o_orderdate")
    ).write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def expected_cells():
    """year, provider, segment, brand and label: lines, units, cents and orders, by plain loops."""
    per_order = defaultdict(lambda: [0, 0, 0])
    for order, part, units, cost, _ in LINES:
        for key, name, brand, _ in PARTS:
            if part is not None and key == part and order is not None:
                found = per_order[order, brand, name]
                found[0], found[1], found[2] = found[0] + 1, found[1] + units, found[2] + cost
    cells = defaultdict(lambda: [0, 0, 0, 0])
    for (order, brand, name), sums in per_order.items():
        for key, customer, year in ORDERS:
            for c, nation, segment in CUSTOMERS:
                if key == order and customer == c and nation is not None:
                    cell = cells[year, c, nation, segment, brand, name]
                    cells[year, c, nation, segment, brand, name] = [a + b for a, b in zip(cell, [*sums, 1])]
    return {key: tuple(v) for key, v in cells.items()}


def test_cells_of_repeated_and_missing_keys(spark, tables, no_broadcast):
    found = star.cells(spark, tables, star.product_labels(spark, tables)).collect()
    rows = {}
    for r in found:
        key = (r.year, int(r.provider_npi), int(r.provider_state_fips), r.provider_specialty, r.brand_name, r.generic_name)
        assert key not in rows
        rows[key] = (r.total_claims, r.total_30day_fills, r.total_drug_cost, r.total_beneficiaries)
    published = lambda v: (*v[:3], v[3] if v[1] * 10 >= 110 else None)
    wanted = {(*k[:3], "" if k[1] % 97 == 0 else k[3], *k[4:]): published(v) for k, v in expected_cells().items()}
    assert rows == wanted and len(rows) > 40


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_shuffled_once_by_order(spark, tables, no_broadcast):
    """One shuffle of the lines serves their grouping and the join with the orders."""
    plan = plan_of(star.cells(spark, tables, star.product_labels(spark, tables)))
    by_order = re.findall(r"Exchange hashpartitioning\(l_orderkey#\d+L?(, brand_name)?", plan)
    assert len(by_order) == 2 and not any(by_order)  # lines and orders
    assert "isnotnull(l_orderkey" in plan


def test_a_providers_year_is_written_by_one_task(spark, tables, no_broadcast):
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")  # nations and decisions on labels are small
    raw = star.raw_rows(spark, tables).select("year", F.regexp_replace("Prscrbr_NPI", r"\.0$", "").alias("npi"), F.spark_partition_id().alias("task"))
    fact = star.star_fact(spark, tables).select("year", F.col("provider_npi").alias("npi"), F.spark_partition_id().alias("task"))
    for rows in (raw, fact):
        tasks = defaultdict(list)
        for r in rows.collect():
            tasks[r.year, r.npi].append(r.task)
        assert max(map(len, tasks.values())) > 3 and all(len(set(t)) == 1 for t in tasks.values())


def test_provider_cells_meet_the_deciles_without_a_second_shuffle(spark, tables, no_broadcast):
    fact = star.star_fact(spark, tables).localCheckpoint()
    deciles = fact.select("year", "provider_npi").distinct().withColumn("volume_decile", F.lit(1)).localCheckpoint()
    cube = aggregates.dashboard_cube(fact, deciles)
    keys = re.findall(r"Exchange hashpartitioning\(year#\d+, provider_npi#\d+, (\w+)", plan_of(cube))
    assert [k for k in keys if not k.isdigit()] == [] and len(keys) == 2  # the fact and the deciles
    assert cube.agg(F.sum("total_claims")).first()[0] == fact.agg(F.sum("total_claims")).first()[0]


def test_numbers_are_shuffled_not_partial_bitmaps(spark, tables, no_broadcast):
    fact = star.star_fact(spark, tables).localCheckpoint()
    deciles = fact.select("year", "provider_npi").distinct().withColumn("volume_decile", F.lit(1)).localCheckpoint()
    numbers = deciles.select("provider_npi", F.col("provider_npi").cast("long").alias("provider_number")).distinct()
    cube = prescribers.prescriber_cube(fact, deciles, numbers)
    plan = plan_of(cube)
    assert 0 < plan.rindex("partial_bitmap_construct_agg") < plan.index("Exchange")
    found = prescribers.distinct_prescribers(cube, ["year"]).collect()
    assert {r.year: r.prescribers for r in found} == {r.year: r["count"] for r in deciles.groupBy("year").count().collect()}
