"""Every catalog query against its SQL twin, and the shape of the plans."""

import re
import shutil
from pathlib import Path

import pytest
from compare import connect, differences

import __spark_entry__ as entry
from utilscope.operators import aggregates
from utilscope.plans import catalog, oracle
from utilscope.workspace import Workspace, shared_root

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not here")

QUERIES, TWINS = catalog.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, con, name):
    result = QUERIES[name](spark, SF_DIR)
    assert differences(result.toArrow(), con.sql(TWINS[name]).to_arrow_table()) == []


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(TWINS)


def test_every_line_and_every_year_is_read(spark):
    raw = QUERIES["csv_strict_scan"](spark, SF_DIR)
    lines = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()
    assert raw.selectExpr("sum(cast(Tot_Clms as bigint))").first()[0] == lines
    assert sorted(r.year for r in QUERIES["market_year"](spark, SF_DIR).collect()) == list(range(1995, 2002))


def test_entry(spark):
    assert entry.entry(spark).count() == 7


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def market(spark):
    return catalog.star_market(spark, SF_DIR)


def test_no_python_in_the_plans(market):
    for build in (catalog.parsed_extract, catalog.CATALOG["market_year"], catalog.CATALOG["provider_year"],
                  catalog.CATALOG["scope_audit"], catalog.CATALOG["concentration"]):
        assert not re.search(r"Python|Pandas|Arrow", plan_of(build(market)))


def test_no_cross_joins_and_no_whole_table_window(market):
    for name in ("provider_year", "provider_deciles", "percentile_rank_avg", "lorenz_curve", "cube_join_fanout"):
        plan = plan_of(catalog.CATALOG[name](market))
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
        assert "SinglePartition" not in plan, name


def test_yearly_filter_prunes_partitions_and_columns(market):
    plan = plan_of(market.fact.filter("year = 2000").groupBy("drug_class").agg({"total_claims": "sum"}))
    assert re.search(r"PartitionFilters: \[[^\]]*year", plan)
    assert "total_drug_cost" not in plan


def test_the_fact_is_collapsed_before_the_decile_join(market):
    plan = plan_of(aggregates.dashboard_cube(market.fact, market.provider_deciles()))
    join = plan.index("HashJoin") if "HashJoin" in plan else plan.index("SortMergeJoin")
    assert "HashAggregate" in plan[join:]


def test_changed_tables_are_noticed(spark, tmp_path):
    for name in catalog.SOURCE_TABLES:
        shutil.copy(f"{SF_DIR}/{name}.parquet", tmp_path)
    first = catalog.star_market(spark, str(tmp_path))
    assert catalog.star_market(spark, str(tmp_path)) is first
    half = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").limit(3000)
    half.coalesce(1).write.parquet(str(tmp_path / "half"))
    (tmp_path / "lineitem.parquet").chmod(0o644)
    shutil.copy(next((tmp_path / "half").glob("*.parquet")), tmp_path / "lineitem.parquet")
    assert catalog.star_market(spark, str(tmp_path)) is not first


def test_shared_folder_comes_from_the_session(spark):
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert not configured or shared_root(spark) == configured.rstrip("/")
    assert Workspace(spark).root != Workspace(spark).root


def test_headlines_read_stored_aggregates(spark):
    """No scan of the fact is left once the aggregates are stored."""
    market = catalog.star_market(spark, SF_DIR)
    market.headline_metrics().collect()
    plan = plan_of(market.headline_metrics())
    assert f"{market.workspace.path('fact')}" not in plan
