"""Physical plans as they are when nothing is small enough to broadcast."""

import os
import re

import pytest

from carbonsplit.plans import catalog
from carbonsplit.plans.bindings import Star

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def star(spark):
    star = Star(spark, FOLDER)
    for name in catalog.STORED:
        star.stored(name)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield star
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def physical(df):
    return df._jdf.queryExecution().sparkPlan().toString()


# A single task only ever sees the partial sums of a one-row total.
# (d15 and d16 list the few warming levels of a table that way.)
ONE_ROW_TOTALS = {"d05", "d10", "d15", "d16", "d20", "d21", "d22", "d29", "d43", "d49", "d51"}


@pytest.mark.parametrize("name", catalog._REGISTRY)
def test_no_cartesian_and_no_row_by_row_python(star, name):
    df = catalog._REGISTRY[name](star)
    plan = physical(df)
    assert not re.search(r"Cartesian|NestedLoop|PythonUDF|Pandas|ArrowEval", plan)
    full = df._jdf.queryExecution().executedPlan().toString()
    if name[:3] not in ONE_ROW_TOTALS:
        assert "SinglePartition" not in full


def test_windows_are_always_partitioned(star):
    for name, fn in catalog._REGISTRY.items():
        for spec in re.findall(r"Window \[.*?\], \[(.*?)\]", physical(fn(star))):
            assert spec, name


def test_base_table_reads_only_needed_columns(star):
    plan = star.city_year._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "l_tax" not in plan and "o_orderpriority" not in plan
    # lines are shuffled once (partially summed) and joined without another shuffle
    assert len(re.findall(r"Exchange hashpartitioning\(l_orderkey", plan)) == 1


@pytest.mark.parametrize("name", ["d18_world_history_city", "d29_responsibility_subset", "d30_city_population_ratios", "d30_city_capacity_total", "d37_index_city"])
def test_city_tables_are_not_exchanged(spark, star, name):
    """City tables lie in buckets of the city; what joins them is compact and broadcast."""
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # lets a join on city and year keep rows that lie by city alone
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    try:
        plan = catalog._REGISTRY[name](star)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
    assert "city" in plan
    assert not re.findall(r"Exchange hashpartitioning\([^)]*city[^)]*", plan)


def test_history_is_stored_once(star):
    plan = catalog.d29_responsibility_subset(star)._jdf.queryExecution().executedPlan().toString()
    # gas columns become rows when the history is written, not again by its readers
    assert "Expand" not in plan


def test_closed_tables_leave_no_folder(spark):
    star = Star(spark, FOLDER)
    star.stored("city_history_table")
    folders = [f.removeprefix("file:") for f in star._folders]
    assert len(folders) >= 2 and all(os.path.isdir(f) for f in folders)
    star.close()
    assert not any(os.path.exists(f) for f in folders)


def test_year_filter_reaches_the_scan(star):
    plan = catalog.d31_year_gap_responsibility(star)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[.*In\(year, \[1998,1999\]\)", plan)
