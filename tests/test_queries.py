"""Every registered query against its SQL, on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry
from compare import compare, connect

SF = "/root/testdata/sf0.001"
OWN = sorted(entry.QUERIES)  # the document operators have tests of their own


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(OWN) == set(OWN) & set(entry.oracle_sql())
    assert entry.entry(spark).columns == ["site_id", "come", "go", "net"]


@pytest.mark.parametrize("name", OWN)
def test_query(spark, con, name):
    ok, note = compare(spark, con, name, SF)
    assert ok, note


@pytest.mark.parametrize("name", ["net_flow", "visit_classes", "visit_tracker_first", "gaussian_density", "term_counts"])
def test_plans_stay_in_the_jvm(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = entry.queries()["known_vendors"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(c_acctbal), GreaterThan(c_acctbal,3000.0)]" in plan
    assert "ReadSchema: struct<c_custkey:bigint,c_acctbal:double>" in plan
