"""Every registered query against the SQL that states its result."""

import os

import pytest

from workload.compare import compare, connect
from workload.queries import ORACLES, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# Every supplier of the smallest data set is registered, so nothing dangles there.
EMPTY = {"dangling_edges"} if FOLDER.endswith("sf0.001") else set()


@pytest.fixture(scope="module")
def database():
    return connect(FOLDER)


def test_each_query_states_its_result():
    assert set(QUERIES) - set(ORACLES) <= {"graph_json"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, database, name):
    found = compare(spark, database, name, FOLDER)
    assert found == ("no rows" if name in EMPTY else "")


# Plan nodes that would tie the work to one task or leave the JVM.
UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "EvalPython", "InPandas")


@pytest.mark.parametrize("name", ["cochange_pairs", "blame_by_commit", "ownership_edges", "dangling_edges", "index_edges",
                                  "all_neighbors", "blast_out", "primary_owner", "node_cochange_top6", "batch_requests"])
def test_plan_shape(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert [node for node in UNWANTED if node in plan] == []
    if name == "node_cochange_top6":
        assert "WindowGroupLimit" in plan


def test_scans_read_only_needed_columns(spark):
    plan = QUERIES["deps_downstream"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "p_retailprice" not in plan
