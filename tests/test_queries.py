"""Every registered query: agreement with its SQL, and the shape of its plan."""

import os

import pytest

from censemble.operators import votes as vot
from censemble.plans import fixtures as fx
from censemble.plans.catalog import QUERIES
from checks.compare import compare, connect
from checks.oracle_sql import ORACLE

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
BAD_NODES = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")
# Their few rows of a fixed kind (seeds and groups, states) meet every row by design.
SMALL_SIDES = {"run_grid", "empty_scopes"}
# Few partitions and many must give the same rows.
ANY_PARTITIONS = ["yes_share", "opinion_change", "segment_breakdown", "budget_cap", "recent_context", "bootstrap_ci", "personas", "multigroup"]


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_agrees_with_sql(spark, duck, name):
    """Also: no cross join and no Python in the plan."""
    result = QUERIES[name](spark, SF_DIR)
    if name not in SMALL_SIDES:
        plan = result._jdf.queryExecution().executedPlan().toString()
        assert not [bad for bad in BAD_NODES if bad in plan]
    assert compare(result, duck, ORACLE[name]) == "ok"


@pytest.mark.parametrize("name", ANY_PARTITIONS)
@pytest.mark.parametrize("partitions", ["1", "23"])
def test_partitions_do_not_change_results(spark, duck, name, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert compare(QUERIES[name](spark, SF_DIR), duck, ORACLE[name]) == "ok"


@pytest.mark.parametrize("name", ["yes_share", "opinion_change", "bootstrap_ci", "multigroup"])
def test_large_votes_are_not_shuffled_to_meet_the_measures(spark, name):
    """At a size where Spark would take the results by event type for large; there are five."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = plan.split("\n")
    # What stands right above the votes is the join that tells their phase.
    above = [lines[i - 1] for i, line in enumerate(lines) if "Project" in line and "AS round#" in line]
    assert above and all("BroadcastHashJoin" in line for line in above)


def test_opinion_change_scans_a_stored_table_three_times(spark, tmp_path):
    """For the post votes, the pre votes, and the counts by persona, which need fewer columns."""
    fx.votes(spark, SF_DIR).write.parquet(str(tmp_path / "votes"))
    votes = vot.with_phase(spark.read.parquet(str(tmp_path / "votes")), fx.truth(spark, SF_DIR))
    result = vot.opinion_change(votes, ["measure_id"])
    result.collect()
    final = result._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # By its columns: the folder's name is cut short in a plan.
    assert 1 <= sum("FileScan" in x and "persona_id#" in x for x in final.split("\n")) <= 3
