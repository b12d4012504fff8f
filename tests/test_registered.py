"""Every registered query beside its DuckDB answer, and the shape of the plans."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from vigil.plans.catalog import QUERIES
from check_oracles import compare, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")
ANSWERS = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, note = compare(spark, con, name, entry.queries()[name], ANSWERS.get(name), SF)
    assert ok, note


def test_every_answer_has_a_query():
    assert set(ANSWERS) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["threat_filter", "indicator_lookup", "co_mention", "evidence_csv", "environment_threats", "impact_tags", "dictionary_hits"])
def test_plan_has_no_pairs_and_no_python(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert banned not in plan, banned
