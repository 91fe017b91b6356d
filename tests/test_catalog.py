"""Every catalogue query on the smallest tables, beside its SQL counterpart."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    fn, sql = entry.queries()[name], entry.oracle_sql().get(name)
    if sql is None:
        assert len(fn(spark, SF).collect()) > 0
    else:
        assert compare(spark, con, SF, name, fn, sql) == ""


def test_entry(spark):
    assert entry.entry(spark).columns == ["des_id", "par_id", "Description"]


@pytest.mark.parametrize("name", ["clean_corpus", "merge_by_link", "topic_info", "document_info", "evaluate_classifier", "stratified_split"])
def test_no_cross_join(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
