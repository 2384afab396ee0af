import re

import pytest

import __spark_entry__ as entry
from voxmill.plans import base
from voxmill.plans.registry import ORACLE, QUERIES

from .oracle import SF, connect, same


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    same(QUERIES[name](spark, SF), con, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_other_queries_give_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["cube8", "dilate"])
def test_voxels_are_dealt_over_tasks_that_grow_with_lineitem(spark, con, monkeypatch, name):
    """one shuffle, by sample, over a task for each ``TASK_ROWS`` rows; grouping, windows and distinct cells follow in the same tasks."""
    monkeypatch.setattr(base, "TASK_ROWS", 500)
    df = QUERIES[name](spark, SF)
    n = base.table(spark, SF, "lineitem").count() // 500 + 1
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert n > 4 and re.findall(r"hashpartitioning\((\w+)#\d+L?, (\d+)\)", plan) == [("sid", str(n))] and plan.count("Exchange") == 1
    same(df, con, ORACLE[name])
