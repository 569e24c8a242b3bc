"""Every registered query against its SQL on the small tables."""

import re
from pathlib import Path

import pytest

import __spark_entry__ as entry
from checks.compare import connect, difference
from checks.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    return connect(FOLDER)


def test_every_query_has_its_sql():
    assert QUERIES.keys() == ORACLES.keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", QUERIES)
def test_same_rows(spark, tables, name):
    query, text = entry.queries()[name], entry.oracle_sql()[name]
    assert difference(spark, tables, query, text, FOLDER) is None


def test_known_figures(spark):
    """All candidates of all log rows at the next scale."""
    folder = "/root/testdata/sf0.01"
    assert entry.queries()["rank_in_request"](spark, folder).count() == 101_480


def test_no_query_multiplies_tables_freely(spark):
    for name in ("stage_ranks_pivot", "retrieval_report", "top_queries", "experiment_sample"):
        frame = entry.queries()[name](spark, FOLDER)
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan), name
