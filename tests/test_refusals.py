"""Inputs that would change a result without a word are refused, and no limit means all rows."""

from datetime import date

import pytest

from rankloom.operators.ranks import stage_ranks_pivot
from rankloom.operators.sampling import stable_sample
from rankloom.params import ExperimentParams, RequestFilters, TopQueryParams
from rankloom.plans import experiment_report
from rankloom.session import require_utc

FILTERS = RequestFilters("p", query_type=None, cache_bucket="live", organic_only=True)


def test_unknown_kind_of_repeats():
    with pytest.raises(ValueError):
        ExperimentParams(dates=(date(2024, 1, 5),), flag="f", placement="p", repeats="some")
    with pytest.raises(ValueError):
        stage_ranks_pivot(None, None, [], "p", repeats="some")
    with pytest.raises(ValueError):
        stage_ranks_pivot(None, None, [], "p", rank_scope="some")


def test_the_request_class_has_no_default():
    with pytest.raises(TypeError):
        RequestFilters("p")


def test_another_time_zone(spark):
    other = spark.newSession()
    other.conf.set("spark.sql.session.timeZone", "America/New_York")
    require_utc(spark)
    with pytest.raises(ValueError, match="UTC"):
        require_utc(other)


def test_unknown_rank_scope():
    with pytest.raises(ValueError):
        ExperimentParams(dates=(date(2024, 1, 5),), flag="f", placement="p", rank_scope="queries")
    with pytest.raises(ValueError):
        TopQueryParams(as_of=date(2024, 1, 5), filters=FILTERS, rank_scope="")


def test_report_refuses_ranks_within_a_query():
    params = ExperimentParams(dates=(date(2024, 1, 5),), flag="f", placement="p", rank_scope="query")
    with pytest.raises(ValueError):
        experiment_report(None, params)


def test_a_sample_without_limit_is_all_rows(spark):
    assert stable_sample(spark.range(50), None, "0", ["id"]).count() == 50
