from dataclasses import replace
from datetime import date
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from rankloom.operators.metrics import page_flags, retrieval_report
from rankloom.operators.popular import most_used, rank_by_count, top_queries
from rankloom.operators.searches import request_to_visit
from rankloom.params import ExperimentParams, RequestFilters, TopQueryParams
from rankloom.plans import (
    Sources,
    experiment_quicklook,
    experiment_report,
    popular_rank_table,
    rank_table,
    top_query_report,
)
from rankloom.sources import TableStore
from tests.fixtures import (
    AB_TEST,
    BEACON,
    FLAG,
    LOG,
    MONDAY,
    TUESDAY,
    VISIT,
    VISIT_BEACON,
    as_list,
    as_set,
    beacon,
    entry,
    log,
    visit_beacon,
)

PARAMS = ExperimentParams(
    dates=(MONDAY, TUESDAY), flag=FLAG, placement="web", repeats="first"
)


@pytest.fixture(scope="module")
def sources(spark):
    beacons = [beacon("a", ["on"]), beacon("b", ["off"]), beacon("c", ["ineligible"])]
    seen = [
        visit_beacon("v1", "a", "ring"),
        visit_beacon("v2", "a", "ring", day=TUESDAY),
        visit_beacon("v3", "b", "mug"),
        visit_beacon("v4", "c", "mug"),
    ]
    logs = [
        log("a", [entry("solr", [1]), entry("nir", [1, 2]), entry("mo_last", [1, 2, 3])]),
        log("a", [entry("mo_last", [5])], minute=8),
        log("b", [entry("xml", [2]), entry("borda", [2, 1]), entry("mo_last", [1, 2])]),
        log("c", [entry("mo_last", [1])]),
    ]
    visits = {"v1": "desktop", "v2": "boe", "v3": "mobile_web", "v4": "desktop"}
    variants = {"v1": "on", "v2": "on", "v3": "off", "v4": "on"}
    return Sources(
        spark.createDataFrame(beacons, BEACON),
        spark.createDataFrame(seen, VISIT_BEACON),
        spark.createDataFrame(logs, LOG),
        spark.createDataFrame([(MONDAY, v, FLAG, t) for v, t in variants.items()], AB_TEST),
        spark.createDataFrame([(MONDAY, v, p) for v, p in visits.items()], VISIT),
    )


@pytest.mark.parametrize("stored", [False, True])
def test_experiment_report(spark, sources, stored, tmp_path):
    store = TableStore(spark, str(tmp_path)) if stored else None
    report = experiment_report(sources, PARAMS, store)
    rows = {(row.metric, row.ab_variant): row for row in report.collect()}
    assert len(rows) == 6
    on, off = rows["First Page", "on"], rows["First Page", "off"]
    assert (on.visit_count, on.request_count, on.listing_count) == (2, 1, 6)
    assert (on.solr_nir, on.nir_only, on.other) == pytest.approx((1 / 3, 1 / 3, 1 / 3))
    assert (off.visit_count, off.listing_count, off.xml_only, off.other) == (1, 2, 0.5, 0.5)


@pytest.mark.parametrize("stored", [False, True])
def test_report_over_all_log_rows(spark, sources, stored, tmp_path):
    store = TableStore(spark, str(tmp_path)) if stored else None
    report = experiment_report(sources, replace(PARAMS, repeats="all"), store)
    rows = {(row.metric, row.ab_variant): row for row in report.collect()}
    on, off = rows["First Page", "on"], rows["First Page", "off"]
    # The later log row of request a adds a listing, seen by both visits.
    assert (on.visit_count, on.request_count, on.listing_count) == (2, 1, 8)
    assert (on.solr_nir, on.nir_only, on.other) == pytest.approx((1 / 4, 1 / 4, 1 / 2))
    assert (off.listing_count, off.xml_only) == (2, 0.5)


def test_later_scripts_find_the_stored_tables(spark, sources, tmp_path):
    """The rank table of the full analysis serves the flags, the report and the visits, later on."""
    first = experiment_report(sources, PARAMS, TableStore(spark, str(tmp_path)))
    store = TableStore(spark.newSession(), str(tmp_path))
    table = store.table("stage_ranks")
    flagged = page_flags(table, sources.ab_tests, sources.visits, FLAG, PARAMS.dates)
    assert as_list(retrieval_report(flagged)) == as_list(first)
    assert as_list(store.table("retrieval_metrics")) == as_list(first)
    requests = table.select(F.col("request_uuid").alias("uuid"))
    found = request_to_visit(requests, sources.visit_beacons, MONDAY)
    assert as_set(found) == {("a", "v1"), ("a", "v2"), ("b", "v3")}


def test_quicklook_of_one_day(spark, sources):
    params = ExperimentParams.quicklook(MONDAY, FLAG, "web", repeats="first")
    assert (params.sample_size, params.sample_event, params.match_date) == (10_000, None, True)
    overall, by_query = experiment_quicklook(sources, params)
    assert overall.first().solr_first_page_share == pytest.approx(0.2)
    found = {row.query: row.nir_first_page_share for row in by_query.collect()}
    assert found == pytest.approx({"ring": 2 / 3, "mug": 0.0})


def test_rank_table_stores_every_step(spark, sources, tmp_path):
    store = TableStore(spark, str(tmp_path))
    table = rank_table(sources, PARAMS, store)
    assert as_list(table) == as_list(rank_table(sources, PARAMS))
    assert store.table("uuids_sample").count() == 2
    assert store.table("searches").count() == 3
    assert store.table("stage_ranks").count() == table.count() == 8


def test_rank_scope_of_the_quicklook(spark, sources):
    params = replace(PARAMS, rank_scope="query")
    found = rank_table(sources, params)
    assert as_set(found.select("query", "mo_last").distinct()) == {
        ("ring", 1),
        ("ring", 2),
        ("ring", 3),
        ("mug", 1),
        ("mug", 2),
    }


SESSIONS = "_date date, visit_id string, query_raw string"
AS_OF = date(2024, 3, 5)


@pytest.fixture(scope="module")
def sessions(spark):
    rows = [(MONDAY, f"v{n}", "ring") for n in range(5)] * 2
    rows += [(MONDAY, f"v{n}", "mug") for n in range(3)]
    rows += [(MONDAY, f"w{n}", "hat") for n in range(3)]
    rows += [(MONDAY, "w0", "cap"), (MONDAY, None, "cap"), (date(2024, 2, 1), "x", "old")]
    return spark.createDataFrame(rows, SESSIONS)


def test_top_queries(sessions):
    found = as_set(top_queries(sessions, AS_OF))
    assert found == {
        ("ring", 5, 5 / 8, 1),
        ("mug", 3, 3 / 8, 2),
        ("hat", 3, 3 / 8, 2),
        ("cap", 1, 1 / 8, 4),
    }
    assert len(as_set(most_used(top_queries(sessions, AS_OF), 2), "query")) == 3
    assert len(as_set(top_queries(sessions, AS_OF, days=40), "query")) == 5


def test_rank_by_count_equals_rank(spark):
    rows = spark.range(300).selectExpr("id", "id * id % 17 as n")
    expected = rows.selectExpr("id", "n", "rank() over (order by n desc) as r")
    assert as_set(rank_by_count(rows, "n", "r")) == as_set(expected)


@pytest.mark.parametrize("scope, ranks", [("request", [1, 1, 2, 2]), ("query", [1, 2, 3, 4])])
@pytest.mark.parametrize("stored", [False, True])
def test_popular_ranks(spark, sessions, tmp_path, scope, ranks, stored):
    both = [entry("solr", [2]), entry("mo_last", [1, 2])]
    logs = [log("a", both), log("b", both), log("c", both, query="cap"), log("d", both, offset=48)]
    params = TopQueryParams(AS_OF, RequestFilters("web", query_type=None, cache_bucket="live", organic_only=True), top=2, rank_scope=scope)
    store = TableStore(spark, str(tmp_path)) if stored else None
    frame = spark.createDataFrame(logs, LOG)
    table = popular_rank_table(sessions, frame, params, store)
    assert table.columns[:4] == ["uuid", "query", "listing_id", "solr"]
    assert sorted(row.mo_last for row in table.collect()) == ranks
    overall, by_query = top_query_report(sessions, frame, params)
    assert overall.first().solr_first_page_share == 0.5
    assert [row.query for row in by_query.collect()] == ["ring"]
    wider = top_query_report(sessions, frame, replace(params, extra_queries=("cap",)))[1]
    assert {row.query for row in wider.collect()} == {"ring", "cap"}


@pytest.fixture(scope="module")
def many_logs(spark):
    """12,000 requests of one query with a listing each, which a third of them found in the first source."""
    one = spark.createDataFrame([log("a", [entry("mo_last", [1])]), log("b", [entry("solr", [1]), entry("mo_last", [1])])], LOG)
    ids = spark.range(12_000).withColumn("_found", F.col("id") % 3 == 0)
    copied = one.join(ids, F.col("_found") == (F.col("RequestIdentifiers.requestUUID") == "b"))
    uuid = F.struct(F.concat(F.lit("r"), "id").alias("requestUUID"))
    return copied.withColumn("RequestIdentifiers", uuid).drop("id", "_found")


POPULAR = TopQueryParams(AS_OF, RequestFilters("web", query_type=None, cache_bucket="live", organic_only=True), top=1)


def test_report_by_query_counts_every_request(sessions, many_logs):
    rows = top_query_report(sessions, many_logs, POPULAR)[1].collect()
    assert [(row.query, row.solr_first_page_share) for row in rows] == [("ring", pytest.approx(1 / 3, abs=1e-12))]


def test_query_ranks_run_on_over_every_request(sessions, many_logs):
    """Requests follow each other by digest, and the first page is the first of them all."""
    rows = top_query_report(sessions, many_logs, replace(POPULAR, rank_scope="query"))[1].collect()
    order = sorted(range(12_000), key=lambda n: md5(f"r{n}|ring".encode()).hexdigest())
    found = sum(n % 3 == 0 for n in order[: POPULAR.first_page]) / POPULAR.first_page
    assert [(row.query, row.solr_first_page_share) for row in rows] == [("ring", found)]
