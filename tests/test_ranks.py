import random

import pytest
from pyspark.sql import functions as F

from rankloom.operators import joins, ranks
from rankloom.operators.ranks import (
    STEP_NAMES,
    STEPS,
    candidate_entries,
    listing_ranks,
    pivot_ranks,
    ranked_candidates,
    running_ranks,
    sort_stage_ranks,
    stage_ranks_joined,
    stage_ranks_pivot,
    trimmed_candidates,
)
from tests.fixtures import (
    FLAG,
    LOG,
    MONDAY,
    SEARCH,
    TUESDAY,
    as_list,
    as_set,
    entry,
    flat_logs,
    log,
    moment,
)

KEYS = ["request_uuid"]


def ranked(spark, entries, cap=1000):
    """Step, listing and rank of one request."""
    frame = listing_ranks(flat_logs(spark, [log("a", entries)]), KEYS, cap)
    return as_set(frame, "step", "listing_id", "rank")


def test_ranks_are_positions(spark):
    entries = [entry("solr", [7, 5]), entry("mo_last", [5, 7, 9])]
    assert ranked(spark, entries) == {
        ("solr", 7, 1),
        ("solr", 5, 2),
        ("mo_last", 5, 1),
        ("mo_last", 7, 2),
        ("mo_last", 9, 3),
    }


def test_every_step_has_its_label(spark):
    assert ranked(spark, [entry(name, [n]) for n, name in enumerate(STEP_NAMES)]) == {
        (name, n, 1) for n, name in enumerate(STEP_NAMES)
    }


def test_entries_that_count_for_no_step(spark):
    entries = [
        entry("solr", [1], mixed="yes"),
        ("POST_FILTER", None, None, [2]),
        ("RANKING", "SOLR", None, [3]),
        ("ELSEWHERE", None, None, [4]),
        (None, "SOLR", None, [5]),
        entry("nir", []),
        entry("xml", None),
        None,
        entry("mo_last", [6]),
    ]
    assert ranked(spark, entries) == {("mo_last", 6, 1)}
    assert ranked(spark, None) == set() and ranked(spark, []) == set()
    logs = flat_logs(spark, [log("a", entries)])
    trimmed = logs.withColumn("candidateSources", trimmed_candidates("candidateSources", 5))
    assert as_set(listing_ranks(trimmed, KEYS), "step", "listing_id", "rank") == {("mo_last", 6, 1)}


def test_ranks_continue_over_entries_of_a_step(spark):
    entries = [entry("solr", [1, 2]), entry("nir", [9]), entry("solr", None), entry("solr", [3])]
    found = {row for row in ranked(spark, entries) if row[0] == "solr"}
    assert found == {("solr", 1, 1), ("solr", 2, 2), ("solr", 3, 3)}


def test_rank_cap(spark):
    entries = [entry("mo_last", list(range(600))), entry("mo_last", list(range(600, 1200)))]
    found = ranked(spark, entries)
    assert ("mo_last", 999, 1000) in found and len(found) == 1000
    assert len(ranked(spark, entries, cap=None)) == 1200


def test_candidate_entries_keep_their_place(spark):
    entries = [entry("solr", [1]), entry("solr", [2], mixed="x"), entry("nir", [3])]
    placed = candidate_entries(flat_logs(spark, [log("a", entries)]), KEYS)
    assert as_list(placed, "entry_pos", "source") == [(0, "SOLR"), (1, "ANN")]


def test_pivot_keeps_listings_of_the_final_step(spark):
    entries = [entry("solr", [7, 5, 8]), entry("mo_last", [5, 7, 9, 5])]
    table = pivot_ranks(listing_ranks(flat_logs(spark, [log("a", entries)]), KEYS), KEYS)
    assert as_set(table, "listing_id", "solr", "nir", "mo_last") == {
        (5, 2, None, 1),
        (7, 1, None, 2),
        (9, None, None, 3),
    }


def random_logs(seed, requests=12, repeats=False):
    """Log rows whose steps list some of 30 listings, each once unless ``repeats``."""
    chance = random.Random(seed)
    rows = []
    for n in range(requests):
        entries = []
        for name in STEP_NAMES:
            ids = chance.sample(range(30), chance.randrange(0, 15))
            cut = chance.randrange(0, len(ids) + 1)
            entries += [entry(name, ids[:cut]), entry(name, [99], mixed="x")]
            entries += [entry(name, ids[cut:])]
        chance.shuffle(entries)
        query = chance.choice(["ring", "mug", None])
        rows.append(log(f"u{n}", entries, minute=chance.randrange(90), query=query))
    return rows


@pytest.mark.parametrize("cap", [3, 8, 1000])
def test_pivot_and_join_chain_agree(spark, cap):
    logs = flat_logs(spark, random_logs(cap))
    inside = listing_ranks(logs, KEYS, cap)
    window = ranked_candidates(logs, KEYS, order=["query_time"], cap=cap)
    columns = ["request_uuid", "step", "listing_id", "rank"]
    assert as_set(inside, *columns) == as_set(window, *columns)
    columns = ["request_uuid", "listing_id", *STEP_NAMES]
    joined = stage_ranks_joined(window, KEYS)
    assert as_set(pivot_ranks(inside, KEYS), *columns) == as_set(joined, *columns)


def test_join_chain_multiplies_copies(spark):
    entries = [entry("solr", [1]), entry("mo_last", [1])]
    logs = flat_logs(spark, [log("a", entries), log("a", entries, minute=1)])
    window = ranked_candidates(logs, KEYS, order=["query_time"])
    assert len(as_list(stage_ranks_joined(window, KEYS))) == 4
    assert as_set(pivot_ranks(window, KEYS), "solr", "mo_last") == {(1, 1)}


@pytest.mark.parametrize("cap", [4, 30, None])
@pytest.mark.parametrize("digits", [1, 3])
def test_running_ranks_equal_a_window_over_the_scope(spark, monkeypatch, cap, digits):
    monkeypatch.setattr(ranks, "PREFIX_DIGITS", digits)
    logs = flat_logs(spark, random_logs(5, requests=40))
    found = running_ranks(logs, "query", KEYS, cap)
    digested = logs.withColumn("digest", F.md5("request_uuid"))
    window = ranked_candidates(
        digested, ["query", "request_uuid"], "query", ["digest"], cap or 10_000
    )
    columns = ["query", "request_uuid", "step", "listing_id", "rank"]
    assert as_set(found, *columns) == as_set(window, *columns)


def test_running_ranks_restart_under_request_scope(spark):
    rows = [log(uuid, [entry("mo_last", [1, 2])]) for uuid in ("a", "b")]
    logs = flat_logs(spark, rows)
    by_query = running_ranks(logs, "query", KEYS)
    assert sorted(row[0] for row in by_query.select("rank").collect()) == [1, 2, 3, 4]
    by_request = running_ranks(logs, "request_uuid", KEYS)
    assert sorted(row[0] for row in by_request.select("rank").collect()) == [1, 1, 2, 2]


SEARCHES = [
    (MONDAY, "a", FLAG, "v1", "ring"),
    (MONDAY, "a", FLAG, "v1", "ring"),
    (TUESDAY, "a", FLAG, "v2", "mug"),
    (MONDAY, "b", FLAG, "v3", "ring"),
    (MONDAY, "none", FLAG, "v4", "ring"),
]
LOGS = [
    log("a", [entry("solr", [2, 3]), entry("mo_last", [1, 2, 3])], minute=1),
    log("a", [entry("mo_last", [9])], minute=5),
    log("a", [entry("mo_last", [8])], day=TUESDAY),
    log("b", [entry("nir", [1]), entry("mo_last", [4, 1])]),
    log("c", [entry("mo_last", [1])]),
    log("b", [entry("mo_last", [7])], placement="app"),
]
COLUMNS = ["_date", "request_uuid", "visit_id", "listing_id", "solr", "nir", "mo_last"]


def rank_table(spark, **options):
    searches = spark.createDataFrame(SEARCHES, SEARCH)
    logs = spark.createDataFrame(LOGS, LOG)
    return stage_ranks_pivot(searches, logs, [MONDAY, TUESDAY], "web", **options)


B_ROWS = {(MONDAY, "b", "v3", 4, None, None, 1), (MONDAY, "b", "v3", 1, None, 1, 2)}


def a_rows(day, visit):
    return {
        (day, "a", visit, 1, None, None, 1),
        (day, "a", visit, 2, 1, None, 2),
        (day, "a", visit, 3, 2, None, 3),
    }


def all_rows(day, visit):
    """Ranks over the three log rows of request a, in the order of their time."""
    rest = {(day, "a", visit, 9, None, None, 4), (day, "a", visit, 8, None, None, 5)}
    return a_rows(day, visit) | rest


@pytest.mark.parametrize("bound", [None, 50])
@pytest.mark.parametrize("heavy", [1, 20_000])
def test_rank_table_over_all_log_rows(spark, monkeypatch, bound, heavy):
    monkeypatch.setattr(ranks, "HEAVY_SEARCHES", heavy)
    found = as_list(rank_table(spark, max_requests=bound), *COLUMNS)
    copies = [*all_rows(MONDAY, "v1")] * 2  # its beacon was sent twice
    assert found == sorted([*copies, *all_rows(TUESDAY, "v2"), *B_ROWS], key=str)
    few = as_list(rank_table(spark, max_requests=bound, cap=4), *COLUMNS)
    assert few == [row for row in found if row[-1] <= 4]


def test_ranks_by_time_equal_a_window(spark):
    rows = random_logs(7) + [log(f"u{n}", [entry("mo_last", [n, 50])], minute=95) for n in range(9)]
    rows += [log("u1", [entry("solr", list(range(60, 75)))], minute=m, day=TUESDAY) for m in (1, 2)]
    logs = flat_logs(spark, rows)
    columns = ["request_uuid", "step", "listing_id", "rank"]
    for cap in (4, 1000):
        found = running_ranks(logs, KEYS, KEYS, cap, by_time=True, gather=True)
        window = ranked_candidates(logs, KEYS, order=["query_time"], cap=cap)
        assert as_set(found, *columns) == as_set(window, *columns)


def test_ranks_are_whole_numbers(spark):
    table = rank_table(spark)
    assert {dict(table.dtypes)[name] for name in STEP_NAMES} == {"bigint"}


@pytest.mark.parametrize("bound", [None, 50])
@pytest.mark.parametrize("heavy", [1, 20_000])
def test_rank_table_of_shared_requests(spark, monkeypatch, bound, heavy):
    monkeypatch.setattr(ranks, "HEAVY_SEARCHES", heavy)
    found = as_set(rank_table(spark, max_requests=bound, repeats="first"), *COLUMNS)
    assert found == B_ROWS | a_rows(MONDAY, "v1") | a_rows(TUESDAY, "v2")


def test_rank_table_with_logs_of_the_same_day(spark):
    found = as_set(rank_table(spark, match_date=True, repeats="first"), *COLUMNS)
    assert found == B_ROWS | a_rows(MONDAY, "v1") | {(TUESDAY, "a", "v2", 8, None, None, 1)}


def test_rank_table_under_query_scope(spark):
    found = rank_table(spark, rank_scope="query", repeats="first")
    ring = sorted(r[0] for r in found.filter("query = 'ring'").select("mo_last").collect())
    mug = sorted(r[0] for r in found.filter("query = 'mug'").select("mo_last").collect())
    assert (ring, mug) == ([1, 2, 3, 4, 5], [1, 2, 3])


def test_one_exchange_carries_the_log(spark, tmp_path):
    spark.createDataFrame(LOGS, LOG).write.parquet(f"{tmp_path}/logs")
    spark.createDataFrame(SEARCHES, SEARCH).write.parquet(f"{tmp_path}/searches")
    searches = spark.read.parquet(f"{tmp_path}/searches")
    logs = spark.read.parquet(f"{tmp_path}/logs")
    once = ranks.sampled_candidates(
        searches, logs, [MONDAY], "web", max_requests=50, repeats="first"
    )
    table = ranks.request_ranks(once, KEYS, repeats="first")
    text = table._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(request_uuid") == 2
    assert "WindowGroupLimit" in text and "CartesianProduct" not in text
    assert "queryType" not in text.split("ReadSchema")[-1]


@pytest.mark.parametrize("bound", [None, 50])
def test_only_wanted_log_rows_enter_an_exchange(spark, tmp_path, bound):
    """The semi-join with the ids sits right on the scan, at a known and an unknown sample size."""
    spark.createDataFrame(LOGS, LOG).write.parquet(f"{tmp_path}/logs")
    spark.createDataFrame(SEARCHES, SEARCH).write.parquet(f"{tmp_path}/searches")
    searches = spark.read.parquet(f"{tmp_path}/searches")
    logs = spark.read.parquet(f"{tmp_path}/logs")
    rows = ranks.sampled_candidates(searches, logs, [MONDAY], "web", max_requests=bound)
    text = rows._jdf.queryExecution().executedPlan().toString()
    above, scan = text.split("LeftSemi", 1)
    assert "Exchange" not in above and "BroadcastExchange" in scan
    assert "Exchange hashpartitioning" not in scan.split("BroadcastExchange")[0]


def test_a_hot_request_is_unnested_once(spark, tmp_path):
    """Both branches of the join with searches exist; only one unnests the log as a whole."""
    spark.createDataFrame(LOGS, LOG).write.parquet(f"{tmp_path}/logs")
    spark.createDataFrame(SEARCHES, SEARCH).write.parquet(f"{tmp_path}/searches")
    searches = spark.read.parquet(f"{tmp_path}/searches")
    logs = spark.read.parquet(f"{tmp_path}/logs")
    table = stage_ranks_pivot(searches, logs, [MONDAY], "web", max_requests=50, repeats="first")
    text = table._jdf.queryExecution().optimizedPlan().toString()
    whole, sliced = text.split("_slices", 1)
    assert whole.count("Generate posexplode") == 1 and sliced.count("Generate posexplode") == 1
    # Below the second one, log rows meet the heavy keys first.
    assert "LeftSemi" in sliced.split("Generate posexplode")[1].split("Relation")[0]


def test_broadcast_needs_a_limit(spark):
    ids = spark.createDataFrame([("a",)], "request_uuid string")
    assert not joins.fits_broadcast(ids, None)
    assert joins.fits_broadcast(ids, 3_000_000) and not joins.fits_broadcast(ids, 30_000_000)


def test_sorted_rank_table(spark):
    rows = [("b", 1, None), ("a", 2, 1), (None, 9, 1), ("a", 1, None), ("a", 1, 5)]
    frame = spark.createDataFrame(rows, "query string, mo_last bigint, mo_list bigint")
    for name in STEP_NAMES[:6]:
        frame = frame.withColumn(name, F.lit(1))
    found = [tuple(r) for r in sort_stage_ranks(frame).select("query", "mo_last", "mo_list").collect()]
    assert found == [(None, 9, 1), ("a", 1, 5), ("a", 1, None), ("a", 2, 1), ("b", 1, None)]


def test_ranks_are_dense(spark):
    logs = flat_logs(spark, random_logs(3))
    groups = listing_ranks(logs, KEYS).groupBy("request_uuid", "step")
    bad = groups.agg(F.max("rank").alias("m"), F.countDistinct("rank").alias("n")).filter("m <> n")
    assert bad.count() == 0
    assert moment(MONDAY, 1) > moment(MONDAY)


def test_entries_are_limited_before_they_are_unnested(spark):
    plan = ranked_candidates(flat_logs(spark, random_logs(1)), KEYS, order=["query_time"], cap=3)
    text = plan._jdf.queryExecution().executedPlan().toString()
    unnested = text.index("posexplode(")
    # A plan begins with what is done last: the limit within each task is below the unnesting.
    assert "Partial" in text[unnested:] and "Partial" not in text[:unnested]


@pytest.mark.parametrize("cap", [1, 2, 3, 7, 50])
@pytest.mark.parametrize("seed", range(3))
def test_window_ranks_of_tied_log_rows(spark, seed, cap):
    """Log rows of few minutes and queries, so that entries of many log rows share a place."""
    chance = random.Random(seed)
    rows = [
        log(
            f"u{n}",
            [
                entry(
                    chance.choice(STEP_NAMES[:2]),
                    chance.choice([None, [chance.randrange(9) for _ in range(chance.randrange(5))]]),
                )
                for _ in range(4)
            ],
            minute=chance.randrange(3),
            query=chance.choice(["ring", None]),
        )
        for n in range(40)
    ]
    logs = flat_logs(spark, rows)
    found = ranked_candidates(logs, ["query", "query_time"], "query", ["query_time"], cap)
    groups = {}
    for row in logs.collect():
        for place, (stage, source, _, ids) in enumerate(row.candidateSources):
            name = next(s.name for s in STEPS if (s.stage, s.source) == (stage, source))
            for pos, listing in enumerate(ids or []):
                place_of = (row.query_time, place, pos, listing)
                groups.setdefault((row.query, name), []).append(place_of)
    expected = {
        (query, time, name, listing, rank)
        for (query, name), places in groups.items()
        for rank, (time, _, _, listing) in enumerate(sorted(places)[:cap], 1)
    }
    assert as_set(found, "query", "query_time", "step", "listing_id", "rank") == expected
