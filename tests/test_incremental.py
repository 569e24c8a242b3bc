"""Results that grow by date, estimated counts, stored order and tables chosen by name."""

import random
from collections import defaultdict
from dataclasses import replace
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from checks import relations as R
from checks.analyses import EXPERIMENT, QUICKLOOK, sources
from checks.compare import order_difference
from checks.incremental import experiment_report_by_dates
from checks.registry import ORDERED
from checks.stores import new_store
from rankloom.operators import visit_sets as V
from rankloom.operators.distinct import (
    count_distinct,
    distinct_sketches,
    estimate_sketches,
    merge_sketches,
)
from rankloom.operators.metrics import retrieval_report
from rankloom.operators.popular import most_used, top_queries, top_queries_bounded
from rankloom.operators.ranks import mixed_ranks, running_ranks
from rankloom.operators.sampling import merge_samples, stable_sample
from rankloom.params import ExperimentParams, RequestFilters, TopQueryParams
from rankloom.plans import experiment_report, experiment_report_by_date
from rankloom.sources import TableStore, read_prefixed, table_date
from tests.fixtures import as_list, as_set, entry, flat_logs, log

FOLDER = "/root/testdata/sf0.001"
MAY = date(2024, 5, 1)
SESSION = "_date date, visit_id bigint, query_raw string"


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def sessions(spark, seed, rows=600, visits=80, queries=12):
    chance = random.Random(seed)
    names = [None, *[f"q{n}" for n in range(queries)]]
    return spark.createDataFrame(
        [
            (
                MAY + timedelta(days=chance.randrange(12)),
                None if chance.random() < 0.02 else chance.randrange(visits),
                names[int(chance.random() ** 2 * len(names))],
            )
            for _ in range(rows)
        ],
        SESSION,
    )


# Estimated counts


def test_sketches_of_large_groups_come_near(spark):
    rows = spark.range(400_000).selectExpr("id % 3 as g", "concat('v', id div 2) as visit_id", "id % 5 as day")
    exact = {r.g: r.n for r in count_distinct(rows, ["g"], "visit_id", "n").collect()}
    parts = distinct_sketches(rows, ["g", "day"], "visit_id")
    for found in (
        count_distinct(rows, ["g"], "visit_id", "n", approximate=True),
        estimate_sketches(merge_sketches(parts, ["g"]), "n"),
    ):
        assert all(abs(r.n - exact[r.g]) <= 0.02 * exact[r.g] for r in found.collect())


def test_sketches_of_small_groups_nulls_and_no_rows(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("a", None), ("b", None), (None, 5)], "g string, v bigint")
    found = count_distinct(rows, ["g"], "v", "n", approximate=True)
    assert as_set(found) == {("a", 1), ("b", 0), (None, 1)}
    assert count_distinct(rows.limit(0), ["g"], "v", "n", approximate=True).count() == 0


def test_ids_are_not_shuffled_for_sketches(spark):
    rows = spark.range(100).selectExpr("id % 3 as g", "id as v")
    plan = plan_of(count_distinct(rows, ["g"], "v", "n", approximate=True))
    assert plan.count("Exchange") == 1 and "Expand" not in plan


def test_estimated_report_has_exact_shares(spark):
    schema = "ab_variant string, visit_id string, request_uuid string, solr int, nir int, xwalk int, xml int, mo_last int, page_1_flag int, top_3_flag int"
    rows = spark.range(900).selectExpr(
        "if(id % 2 = 0, 'on', 'off') ab_variant", "concat('v', id % 70) visit_id", "concat('r', id % 90) request_uuid",
        "if(id % 3 = 0, 1, null) solr", "if(id % 4 = 0, 1, null) nir", "if(id % 5 = 0, 1, null) xwalk",
        "null xml", "int(id % 40) mo_last", "int(id % 40 < 9) page_1_flag", "int(id % 40 < 27) top_3_flag",
    ).select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in schema.split(", ")])
    # Groups this small are counted without error.
    assert as_set(retrieval_report(rows, approximate=True)) == as_set(retrieval_report(rows))
    assert "hll_sketch" in plan_of(retrieval_report(rows, approximate=True))
    assert "hll_sketch" not in plan_of(retrieval_report(rows))


# Popular queries


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("top", [1, 3, 12, 50])
def test_bounded_top_list_equals_the_whole_one(spark, seed, top):
    rows = sessions(spark, seed, rows=300, visits=25).cache()
    expected = as_set(most_used(top_queries(rows, MAY + timedelta(days=9)), top))
    assert as_set(top_queries_bounded(rows, MAY + timedelta(days=9), top)) == expected


def test_bounded_top_list_with_ties_and_repeats(spark):
    """Many rows of few visits come first by rows, and fall out by visits; tied queries all stay."""
    rows = [(MAY, 1, "often")] * 50 + [(MAY, v, q) for q in ("a", "b", "c") for v in range(4)] + [(MAY, 9, "rare")]
    frame = spark.createDataFrame(rows, SESSION)
    found = top_queries_bounded(frame, MAY, 2)
    assert as_set(found, "query", "rank") == {("a", 1), ("b", 1), ("c", 1)}
    assert top_queries_bounded(frame.limit(0), MAY, 2).count() == 0


def test_numbers_are_dense_and_stay(spark):
    ids = spark.createDataFrame([(f"v{n % 700}",) for n in range(2000)] + [(None,)], "visit_id string")
    first = V.number_visits(ids)
    held = dict(map(tuple, first.collect()))
    assert sorted(held.values()) == list(range(700))
    later = V.number_visits(spark.createDataFrame([(f"v{n}",) for n in range(650, 900)], "visit_id string"), first)
    more = dict(map(tuple, later.collect()))
    assert sorted(more.values()) == list(range(700, 900)) and not more.keys() & held.keys()


@pytest.mark.parametrize("least", [1, 3, 10_000])
def test_sets_of_days_count_visits_once(spark, monkeypatch, least):
    """Bitmaps only, both kinds, lists only; several blocks."""
    monkeypatch.setattr(V, "LEAST_BITMAP", least)
    chance = random.Random(least)
    rows = [(MAY + timedelta(days=chance.randrange(5)), chance.randrange(40) * 3001, chance.choice("abbbc")) for _ in range(300)]
    frame = spark.createDataFrame(rows, "_date date, visit_id bigint, query string")
    numbers = frame.select("visit_id", F.col("visit_id").alias("number")).distinct()
    sets = V.visit_sets(frame, numbers, ["query", "_date"])
    held = defaultdict(set)
    for day, visit, query in rows:
        if day >= MAY + timedelta(days=1):
            held[query].add(visit)
    recent = sets.filter(F.col("_date") > F.lit(MAY))
    assert dict(as_list(V.count_sets(recent, ["query"], "n"))) == {q: len(v) for q, v in held.items()}
    assert as_list(V.count_sets(recent, [], "n")) == [(len(set.union(*held.values())),)]
    kinds = sets.agg(F.count("bitmap"), F.count("places")).first()
    assert (kinds[0] > 0) == (least < 10_000) and (kinds[1] > 0) == (least > 1)


def test_rolling_lists_equal_lists_of_all_rows(spark):
    rows = sessions(spark, 7).filter("visit_id IS NOT NULL").withColumnRenamed("query_raw", "query").cache()
    store = new_store(spark)
    numbers = store.replace("numbers", V.number_visits(rows))
    sets = store.replace("sets", V.visit_sets(rows, numbers, ["query", "_date"]), "_date")
    for n in range(0, 14, 4):
        as_of = MAY + timedelta(days=n)
        expected = as_set(top_queries(rows.withColumnRenamed("query", "query_raw"), as_of, 3))
        assert as_set(V.top_queries_of_sets(sets, as_of, 3)) == expected


# Samples


@pytest.mark.parametrize("n", [1, 40, 500, None])
def test_samples_of_dates_merge_to_the_sample_of_all(spark, n):
    rows = spark.range(400).selectExpr("concat('r', id % 150) k", "id % 4 v", "id % 7 day")
    whole = stable_sample(rows.select("k", "v").distinct(), n, "5", ["k", "v"])
    states = [
        stable_sample(rows.filter(f"day = {d}").select("k", "v").distinct(), n, "5", ["k", "v"]) for d in range(7)
    ]
    early = merge_samples(states[:3], n, "5", ["k", "v"])
    assert as_set(merge_samples([states[6], early, *states[3:6]], n, "5", ["k", "v"])) == as_set(whole)


# Reports over dates


def test_a_further_date_reads_its_own_logs_only(spark):
    params = replace(EXPERIMENT, match_date=True, sample_size=None)
    store = new_store(spark)
    found = sources(spark, FOLDER)
    experiment_report_by_date(found, replace(params, dates=R.DAYS[:2]), store)
    last = found.rpc_logs.filter(F.to_date("queryTime") == F.lit(R.DAYS[2]))
    grown = experiment_report_by_date(replace(found, rpc_logs=last), params, store)
    assert as_set(grown) == as_set(experiment_report(found, params)) != set()
    # All dates are stored now: nothing is read from logs at all.
    none = replace(found, rpc_logs=found.rpc_logs.limit(0))
    assert as_set(experiment_report_by_date(none, params, store)) == as_set(grown)


def test_counts_by_date_need_their_own_days(spark):
    for other in ({"match_date": False}, {"sample_size": 5}, {"rank_scope": "query"}):
        params = replace(EXPERIMENT, **({"match_date": True, "sample_size": None} | other))
        with pytest.raises(ValueError, match="counts by date"):
            experiment_report_by_date(sources(spark, FOLDER), params, new_store(spark))


# Ranks


def test_first_step_within_the_request(spark):
    logs = flat_logs(
        spark,
        [log(u, [entry("solr", [1, 2]), entry("nir", [3]), entry("mo_last", [1, 3])], query="ring") for u in "abc"],
    )
    keys = ["request_uuid", "query"]
    mixed = as_set(mixed_ranks(logs, keys), "request_uuid", "step", "listing_id", "rank")
    assert {r for r in mixed if r[1] == "solr"} == {(u, "solr", n, n) for u in "abc" for n in (1, 2)}
    shared = as_set(running_ranks(logs, "query", keys), "request_uuid", "step", "listing_id", "rank")
    assert {r for r in mixed if r[1] != "solr"} == {r for r in shared if r[1] != "solr"}
    assert sorted(r[3] for r in mixed if r[1] == "nir") == [1, 2, 3]


def test_mixed_scope_is_for_the_quick_look_only(spark):
    assert replace(QUICKLOOK, rank_scope="mixed").rank_scope == "mixed"
    with pytest.raises(ValueError, match="rank_scope"):
        TopQueryParams(MAY, RequestFilters("web", query_type=None, cache_bucket=None, organic_only=False), rank_scope="mixed")
    with pytest.raises(ValueError, match="within a request"):
        experiment_report(sources(spark, FOLDER), replace(EXPERIMENT, rank_scope="mixed"))
    with pytest.raises(ValueError, match="rank_scope"):
        ExperimentParams((MAY,), "f", "web", rank_scope="other")


# Order and names


def test_stored_order_is_read_back(spark):
    rows = spark.range(5000).selectExpr("id", "hash(id) as h").repartition(7)
    store = new_store(spark)
    store.replace_sorted("sorted", rows, F.col("h").desc(), "id")
    found = [tuple(r) for r in store.sorted_table("sorted").select("h", "id").collect()]
    assert found == sorted(found, key=lambda r: (-r[0], r[1])) and len(found) == 5000
    assert store.has("sorted") and not store.has("other")
    plan = plan_of(store.sorted_table("sorted"))
    assert "Sort [_file" in plan and "Sort [h" not in plan


def test_order_is_compared(spark):
    from checks.compare import connect

    con = connect(FOLDER)
    text = "SELECT o_orderkey FROM orders ORDER BY o_orderkey"

    def query(order):
        return lambda s, f: R.table(s, f, "orders").select("o_orderkey").orderBy(order)

    assert order_difference(spark, con, query("o_orderkey"), text, FOLDER, ["o_orderkey"]) is None
    assert order_difference(spark, con, query(F.desc("o_orderkey")), text, FOLDER, ["o_orderkey"])


@pytest.mark.parametrize("name", sorted(ORDERED))
def test_ordered_queries_keep_their_order(spark, name):
    import __spark_entry__ as entry_
    from checks.compare import connect

    query, text = entry_.queries()[name], entry_.oracle_sql()[name]
    assert order_difference(spark, connect(FOLDER), query, text, FOLDER, ORDERED[name]) is None


def test_dates_in_names():
    assert table_date("rpc_20240105.parquet", "rpc_") == date(2024, 1, 5) == table_date("rpc_20240105", "rpc_")
    assert table_date("rpc_x", "rpc_") is None and table_date("r2024-01", "r", "%Y-%m") == date(2024, 1, 1)


def test_tables_out_of_range_are_not_opened(spark, tmp_path):
    for day in range(1, 6):
        spark.range(day).selectExpr(f"{day} as d").write.parquet(f"{tmp_path}/rpc_202405{day:02}.parquet")
    spark.range(1).selectExpr("99 as d").write.parquet(f"{tmp_path}/rpc_all.parquet")
    (tmp_path / "rpc_20240509.parquet").mkdir()
    (tmp_path / "rpc_20240509.parquet" / "part-0.parquet").write_bytes(b"not a table")
    found = read_prefixed(spark, str(tmp_path), "rpc_", since=date(2024, 5, 2), until=date(2024, 5, 4))
    assert sorted(r.d for r in found.collect()) == [2, 2, 3, 3, 3, 4, 4, 4, 4, 99]
    with pytest.raises(ValueError, match="no table"):
        read_prefixed(spark, str(tmp_path), "zzz_", since=date(2024, 5, 2))


def test_dates_choose_tables_of_a_database(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS days")
    names = ["rpc_20240501", "rpc_20240502"]
    try:
        for n, name in enumerate(names):
            spark.range(n + 1).selectExpr(f"{n} as d").write.mode("overwrite").saveAsTable(f"days.{name}")
        assert [r.d for r in read_prefixed(spark, "days", "rpc_", since=date(2024, 5, 2)).collect()] == [1, 1]
    finally:
        spark.sql("DROP DATABASE days CASCADE")


# Logs read by date


def test_report_by_dates_derives_and_reads_its_logs_once(spark, monkeypatch):
    """Of all tables written one is made of the line items, and one for each date of the logs."""
    written, replace_table = {}, TableStore.replace

    def recorded(self, name, rows, partition_by=None):
        written[name] = rows.inputFiles()
        return replace_table(self, name, rows, partition_by)

    monkeypatch.setattr(TableStore, "replace", recorded)
    experiment_report_by_dates(spark, FOLDER)
    of_items = [name for name, files in written.items() if any("lineitem" in file for file in files)]
    assert of_items == ["rpc_logs"]
    of_logs = {name for name, files in written.items() if any("/rpc_logs/" in file for file in files)}
    assert of_logs == {f"log_rows_{day:%Y%m%d}" for day in R.DAYS}
