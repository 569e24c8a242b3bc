import hashlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from checks.analyses import request_to_visit_
from rankloom.operators.sampling import experiment_sample, flagged_requests, stable_sample
from rankloom.operators.searches import request_to_visit, sample_searches
from rankloom.sources import TableStore
from tests.fixtures import (
    BEACON,
    FLAG,
    MONDAY,
    TUESDAY,
    VISIT_BEACON,
    as_list,
    as_set,
    beacon,
    visit_beacon,
)


@pytest.mark.parametrize("n", [0, 1, 7, 300, 999, 1000, 5000])
def test_stable_sample_takes_the_smallest_digests(spark, n):
    rows = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    taken = as_set(stable_sample(rows, n, "s", ["k"]))
    order = sorted(range(1000), key=lambda k: hashlib.md5(f"s|{k}".encode()).hexdigest())
    assert taken == {(k, 2 * k) for k in order[:n]}


def test_stable_sample_depends_on_the_seed_only(spark):
    rows = spark.range(500).toDF("k")
    first = as_set(stable_sample(rows, 50, "a", ["k"]))
    assert first == as_set(stable_sample(rows.repartition(7), 50, "a", ["k"]))
    assert first != as_set(stable_sample(rows, 50, "b", ["k"]))


def test_stable_sample_orders_only_the_last_bucket(spark, monkeypatch):
    monkeypatch.setattr("rankloom.operators.sampling.BUCKET_DIGITS", 1)
    taken = as_set(stable_sample(spark.range(1000).toDF("k"), 333, "s", ["k"]))
    order = sorted(range(1000), key=lambda k: hashlib.md5(f"s|{k}".encode()).hexdigest())
    assert taken == {(k,) for k in order[:333]}


def test_eligible_requests(spark):
    rows = [
        beacon("u1", ["on"]),
        beacon("u1", ["on"]),
        beacon("u1", ["off"]),
        beacon("u2", ["ineligible"]),
        beacon("u3", [None]),
        beacon("u4", []),
        beacon("u5", ["on"], event="home"),
        beacon("u6", ["on"], day=TUESDAY),
        beacon("u7", ["on"], flag="exp.two"),
    ]
    beacons = spark.createDataFrame(rows, BEACON)
    taken = as_set(experiment_sample(beacons, FLAG, [MONDAY], 99, event_name="search"))
    assert taken == {("u1", FLAG, "on"), ("u1", FLAG, "off")}
    any_event = as_list(experiment_sample(beacons, FLAG, [MONDAY], 99), "request_uuid")
    assert any_event == [("u1",), ("u1",), ("u5",)]
    with pytest.raises(PySparkException, match="no element 0"):
        flagged_requests(beacons, FLAG, strict=True).collect()


def test_two_arrays_give_every_pair(spark):
    day, event, _, _ = beacon("u", ["on"])
    flags = [(FLAG, (["on"],)), ("other", (["x"],)), (FLAG, (["off"],))]
    properties = [("request_uuid", "a"), ("request_uuid", "b"), ("page", "p")]
    beacons = spark.createDataFrame([(day, event, (flags,), (properties,))], BEACON)
    pairs = as_set(flagged_requests(beacons, FLAG), "request_uuid", "ab_flag_variant")
    assert pairs == {("a", "on"), ("a", "off"), ("b", "on"), ("b", "off")}


SAMPLE = "request_uuid string, ab_flag string, ab_flag_variant string"


@pytest.mark.parametrize("bound", [None, 10])
def test_searches_of_a_sample(spark, bound):
    sample = spark.createDataFrame([("u1", FLAG, "on"), ("u2", FLAG, "off")], SAMPLE)
    rows = [
        visit_beacon("v1", "u1", "ring"),
        visit_beacon("v2", "u1", "ring"),
        visit_beacon("v3", "u2", None),
        visit_beacon("v4", "u3", "mug"),
        visit_beacon("v5", "u1", "mug", event="home"),
        visit_beacon("v6", "u1", "mug", day=TUESDAY),
        visit_beacon("v7", None, "mug"),
    ]
    beacons = spark.createDataFrame(rows, VISIT_BEACON)
    found = as_set(sample_searches(sample, beacons, [MONDAY], max_sample=bound))
    assert found == {(MONDAY, "u1", FLAG, "v1", "ring"), (MONDAY, "u1", FLAG, "v2", "ring")}


def test_a_request_with_two_variants_repeats_its_searches(spark):
    sample = spark.createDataFrame([("u1", FLAG, "on"), ("u1", FLAG, "off")], SAMPLE)
    beacons = spark.createDataFrame([visit_beacon("v1", "u1", "ring")], VISIT_BEACON)
    assert len(as_list(sample_searches(sample, beacons, [MONDAY]))) == 2


def test_visits_of_requests(spark):
    rows = [
        visit_beacon("v1", "u1", "ring"),
        visit_beacon("v1", "u1", "mug"),
        visit_beacon("v2", "u1", "ring", day=TUESDAY),
        visit_beacon("v3", "u9", "ring"),
    ]
    beacons = spark.createDataFrame(rows, VISIT_BEACON)
    ranks = spark.createDataFrame([("u1",), ("u1",), ("u2",)], "uuid string")
    assert as_set(request_to_visit(ranks, beacons, MONDAY)) == {("u1", "v1"), ("u1", "v2")}
    assert as_set(request_to_visit(ranks, beacons, TUESDAY)) == {("u1", "v2")}


def test_visits_of_requests_in_a_stored_table(spark, tmp_path):
    rows = [visit_beacon("v1", "u1", "ring"), visit_beacon("v2", None, "mug"), visit_beacon("v3", "u9", "ring")]
    beacons = spark.createDataFrame(rows, VISIT_BEACON)
    ranks = spark.createDataFrame([("u1",), ("u1",), (None,), ("u2",)], "uuid string")
    store = TableStore(spark, str(tmp_path))
    assert as_set(request_to_visit(ranks, beacons, MONDAY, store=store)) == {("u1", "v1")}
    assert as_set(store.table("requests")) == {("u1",), ("u2",)}


def test_the_rank_table_is_not_worked_out_again_for_its_visits(spark):
    found = request_to_visit_(spark, "/root/testdata/sf0.001")
    assert not [file for file in found.inputFiles() if "lineitem" in file]
