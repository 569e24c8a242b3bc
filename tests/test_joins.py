"""Joins over uneven keys and large sets of keys, and chains of equal rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rankloom.operators import joins
from rankloom.operators.ranks import (
    STEP_NAMES,
    expand_copies,
    running_ranks,
    stage_ranks_joined,
    stage_ranks_weighted,
)
from tests.fixtures import MONDAY, as_list, as_set, entry, flat_logs, log


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def keyed(spark):
    rows = spark.range(300).selectExpr("string(id % 40) as k", "if(id % 7 = 0, null, id % 3) as n", "id")
    wanted = spark.range(90).selectExpr("string(id % 25) as k", "if(id % 5 = 0, null, id % 2) as n")
    return rows, wanted, as_set(rows.join(wanted, ["k", "n"], "left_semi"))


def test_semi_join_by_digests_keys_and_bitmap(spark, monkeypatch):
    rows, wanted, expected = keyed(spark)
    assert as_set(joins.semi_join(rows, wanted, ["k", "n"], 90)) == expected
    assert as_set(joins.semi_join(rows, wanted, ["k", "n"])) == expected
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 500)
    for bound in (None, 90):
        found = joins.semi_join(rows, wanted, ["k", "n"], bound)
        assert "_bits" in plan_of(found) and as_set(found) == expected
        assert found.count() == rows.join(wanted.distinct(), ["k", "n"], "left_semi").count()


def test_bitmap_keeps_all_wanted_rows_and_few_others(spark):
    rows = spark.range(200_000).selectExpr("concat('u', id) as k", "id")
    wanted = rows.filter("id % 50 = 0").select("k")
    left = joins.maybe_in(rows, wanted, ["k"], 4000)
    assert left.filter("id % 50 = 0").count() == 4000
    assert left.filter("id % 50 <> 0").count() < 196_000 / 14
    size = joins.key_bitmap(wanted, ["k"], joins.bitmap_bits(4000)).agg(F.sum(F.octet_length("_bits"))).first()[0]
    assert size <= 4 * 4000 and joins.bitmap_bits(10**12) <= joins.BROADCAST_BYTES * 8


def test_rows_are_read_once_at_any_number_of_keys(spark, monkeypatch, tmp_path):
    rows, wanted, expected = keyed(spark)
    rows.write.parquet(f"{tmp_path}/rows")
    stored = spark.read.parquet(f"{tmp_path}/rows")
    for limit in (1 << 30, 2000, 100, 10):
        monkeypatch.setattr(joins, "BROADCAST_BYTES", limit)
        found = joins.semi_join(stored, wanted, ["k", "n"])
        assert plan_of(found).count("FileScan parquet") == 1 and as_set(found) == expected


def test_semi_join_without_keys_or_rows(spark, monkeypatch):
    rows, wanted, _ = keyed(spark)
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    assert joins.semi_join(rows, wanted.limit(0), ["k", "n"]).count() == 0
    assert joins.semi_join(rows.limit(0), wanted, ["k", "n"]).count() == 0


def test_spread_join_equals_a_join(spark):
    chance = random.Random(1)
    many = [(chance.choice([1, 1, 1, 2, 3, None]), n // 3) for n in range(400)]
    few = [(1, "a"), (1, "b"), (2, "c"), (4, "d"), (None, "e")]
    left = spark.createDataFrame(many, "k int, n int")
    right = spark.createDataFrame(few, "k int, t string")
    expected = Counter(as_list(left.join(right, "k")))
    for heavy in (1, 7, 100, 1000):
        assert Counter(as_list(joins.spread_join(left, right, ["k"], heavy))) == expected

    def chosen(only):
        return right if only is None else right.join(only, ["k"], "left_semi")

    assert Counter(as_list(joins.spread_join(left, chosen, ["k"], 7))) == expected


@pytest.mark.parametrize("kinds", [1, 7, 90_000])
def test_slices_of_a_third_of_all_rows_are_even(spark, kinds):
    """A third of all rows has one key: all equal, of few kinds, or all different."""
    rows = spark.range(270_000).selectExpr(
        "if(id % 3 = 0, -1, id) as k", f"if(id % 3 = 0, (id div 3) % {kinds}, 0) as n"
    )
    few = spark.range(2).selectExpr("-1L as k", "id as t")
    spark.conf.set("spark.sql.shuffle.partitions", "30")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = joins.spread_join(rows, few, ["k"], 3_000).withColumn("task", F.spark_partition_id())
        sizes = [r["count"] for r in joined.filter("k = -1").groupBy("task").count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 180_000
    # 30 slices fall into 30 partitions by hash, so a task may hold several; no slice is above its share.
    assert len(sizes) > 12 and max(sizes) <= 6 * 6_000


def test_portions_of_equal_rows_have_slices_of_their_own(spark):
    rows = spark.range(200_000).selectExpr("1 as k", "'same' as n")
    joined = joins.spread_join(rows, spark.sql("SELECT 1 AS k"), ["k"], 20_000)
    text = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "_copies" in text and joined.count() == 200_000


def chained(rows):
    """The literal chain: every copy in a step meets every copy in the next."""
    out = [(k, i, {"mo_last": r}) for k, s, i, r in rows if s == "mo_last"]
    for name in STEP_NAMES[:-1]:
        more = []
        for k, i, ranks in out:
            met = [r for k2, s, i2, r in rows if s == name and (k2, i2) == (k, i)] if k is not None else []
            more += [(k, i, {**ranks, name: r}) for r in met or [None]]
        out = more
    return Counter((k, i, *[ranks[n] for n in STEP_NAMES]) for k, i, ranks in out)


def copied_ranks(seed):
    chance = random.Random(seed)
    rows = []
    for name in STEP_NAMES:
        for _ in range(14):
            row = (chance.choice(["a", "b", None]), name, chance.randrange(3), chance.randrange(1, 4))
            rows += [row] * chance.choice([1, 1, 2])
    return [r for r in rows if chance.random() < 0.5]


@pytest.mark.parametrize("seed", range(4))
def test_weighted_chain_equals_the_literal_chain(spark, seed):
    rows = copied_ranks(seed)
    frame = spark.createDataFrame(rows, "request_uuid string, step string, listing_id bigint, rank bigint")
    columns = ["request_uuid", "listing_id", *STEP_NAMES]
    weighted = stage_ranks_weighted(frame, ["request_uuid"])
    held = {tuple(r)[:-1]: r.copies for r in weighted.select(*columns, "copies").collect()}
    assert held == dict(chained(rows)) and len(held) == weighted.count()
    assert Counter(as_list(stage_ranks_joined(frame, ["request_uuid"]), *columns)) == chained(rows)


def test_expansion_in_portions(spark):
    rows = spark.createDataFrame([("a", 3), ("b", (1 << 20) + 2)], "x string, copies bigint")
    assert dict(map(tuple, expand_copies(rows).groupBy("x").count().collect())) == {"a": 3, "b": (1 << 20) + 2}


def plain_running(rows, cap):
    """Positions over all log rows of a request, in the order of time."""
    ranks = Counter()
    out = set()
    for _, ids in sorted(rows):
        for one in ids:
            ranks["n"] += 1
            if ranks["n"] <= cap:
                out.add((one, ranks["n"]))
    return out


def test_many_lists_of_one_minute_are_cut_where_they_are_read(spark):
    """One request has all its log rows in one minute; only its first lists travel."""
    rows = [(n * 1000, [n * 3, n * 3 + 1] if n % 4 else []) for n in range(400)]
    random.Random(2).shuffle(rows)
    logs = flat_logs(spark, [log("hot", [entry("mo_last", ids)], MONDAY) for _, ids in rows])
    stamped = logs.withColumn(
        "query_time",
        F.expr("timestamp_micros(unix_micros(timestamp'2024-03-04 12:00:00') + 1000 * coalesce(get(get(candidateSources, 0).listingIds, 0), 0))"),
    )
    ranked = running_ranks(stamped.repartition(8), "request_uuid", ["request_uuid"], 50, by_time=True)
    assert "WindowGroupLimit" in plan_of(ranked)
    assert as_set(ranked, "listing_id", "rank") == plain_running([(i[0] if i else -1, i) for _, i in rows], 50)
