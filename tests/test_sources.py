from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from checks.stores import shared_root
from rankloom.sources import (
    TableStore,
    on_dates,
    on_timestamp_dates,
    read_prefixed,
    read_table,
    since_timestamp_date,
)

DAYS = [date(2024, 3, 4), date(2024, 3, 6)]


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_read_prefixed_unites_tables_with_other_columns(spark, tmp_path):
    spark.range(2).select(F.col("id").alias("a")).write.parquet(f"{tmp_path}/logs_1")
    spark.range(1).select(F.lit("x").alias("b")).write.parquet(f"{tmp_path}/logs_2")
    spark.range(9).write.parquet(f"{tmp_path}/other")
    both = read_prefixed(spark, str(tmp_path), "logs_")
    assert sorted(both.columns) == ["a", "b"]
    assert both.count() == 3
    assert read_prefixed(spark, str(tmp_path), "logs_", "a bigint").columns == ["a"]


def test_read_table_by_path_or_name(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/t")
    assert read_table(spark, f"{tmp_path}/t").count() == 3
    spark.range(4).createOrReplaceTempView("four")
    assert read_table(spark, "four").count() == 4


def test_date_list_prunes_partitions(spark, tmp_path):
    days = spark.range(5).select(
        F.expr("date_add(DATE'2024-03-04', cast(id as int))").alias("dt"), "id"
    )
    days.write.partitionBy("dt").parquet(f"{tmp_path}/t")
    kept = on_dates(spark.read.parquet(f"{tmp_path}/t"), DAYS)
    assert "PartitionFilters: [dt" in plan(kept)
    assert len(kept.inputFiles()) <= 5 and {row.dt for row in kept.collect()} == set(DAYS)


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_date_list_on_a_timestamp_reaches_the_scan(spark, tmp_path, kind):
    stamps = [datetime(2024, 3, day, hour) for day in range(3, 8) for hour in (0, 23)]
    rows = spark.createDataFrame([(stamp,) for stamp in stamps], "ts timestamp")
    path = f"{tmp_path}/t"
    rows.select(F.struct(F.col("ts").cast(kind).alias("ts")).alias("log")).write.parquet(path)
    kept = on_timestamp_dates(spark.read.parquet(path), DAYS, "log.ts")
    assert "GreaterThanOrEqual(log.ts" in plan(kept) and "LessThan(log.ts" in plan(kept)
    assert kept.count() == 4
    assert since_timestamp_date(spark.read.parquet(path), DAYS[1], "log.ts").count() == 4
    assert on_timestamp_dates(spark.read.parquet(path), [], "log.ts").count() == 0


def test_store_replaces_a_table_with_a_query_over_itself(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    first = store.replace("numbers", spark.range(3).toDF("n"))
    second = store.replace("numbers", first.select((F.col("n") + 1).alias("n")))
    assert [row.n for row in second.orderBy("n").collect()] == [1, 2, 3]
    assert store.table("numbers").count() == 3 and first.count() == 3


def test_store_partitions_and_keeps_column_order(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    rows = spark.range(6).selectExpr("DATE'2024-03-04' as _date", "id", "id % 2 as k")
    stored = store.replace("t", rows, "_date")
    assert stored.columns == ["_date", "id", "k"]
    assert dict(stored.dtypes)["_date"] == "date" and stored.count() == 6


def test_two_stores_do_not_mix(spark, tmp_path):
    one, two = TableStore(spark, f"{tmp_path}/one"), TableStore(spark, f"{tmp_path}/two")
    one.replace("searches", spark.range(3))
    two.replace("searches", spark.range(7))
    assert (one.table("searches").count(), two.table("searches").count()) == (3, 7)
    views = one.view("searches"), two.view("searches")
    assert [spark.table(view).count() for view in views] == [3, 7]


def test_tables_outlive_the_session(spark, tmp_path):
    TableStore(spark, str(tmp_path)).replace(
        "t", spark.range(4).selectExpr("string(id) as part", "id"), "part"
    )
    later = TableStore(spark.newSession(), str(tmp_path)).table("t")
    assert later.dtypes == [("part", "string"), ("id", "bigint")] and later.count() == 4


def test_old_versions_go_and_unfinished_ones_do_not_count(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    for n in range(4):
        store.replace("t", spark.range(n))
    assert sorted(p.name for p in (tmp_path / "t").glob("v*")) == [
        "v3",
        "v3.schema",
        "v4",
        "v4.schema",
    ]
    spark.range(9).write.parquet(f"{tmp_path}/t/v5")
    assert store.table("t").count() == 3
    store.replace("t", spark.range(5))
    assert store.table("t").count() == 5
    with pytest.raises(ValueError, match="no table"):
        store.table("u")
    with pytest.raises(ValueError, match="letters"):
        store.replace("a/b", spark.range(1))


def test_prefix_of_a_database(spark):
    for n in (1, 2):
        spark.range(n).createOrReplaceTempView(f"logs_{n}")
    assert read_prefixed(spark, "default", "logs_").count() == 3
    with pytest.raises(ValueError, match="no table"):
        read_prefixed(spark, "default", "nothing_")


class Session:
    """What ``shared_root`` asks of a session."""

    def __init__(self, master, shared=None):
        self.sparkContext = type("Context", (), {"master": master})
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default: shared)})


def test_scratch_folder_follows_the_session():
    assert shared_root(Session("yarn", "/shared/")).startswith("/shared/rankloom-")
    assert shared_root(Session("local[2]", "/shared")).startswith("/shared/rankloom-")
    assert "/rankloom-" in shared_root(Session("local[2]"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_root(Session("local-cluster[2,1,1024]"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_root(Session("yarn"))
