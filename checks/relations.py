"""The source tables of the analyses, derived from the given tables.

A customer plays a request, its line items the candidate listings, an event a beacon. Listing ids
are part keys folded to 20 values so that the steps overlap; hence no list is longer than 20.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.operators.ranks import STEP_NAMES, STEPS
from rankloom.sources import read_table

FLAG = "exp.blend"
OTHER_FLAG = "exp.page"
PLACEMENT = "web"
EVENT = "view"
DAYS = (date(2024, 1, 5), date(2024, 1, 12), date(2024, 1, 19))
DAY = date(2024, 1, 12)
AS_OF = date(2024, 1, 30)
CAP = 5
PAGE_SIZES = {"desktop": 3, "mobile_web": 2, "boe": 1}
FIRST_PAGE = 3
LISTINGS = 20


def doubles(rows: DataFrame, columns=STEP_NAMES) -> DataFrame:
    """Whole numbers that may be missing as doubles, which every client reads alike."""
    return rows.withColumns({name: F.col(name).cast("double") for name in columns})


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, f"{folder}/{name}.parquet")


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Request, listing, step number and the price that orders the listings of a step."""
    # Only what is needed travels to the join, which holds a share of the orders and sorts no items.
    items = table(spark, folder, "lineitem").select(
        "l_orderkey",
        (F.col("l_partkey") % LISTINGS).alias("lid"),
        ((F.col("l_linenumber") + F.col("l_suppkey")) % len(STEPS)).alias("slot"),
        "l_extendedprice",
    )
    orders = table(spark, folder, "orders").hint("shuffle_hash")
    return (
        items.join(orders, items.l_orderkey == orders.o_orderkey)
        .groupBy(F.col("o_custkey").alias("req"), "lid", "slot")
        .agg(F.min("l_extendedprice").alias("p"))
    )


def view_days(spark: SparkSession, folder: str) -> DataFrame:
    """First view and its text for each user and day, and whether the day is the user's first."""
    views = table(spark, folder, "events").filter(F.col("event_type") == EVENT)
    days = views.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.min("ts").alias("first_ts"),
        F.min_by("props", F.struct("ts", "event_id")).alias("first_text"),
    )
    # A user has one row for each day of the table here.
    first = F.min("day").over(Window.partitionBy("user_id"))
    return days.withColumn("is_first", F.col("day") == first)


def rpc_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Nested ranking logs: a row for each customer and day it viewed something.

    A customer without views has one row, dated by its last order. Rows after the first day list
    their candidates in reverse. One entry is interleaved and one belongs to no step.
    """
    # At most 20 listings at each of 8 steps.
    lists = (
        candidates(spark, folder)
        .groupBy("req")
        .agg(F.collect_list(F.struct("slot", (-F.col("p")).alias("k"), "lid")).alias("items"))
        .withColumn("items", F.sort_array("items"))
    )
    last_order = (
        table(spark, folder, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("odate"))
    )
    rows = (
        table(spark, folder, "customer")
        .join(lists, F.col("c_custkey") == F.col("req"))
        .join(last_order, F.col("c_custkey") == F.col("o_custkey"))
        .join(view_days(spark, folder), F.col("c_custkey") == F.col("user_id"), "left")
    )
    first = F.coalesce("is_first", F.lit(True))

    def entry(stage: str, source: str | None, mixed: str | None, slot: int):
        ids = F.filter("items", lambda item: item["slot"] == slot)["lid"]
        listed = F.when(first, ids).otherwise(F.reverse(ids))
        return F.struct(
            F.lit(stage).alias("stage"),
            F.lit(source).cast("string").alias("source"),
            F.lit(mixed).cast("string").alias("interleavedBehavior"),
            listed.alias("listingIds"),
        )

    entries = [entry(step.stage, step.source, None, i) for i, step in enumerate(STEPS)]
    entries.insert(1, entry("POST_FILTER", "SOLR", "mixed", 3))
    entries.append(entry("POST_FILTER", None, None, 0))
    segment = F.col("c_mktsegment")
    options = F.struct(
        F.when(F.col("c_nationkey") < 20, PLACEMENT).otherwise("app").alias("searchPlacement"),
        F.when(F.col("c_nationkey") == 4, "broad").otherwise("main").alias("queryType"),
        F.when(F.col("c_nationkey") == 5, "test").otherwise("live").alias("cacheBucketId"),
        F.when(F.col("c_nationkey") != 6, F.col("c_nationkey") != 7).alias("organicOnly"),
        (F.col("c_acctbal") >= 2000).alias("signedInUser"),
        F.struct(
            F.when(segment != "BUILDING", segment).alias("matching"),
            F.lower(segment).alias("ranking"),
            F.when(F.col("c_nationkey") < 10, "low").otherwise("high").alias("marketOptimization"),
        ).alias("behavior"),
        F.struct(F.col("c_custkey").alias("userId")).alias("personalizationOptions"),
    )
    return rows.select(
        F.coalesce("first_ts", "odate").alias("queryTime"),
        F.struct(
            F.coalesce("first_text", segment).alias("query"),
            F.when(segment == "MACHINERY", "price").otherwise("relevance").alias("sortBy"),
            F.when(F.col("c_nationkey") == 3, "asc").otherwise("desc").alias("sortOrder"),
            F.when(F.col("c_acctbal") < 0, 48).otherwise(0).cast("bigint").alias("offset"),
            options.alias("options"),
        ).alias("request"),
        F.struct(F.array(*entries).alias("candidateSources")).alias("OrganicRequestMetadata"),
        F.struct(request_id("c_custkey").alias("requestUUID")).alias("RequestIdentifiers"),
    )


def request_id(column: str):
    return F.concat(F.lit("u"), F.col(column).cast("string"))


def variant(column: str):
    user = F.col(column)
    return (
        F.when(user % 10 == 9, "ineligible")
        .when(user % 10 == 8, F.lit(None).cast("string"))
        .when(user % 2 == 0, "off")
        .otherwise("on")
    )


def _pair(key: str, value):
    return F.struct(F.lit(key).alias("key"), value.alias("value"))


def beacons(spark: SparkSession, folder: str) -> DataFrame:
    """Raw beacons with flag and property arrays."""
    events = table(spark, folder, "events")

    def flagged(flag: str, value):
        return _pair(flag, F.struct(F.array(value).alias("value_tuple")))

    flags = F.array(
        flagged(OTHER_FLAG, F.col("event_type")), flagged(FLAG, variant("user_id"))
    )
    properties = F.array(
        _pair("query", F.col("props")),
        _pair("request_uuid", request_id("user_id")),
        _pair("page", F.col("event_type")),
    )
    return events.select(
        F.to_date("ts").alias("dt"),
        F.col("event_type").alias("event_name"),
        F.struct(flags.alias("map")).alias("ab"),
        F.struct(properties.alias("map")).alias("properties"),
    )


def visit_beacons(spark: SparkSession, folder: str) -> DataFrame:
    """Beacons tied to visits, a fifth of them sent twice; those of a small value lack the query."""
    events = table(spark, folder, "events")
    copies = F.when(F.col("event_id") % 5 == 0, 2).otherwise(1)
    events = events.withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    always = [
        _pair("inner_request_uuid", F.concat(F.lit("m"), F.col("user_id").cast("string"))),
        _pair("request_uuid", request_id("user_id")),
        _pair("ranking_variant", variant("user_id")),
    ]
    asked = F.array(*always, _pair("query", F.col("props")))
    pairs = F.when(F.col("value") >= 2, asked).otherwise(F.array(*always))
    return events.select(
        F.to_date("ts").alias("dt"),
        F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("visit_id"),
        F.struct(
            F.col("event_type").alias("event_name"),
            F.col("ts").alias("timestamp"),
            F.struct(pairs.alias("key_value")).alias("properties"),
        ).alias("beacon"),
    )


def ab_tests(spark: SparkSession, folder: str) -> DataFrame:
    """Variant of each visit, under two flags."""
    events = table(spark, folder, "events")
    rows = events.select(
        F.to_date("ts").alias("_date"),
        F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("visit_id"),
        F.explode(F.array(F.lit(FLAG), F.lit(OTHER_FLAG))).alias("ab_test"),
        "event_type",
        "user_id",
    )
    chosen = F.when(F.col("ab_test") == FLAG, variant("user_id")).otherwise(F.col("event_type"))
    return rows.select("_date", "visit_id", "ab_test", chosen.alias("ab_variant"))


def visits(spark: SparkSession, folder: str) -> DataFrame:
    """Platform of each visit; a quarter use one without result pages."""
    events = table(spark, folder, "events")
    names = F.array(*[F.lit(name) for name in ("desktop", "mobile_web", "boe", "tv")])
    return events.select(
        F.to_date("ts").alias("_date"),
        F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("visit_id"),
        F.get(names, (F.col("event_id") % 4).cast("int")).alias("platform"),
    )


def query_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Query texts by visit and day; a user plays a visit."""
    return table(spark, folder, "events").select(
        F.to_date("ts").alias("_date"),
        F.col("user_id").alias("visit_id"),
        F.col("props").alias("query_raw"),
    )
