"""Projections, scalar expressions and filters."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from checks import relations as R
from checks.registry import check
from checks.scans import MULTI, day_text
from checks.sql import IN_DAYS, STEP_NAMES
from rankloom.functions import kv_lookup, nth, page_flag, pairs_with_key, ratio
from rankloom.operators.logs import popular_requests, requests_of_kind
from rankloom.operators.ranks import candidate_entries, organic_entries, step_name
from rankloom.operators.sampling import INELIGIBLE, flagged_requests
from rankloom.params import RequestFilters
from rankloom.sources import on_dates, since_timestamp_date


def log_id():
    return F.col("RequestIdentifiers.requestUUID").alias("request_uuid")


def log_day():
    return F.to_date("queryTime").cast("string").alias("log_date")


def flat_logs(spark, folder):
    """The log fields that ranks are built from, for every log row."""
    return R.rpc_logs(spark, folder).select(
        log_id(),
        F.col("request.query").alias("query"),
        F.col("queryTime").alias("query_time"),
        F.col("OrganicRequestMetadata.candidateSources").alias("candidateSources"),
    )


@check("SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_totalprice AS price FROM orders")
def proj_columns(spark, folder):
    orders = R.table(spark, folder, "orders")
    return orders.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_totalprice").alias("price"),
    )


@check("SELECT CAST(seen._date AS VARCHAR) AS day, visit_id, platform, 1 AS n FROM seen")
def proj_star(spark, folder):
    visits = R.visits(spark, folder).withColumnRenamed("_date", "day").alias("t")
    return visits.select("t.*", F.lit(1).alias("n")).withColumn("day", day_text("day"))


@check("""SELECT request_uuid, sort_by, placement, matching, req AS user_id FROM logs""")
def proj_struct_path(spark, folder):
    return R.rpc_logs(spark, folder).select(
        log_id(),
        F.col("request.sortBy").alias("sort_by"),
        F.col("request.options.searchPlacement").alias("placement"),
        F.col("request.options.behavior.matching").alias("matching"),
        F.col("request.options.personalizationOptions.userId").alias("user_id"),
    )


@check("""SELECT request_uuid, variant AS first_value, CAST(NULL AS VARCHAR) AS second_value
          FROM beacon""")
def array_subscript(spark, folder):
    beacons = R.beacons(spark, folder)
    flag = F.get(pairs_with_key("ab.map", R.FLAG), F.lit(0))
    values = flag["value"]["value_tuple"]
    return beacons.select(
        kv_lookup("properties.map", "request_uuid").alias("request_uuid"),
        nth(values, 0, strict=True).alias("first_value"),
        nth(values, 1).alias("second_value"),
    )


@check("SELECT visit_id, request_uuid, asked AS query, variant AS ranking_variant FROM sent")
def kv_lookup_(spark, folder):
    pairs = "beacon.properties.key_value"
    return R.visit_beacons(spark, folder).select(
        "visit_id",
        kv_lookup(pairs, "request_uuid").alias("request_uuid"),
        kv_lookup(pairs, "query", strict=True).alias("query"),
        kv_lookup(pairs, "ranking_variant").alias("ranking_variant"),
    )


@check("SELECT 'First Page' AS metric, platform, count(*) AS visits FROM seen GROUP BY 2")
def proj_literal(spark, folder):
    counts = R.visits(spark, folder).groupBy("platform").agg(F.count("*").alias("visits"))
    return counts.select(F.lit("First Page").alias("metric"), "platform", "visits")


# A line item's quantity, 1 to 50, stands for a rank; its supplier chooses the platform.
_PLATFORM = """CASE l_suppkey % 4 WHEN 0 THEN 'desktop' WHEN 1 THEN 'mobile_web'
               WHEN 2 THEN 'boe' END"""
_RANK = "CAST(l_quantity * l_linenumber AS BIGINT)"


@check(f"""SELECT platform, rnk, CASE WHEN rnk <= size THEN 1 ELSE 0 END AS page_1_flag,
                  CASE WHEN rnk <= 3 * size THEN 1 ELSE 0 END AS top_3_flag, count(*) AS n
           FROM (SELECT {_PLATFORM} AS platform, {_RANK} AS rnk FROM lineitem) AS l
           LEFT JOIN (VALUES ('desktop', 48), ('mobile_web', 34), ('boe', 28)) AS p(platform, size)
             USING (platform)
           GROUP BY ALL""")
def case_page_flag(spark, folder):
    items = R.table(spark, folder, "lineitem")
    names = F.array(*[F.lit(name) for name in ("desktop", "mobile_web", "boe")])
    rows = items.select(
        F.get(names, (F.col("l_suppkey") % 4).cast("int")).alias("platform"),
        (F.col("l_quantity") * F.col("l_linenumber")).cast("bigint").alias("rnk"),
    )
    flagged = rows.withColumn("page_1_flag", page_flag("rnk", "platform", MULTI.page_sizes))
    flagged = flagged.withColumn(
        "top_3_flag", page_flag("rnk", "platform", MULTI.page_sizes, MULTI.pages)
    )
    keys = ["platform", "rnk", "page_1_flag", "top_3_flag"]
    return flagged.groupBy(*keys).agg(F.count("*").alias("n"))


@check("SELECT l_linenumber, l_linenumber * (48 * 3) AS scaled, count(*) AS n FROM lineitem GROUP BY 1, 2")
def arith_mul(spark, folder):
    items = R.table(spark, folder, "lineitem")
    scaled = F.col("l_linenumber") * (F.lit(48) * F.lit(3))
    return items.groupBy("l_linenumber", scaled.alias("scaled")).agg(F.count("*").alias("n"))


@check("""SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)
                 / nullif(sum(CASE WHEN l_linenumber > 6 THEN 1 ELSE 0 END), 0) AS share
          FROM lineitem GROUP BY 1""")
def arith_ratio(spark, folder):
    parts = F.count_if(F.col("l_returnflag") == "R")
    whole = F.count_if(F.col("l_linenumber") > 6)
    items = R.table(spark, folder, "lineitem")
    return items.groupBy("l_suppkey").agg(ratio(parts, whole).alias("share"))


@check("""SELECT o_orderkey, CAST(DATE '1997-06-01' AS VARCHAR) AS since FROM orders
          WHERE CAST(o_orderdate AS DATE) >= DATE '1997-06-01'""")
def date_literal(spark, folder):
    orders = since_timestamp_date(R.table(spark, folder, "orders"), date(1997, 6, 1), "o_orderdate")
    return orders.select("o_orderkey", F.lit(date(1997, 6, 1)).cast("string").alias("since"))


@check("SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events")
def date_of_timestamp(spark, folder):
    events = R.table(spark, folder, "events")
    return events.select("event_id", F.to_date("ts").cast("string").alias("day"))


@check("""SELECT event_id, CAST(CAST(ts AS DATE) - 1 AS VARCHAR) AS day_before,
                 CAST(CAST(ts AS DATE) - 7 AS VARCHAR) AS week_before FROM events""")
def date_minus_days(spark, folder):
    day = F.to_date("ts")
    return R.table(spark, folder, "events").select(
        "event_id",
        F.date_sub(day, 1).cast("string").alias("day_before"),
        F.date_sub(day, 7).cast("string").alias("week_before"),
    )


@check(f"""SELECT event_id, CAST(ts AS DATE) IN {IN_DAYS} AS listed, 4 AS sources FROM events""")
def array_literal(spark, folder):
    days = F.array(*[F.lit(day) for day in R.DAYS])
    sources = F.array(*[F.lit(name) for name in STEP_NAMES[:4]])
    return R.table(spark, folder, "events").select(
        "event_id",
        F.array_contains(days, F.to_date("ts")).alias("listed"),
        F.size(sources).alias("sources"),
    )


@check(f"SELECT visit_id, ab_variant FROM assigned WHERE ab_test = '{R.FLAG}'")
def filter_eq(spark, folder):
    rows = R.ab_tests(spark, folder).filter(F.col("ab_test") == R.FLAG)
    return rows.select("visit_id", "ab_variant")


@check(f"""SELECT request_uuid, '{R.FLAG}' AS ab_flag, variant AS ab_flag_variant FROM beacon
           WHERE variant <> 'ineligible'""")
def filter_neq(spark, folder):
    rows = flagged_requests(R.beacons(spark, folder), R.FLAG)
    return rows.filter(F.col("ab_flag_variant") != INELIGIBLE)


@check("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 34")
def filter_range(spark, folder):
    items = R.table(spark, folder, "lineitem")
    kept = items.filter((F.col("l_quantity") >= 10) & (F.col("l_quantity") <= 34))
    return kept.select("l_orderkey", "l_linenumber", "l_quantity")


@check(f"SELECT visit_id, platform FROM seen WHERE _date IN {IN_DAYS}")
def filter_in_array(spark, folder):
    return on_dates(R.visits(spark, folder), R.DAYS, "_date").select("visit_id", "platform")


@check("""SELECT visit_id, 'missing' AS query_state FROM sent WHERE asked IS NULL
          UNION ALL SELECT visit_id, 'present' FROM sent WHERE asked IS NOT NULL""")
def filter_null(spark, folder):
    rows = R.visit_beacons(spark, folder)
    query = kv_lookup("beacon.properties.key_value", "query")
    missing = rows.filter(query.isNull()).select("visit_id", F.lit("missing").alias("query_state"))
    present = rows.filter(query.isNotNull()).select("visit_id", F.lit("present"))
    return missing.union(present)


@check("""SELECT request_uuid, CAST(log_date AS VARCHAR) AS log_date FROM logs
          WHERE organic = true AND signed_in = false""")
def filter_bool(spark, folder):
    options = "request.options"
    organic = F.col(f"{options}.organicOnly") == F.lit(True)
    signed_out = F.col(f"{options}.signedInUser") == F.lit(False)
    return R.rpc_logs(spark, folder).filter(organic & signed_out).select(log_id(), log_day())


@check("""SELECT request_uuid, CAST(log_date AS VARCHAR) AS log_date, matching, market FROM logs
          WHERE sort_by = 'relevance' AND (matching = 'FURNITURE' OR market = 'low')
            AND (signed_in OR first_item = 0)""")
def filter_and_or(spark, folder):
    behavior = "request.options.behavior"
    models = (F.col(f"{behavior}.matching") == "FURNITURE") | (
        F.col(f"{behavior}.marketOptimization") == "low"
    )
    users = F.col("request.options.signedInUser") | (F.col("request.offset") == 0)
    kept = R.rpc_logs(spark, folder).filter(
        (F.col("request.sortBy") == "relevance") & models & users
    )
    return kept.select(
        log_id(),
        log_day(),
        F.col(f"{behavior}.matching").alias("matching"),
        F.col(f"{behavior}.marketOptimization").alias("market"),
    )


@check("""SELECT request_uuid, CAST(log_date AS VARCHAR) AS log_date, step,
                 count(lid) AS listings
          FROM logs JOIN steps ON true
          LEFT JOIN ranked ON ranked.req = logs.req AND ranked.slot = steps.slot GROUP BY 1, 2, 3""")
def filter_stage_source(spark, folder):
    entries = candidate_entries(flat_logs(spark, folder), ["request_uuid", "query_time"])
    named = entries.withColumn("step", step_name(F.col("stage"), F.col("source")))
    return named.filter(F.col("step").isNotNull()).select(
        "request_uuid",
        F.to_date("query_time").cast("string").alias("log_date"),
        "step",
        F.size("listingIds").cast("bigint").alias("listings"),
    )


@check("""SELECT request_uuid, CAST(log_date AS VARCHAR) AS log_date, 10 AS entries, 9 AS organic
          FROM logs""")
def filter_interleaved(spark, folder):
    return flat_logs(spark, folder).select(
        "request_uuid",
        F.to_date("query_time").cast("string").alias("log_date"),
        F.size("candidateSources").alias("entries"),
        F.size(organic_entries("candidateSources")).alias("organic"),
    )


@check(f"""SELECT 'experiment' AS kind, request_uuid, CAST(log_date AS VARCHAR) AS log_date
           FROM logs
           WHERE placement = '{R.PLACEMENT}' AND sort_by = 'relevance' AND sort_order = 'desc'
           UNION ALL
           SELECT 'popular', request_uuid, CAST(log_date AS VARCHAR) FROM logs
           WHERE placement = '{R.PLACEMENT}' AND sort_by = 'relevance' AND sort_order = 'desc'
             AND first_item = 0 AND query_type = 'main' AND bucket = 'live' AND organic""")
def filter_request_kind(spark, folder):
    logs = R.rpc_logs(spark, folder)
    popular = popular_requests(logs, RequestFilters(
        R.PLACEMENT, query_type="main", cache_bucket="live", organic_only=True
    ))
    experiment = requests_of_kind(logs, R.PLACEMENT)
    parts = {"experiment": experiment, "popular": popular}
    chosen = [
        rows.select(F.lit(kind).alias("kind"), log_id(), log_day()) for kind, rows in parts.items()
    ]
    return chosen[0].union(chosen[1])
