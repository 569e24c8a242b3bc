"""Parameters, sources and sinks."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from checks import relations as R
from checks.registry import check
from checks.sql import IN_DAYS, doubles
from checks.stores import new_store
from rankloom.operators.logs import optional_filters, request_fields
from rankloom.operators.popular import top_queries
from rankloom.params import ExperimentParams, RequestFilters, TopQueryParams
from rankloom.sources import (
    TableStore,
    on_date,
    on_dates,
    on_timestamp_dates,
    read_prefixed,
    since_date,
    since_timestamp_date,
)

FILTERS = RequestFilters(R.PLACEMENT, query_type=None, cache_bucket="live", organic_only=True)
QUICK = ExperimentParams.quicklook(R.DAY, R.FLAG, R.PLACEMENT)
MULTI = ExperimentParams(dates=R.DAYS, flag=R.FLAG, placement=R.PLACEMENT)
POPULAR = TopQueryParams(as_of=R.AS_OF, filters=FILTERS)
USER = 7


def day_text(column: str):
    return F.col(column).cast("string")


@check(f"""SELECT visit_id, ab_test, ab_variant FROM assigned
           WHERE _date = DATE '{R.DAY}' AND ab_test = '{R.FLAG}'""")
def param_scalar(spark, folder):
    rows = on_date(R.ab_tests(spark, folder), QUICK.dates[0], "_date")
    return rows.filter(F.col("ab_test") == QUICK.flag).select("visit_id", "ab_test", "ab_variant")


@check(f"""SELECT CAST(_date AS VARCHAR) AS day, platform, count(*) AS visits, 3 AS listed_days
           FROM seen WHERE _date IN {IN_DAYS} GROUP BY 1, 2""")
def param_array(spark, folder):
    rows = on_dates(R.visits(spark, folder), MULTI.dates, "_date")
    listed = F.size(F.array(*[F.lit(day) for day in MULTI.dates]))
    return rows.groupBy(day_text("_date").alias("day"), "platform").agg(
        F.count("*").alias("visits"), F.max(listed).alias("listed_days")
    )


def _filter_sql(label: str, test: str) -> str:
    return f"""SELECT '{label}' AS setting, request_uuid, CAST(log_date AS VARCHAR) AS log_date
               FROM logs WHERE {test}"""


_SETTINGS = {
    "all": (FILTERS, "true"),
    "matching": (replace(FILTERS, matching="FURNITURE"), "matching = 'FURNITURE'"),
    "models": (
        replace(FILTERS, ranking="furniture", market_optimization="low"),
        "ranking_model = 'furniture' AND market = 'low'",
    ),
    "signed out": (replace(FILTERS, user_id=-1), "NOT signed_in"),
    "one user": (replace(FILTERS, user_id=USER), f"req = {USER}"),
}


@check(" UNION ALL ".join(_filter_sql(label, test) for label, (_, test) in _SETTINGS.items()))
def param_optional_filter(spark, folder):
    logs = R.rpc_logs(spark, folder)
    tests = [
        F.when(optional_filters(filters), F.lit(label)) for label, (filters, _) in _SETTINGS.items()
    ]
    met = logs.withColumn("setting", F.explode(F.array_compact(F.array(*tests))))
    return met.select(
        "setting",
        F.col("RequestIdentifiers.requestUUID").alias("request_uuid"),
        F.to_date("queryTime").cast("string").alias("log_date"),
    )


@check(f"""SELECT CAST(_date AS VARCHAR) AS day, count(*) AS rows_of_day FROM sessions
           WHERE _date >= DATE '{R.AS_OF}' - 7 GROUP BY 1""")
def param_relative_date(spark, folder):
    rows = since_date(R.query_sessions(spark, folder), POPULAR.sessions_since, "_date")
    return rows.groupBy(day_text("_date").alias("day")).agg(F.count("*").alias("rows_of_day"))


@check("SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def scan_table(spark, folder):
    return R.table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"
    )


@check(doubles("""SELECT p_partkey, p_brand, NULL AS page_id, NULL AS url FROM part
                  UNION ALL SELECT NULL, NULL, page_id, url FROM pages""", ["p_partkey", "page_id"]))
def scan_wildcard(spark, folder):
    both = read_prefixed(spark, folder, "p").select("p_partkey", "p_brand", "page_id", "url")
    return R.doubles(both, ["p_partkey", "page_id"])


_BEACONS = "SELECT visit_id, event_type AS event_name, CAST(dt AS VARCHAR) AS day FROM sent"


def _beacons(rows):
    return rows.select(
        "visit_id", F.col("beacon.event_name").alias("event_name"), day_text("dt").alias("day")
    )


@check(f"{_BEACONS} WHERE dt IN {IN_DAYS}")
def scan_date_in(spark, folder):
    return _beacons(on_dates(R.visit_beacons(spark, folder), R.DAYS))


@check(f"{_BEACONS} WHERE dt = DATE '{R.DAY}'")
def scan_date_eq(spark, folder):
    return _beacons(on_date(R.visit_beacons(spark, folder), R.DAY))


@check(f"{_BEACONS} WHERE dt >= DATE '{R.DAY}'")
def scan_date_ge(spark, folder):
    return _beacons(since_date(R.visit_beacons(spark, folder), R.DAY))


@check(f"""SELECT 'listed' AS test, event_id FROM events WHERE CAST(ts AS DATE) IN {IN_DAYS}
           UNION ALL SELECT 'day', event_id FROM events WHERE CAST(ts AS DATE) = DATE '{R.DAY}'
           UNION ALL SELECT 'since', event_id FROM events WHERE CAST(ts AS DATE) >= DATE '{R.DAY}'""")
def scan_ts_date(spark, folder):
    events = R.table(spark, folder, "events")
    listed = on_timestamp_dates(events, R.DAYS, "ts")
    day = on_timestamp_dates(events, [R.DAY], "ts")
    since = since_timestamp_date(events, R.DAY, "ts")
    parts = {"listed": listed, "day": day, "since": since}
    chosen = [p.select(F.lit(name).alias("test"), "event_id") for name, p in parts.items()]
    return chosen[0].union(chosen[1]).union(chosen[2])


@check("""SELECT request_uuid, query, CAST(log_date AS VARCHAR) AS log_date, 10 AS entries
          FROM logs""")
def scan_nested_prune(spark, folder):
    stored = new_store(spark).replace("rpc_logs", R.rpc_logs(spark, folder))
    return request_fields(stored).select(
        "request_uuid",
        "query",
        F.to_date("query_time").cast("string").alias("log_date"),
        F.size("candidateSources").alias("entries"),
    )


@check("SELECT query, visits_that_used_query, pct_of_visits_covered, rank FROM popular")
def sink_replace_table(spark, folder):
    store = new_store(spark)
    sessions = R.query_sessions(spark, folder)
    store.replace("top_queries", top_queries(sessions, POPULAR.as_of, POPULAR.days - 3))
    store.replace("top_queries", top_queries(sessions, POPULAR.as_of, POPULAR.days))
    return TableStore(spark, store.root).table("top_queries")


@check("""SELECT platform, count(*) AS visits, count(DISTINCT _date) AS days FROM seen
          GROUP BY platform""")
def sink_temp_table(spark, folder):
    store = new_store(spark)
    store.replace("temp_visits", R.visits(spark, folder), partition_by="_date")
    return spark.sql(
        "SELECT platform, count(*) AS visits, count(DISTINCT _date) AS days"
        f" FROM {store.view('temp_visits')} GROUP BY platform"
    )
