"""Results that grow by date, estimated counts, stored order and tables chosen by name."""

from __future__ import annotations

from dataclasses import replace
from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import relations as R
from checks.analyses import EXPERIMENT, QUICKLOOK, sources
from checks.registry import check
from checks.relational import _SORTED, rank_rows, run_ranks
from checks.sql import SHARES, STEP_NAMES, doubles, first_page, pivot, report
from checks.stores import new_store
from rankloom.operators.distinct import (
    count_distinct,
    distinct_sketches,
    estimate_sketches,
    merge_sketches,
)
from rankloom.operators.popular import top_queries_bounded
from rankloom.operators.ranks import SORT_STEPS, stage_ranks_weighted
from rankloom.operators.sampling import experiment_sample, merge_samples
from rankloom.operators.visit_sets import number_visits, top_queries_of_sets, visit_sets
from rankloom.plans import experiment_quicklook, experiment_report_by_date, store_sorted_ranks
from rankloom.sources import on_dates, read_prefixed

SAMPLE = 50
# Distance of an estimate from the exact count that is taken as near.
NEAR = 0.02


def _near(exact: str, estimated: str):
    return (F.abs(F.col(estimated) - F.col(exact)) <= NEAR * F.col(exact)).alias("near")


@check("""SELECT query_raw AS query, count(DISTINCT visit_id) AS visits, true AS near
          FROM sessions GROUP BY 1""")
def count_distinct_approx(spark, folder):
    """Exact counts, and whether sketches that were stored by date and merged come near them."""
    sessions = R.query_sessions(spark, folder).withColumnRenamed("query_raw", "query")
    by_date = distinct_sketches(sessions, ["query", "_date"], "visit_id")
    stored = new_store(spark).replace("visit_sketches", by_date)
    found = estimate_sketches(merge_sketches(stored, ["query"]), "estimated")
    exact = count_distinct(sessions, ["query"], "visit_id", "visits")
    return exact.join(found, "query").select("query", "visits", _near("visits", "estimated"))


@check(f"""SELECT * FROM all_sample
           ORDER BY md5('0|' || request_uuid || '|' || ab_flag || '|' || ab_flag_variant)
           LIMIT {SAMPLE}""")
def experiment_sample_by_dates(spark, folder):
    """The sample of all dates from stored samples of each date."""
    store = new_store(spark)
    states = []
    for day in R.DAYS:
        one = experiment_sample(R.beacons(spark, folder), R.FLAG, [day], SAMPLE, event_name=R.EVENT)
        states.append(store.replace(f"sample_{day:%Y%m%d}", one))
    return merge_samples(states, SAMPLE, "0", ["request_uuid", "ab_flag", "ab_flag_variant"])


@check(report(SHARES, source="date_base"))
def experiment_report_by_dates(spark, folder):
    """A report over all dates that reads only the last date's logs, after one over the others.

    The logs are derived once and stored, as the dates are read one by one.
    """
    params = replace(EXPERIMENT, match_date=True, sample_size=None)
    store = new_store(spark)
    found = sources(spark, folder)
    found = replace(found, rpc_logs=store.replace("rpc_logs", found.rpc_logs))
    experiment_report_by_date(found, replace(params, dates=R.DAYS[:-1]), store)
    last = on_dates(found.rpc_logs.withColumn("dt", F.to_date("queryTime")), R.DAYS[-1:], "dt")
    return experiment_report_by_date(replace(found, rpc_logs=last.drop("dt")), params, store)


_MIXED = pivot(
    """(SELECT request_uuid, query, step, lid,
               row_number() OVER (PARTITION BY query, step, CASE WHEN step = 'solr' THEN request_uuid END
                 ORDER BY md5(request_uuid || '|' || log_date || '|' || query), query_time, rnk)
                 AS rnk
        FROM (SELECT DISTINCT request_uuid, query FROM day_searches) AS s
        JOIN (SELECT request_uuid, query_time, log_date, step, lid, rnk FROM day_runs) AS d
          USING (request_uuid)) AS n""",
    "request_uuid, query",
)


@check(first_page(f"day_searches AS s JOIN ({_MIXED}) AS w USING (request_uuid, query)"))
def experiment_quicklook_mixed_ranks(spark, folder):
    """Ranks of the first step within the request, of the others within the query."""
    params = replace(QUICKLOOK, rank_scope="mixed")
    return experiment_quicklook(sources(spark, folder), params, new_store(spark))[0]


_WEIGHTED = " ".join(
    f"LEFT JOIN (SELECT request_uuid, lid, rnk, count(*) AS n FROM log_runs"
    f" WHERE step = '{name}' AND rnk <= {R.CAP} GROUP BY 1, 2, 3) AS {name}"
    f" ON {name}.request_uuid = m.request_uuid AND {name}.lid = m.lid"
    for name in STEP_NAMES[:-1]
)


@check(doubles(f"""
    SELECT m.request_uuid, m.lid AS listing_id,
           {", ".join(f"{name}.rnk AS {name}" for name in STEP_NAMES[:-1])}, m.rnk AS mo_last,
           CAST(count(*) AS BIGINT) AS copies
    FROM (SELECT * FROM log_runs WHERE step = 'mo_last' AND rnk <= {R.CAP}) AS m {_WEIGHTED}
    GROUP BY ALL"""))
def left_chain_weighted(spark, folder):
    """The chain of left joins as distinct rows and how often each stands there."""
    ranked = new_store(spark).replace("ranked", run_ranks(spark, folder), "step")
    return R.doubles(stage_ranks_weighted(ranked, ["request_uuid"]))


_WIDE = pivot("log_runs", "request_uuid, query")
_BY_STEPS = ", ".join(f"{name} NULLS LAST" for name in (*SORT_STEPS, "request_uuid", "listing_id"))


@check(
    f"{doubles(_WIDE)} ORDER BY query NULLS FIRST, {_BY_STEPS}",
    ordered=[*_SORTED, "request_uuid", "listing_id"],
)
def sorted_rank_table(spark, folder):
    """The rank table stored in its order and read back in it, without another look at the ranks."""
    return store_sorted_ranks(R.doubles(rank_rows(spark, folder)), new_store(spark))


@check(f"""SELECT visit_id, event_type AS event_name, CAST(dt AS VARCHAR) AS day FROM sent
           WHERE dt BETWEEN DATE '{R.DAY}' AND DATE '{R.DAY}' + 7 AND dt IN
             {"(" + ", ".join(f"DATE '{day}'" for day in R.DAYS) + ")"}""")
def scan_wildcard_dates(spark, folder):
    """Tables of one day each, chosen by the dates in their names."""
    store = new_store(spark)
    beacons = R.visit_beacons(spark, folder)
    for day in R.DAYS:
        on_dates(beacons, [day]).write.parquet(f"{store.root}/beacons_{day:%Y%m%d}.parquet")
    found = read_prefixed(
        spark, store.root, "beacons_", since=R.DAY, until=R.DAY + timedelta(days=7)
    )
    return found.select(
        "visit_id",
        F.col("beacon.event_name").alias("event_name"),
        F.col("dt").cast("string").alias("day"),
    )


@check("""SELECT query, visits_that_used_query, pct_of_visits_covered, rank FROM popular
          WHERE rank <= 10""", name="top_queries_bounded")
def top_bounded(spark, folder):
    """The most used queries with the visits of those only that can be among them."""
    return top_queries_bounded(R.query_sessions(spark, folder), R.AS_OF, 10)


STARTS = [R.AS_OF - timedelta(days=n) for n in range(0, 21, 3)]


@check(f"""SELECT CAST(as_of AS VARCHAR) AS as_of, query, visits_that_used_query,
                  visits_that_used_query / visits AS pct_of_visits_covered,
                  rank() OVER (PARTITION BY as_of ORDER BY visits_that_used_query DESC) AS rank
           FROM (SELECT as_of, query_raw AS query, count(DISTINCT visit_id) AS visits_that_used_query
                 FROM sessions, (VALUES {", ".join(f"(DATE '{day}')" for day in STARTS)}) AS d(as_of)
                 WHERE _date >= as_of - 7 GROUP BY 1, 2) AS u
           JOIN (SELECT as_of, count(DISTINCT visit_id) AS visits
                 FROM sessions, (VALUES {", ".join(f"(DATE '{day}')" for day in STARTS)}) AS d(as_of)
                 WHERE _date >= as_of - 7 GROUP BY 1) AS w USING (as_of)""")
def top_queries_rolling(spark, folder):
    """Popular queries as of several days, from exact sets of visits stored for each day."""
    store = new_store(spark)
    sessions = R.query_sessions(spark, folder).withColumnRenamed("query_raw", "query")
    half = R.AS_OF - timedelta(days=10)
    first = store.replace("numbers", number_visits(sessions.filter(F.col("_date") < half)))
    later = store.replace("later", number_visits(sessions.filter(F.col("_date") >= half), first))
    numbers = first.unionByName(later)
    sets = store.replace("visit_sets", visit_sets(sessions, numbers, ["query", "_date"]), "_date")
    found = [
        top_queries_of_sets(sets, day).select(F.lit(str(day)).alias("as_of"), "*") for day in STARTS
    ]
    return reduce(DataFrame.unionByName, found)
