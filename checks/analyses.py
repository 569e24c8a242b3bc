"""The composite operators and whole analyses."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from checks import relations as R
from checks.expressions import flat_logs
from checks.registry import check
from checks.relational import rank_rows, searches
from checks.scans import day_text
from checks.sql import CAP, FIRST_PAGE, IN_DAYS, SHARES, STEP_NAMES, doubles, first_page, pivot, report, running
from checks.stores import new_store
from rankloom.operators.logs import logged_more_than_once, request_logs, request_logs_by_query
from rankloom.operators.metrics import (
    first_page_by_query,
    first_page_overall,
    page_flags,
    retrieval_report,
    retrieval_report_15,
)
from rankloom.operators.popular import most_used, top_queries
from rankloom.operators.ranks import (
    STEPS,
    ranked_candidates,
    stage_ranks_joined,
    stage_ranks_pivot,
    step_ids,
)
from rankloom.operators.sampling import experiment_sample
from rankloom.operators.searches import request_to_visit, sample_searches
from rankloom.params import ExperimentParams, RequestFilters, TopQueryParams
from rankloom.plans import Sources, experiment_quicklook, top_query_report
from rankloom.plans import experiment_report as build_report

EXPERIMENT = ExperimentParams(
    dates=R.DAYS,
    flag=R.FLAG,
    placement=R.PLACEMENT,
    sample_event=R.EVENT,
    search_event=R.EVENT,
    cap=CAP,
    page_sizes=R.PAGE_SIZES,
)
QUICKLOOK = ExperimentParams.quicklook(
    R.DAY, R.FLAG, R.PLACEMENT, search_event=R.EVENT, cap=CAP, first_page=FIRST_PAGE
)
FILTERS = RequestFilters(
    R.PLACEMENT, query_type="main", cache_bucket="live", organic_only=True
)
# The logs of all days take part, so the window reaches back over the whole table.
POPULAR = TopQueryParams(
    as_of=R.AS_OF, filters=FILTERS, log_days=30, top=20, cap=CAP, first_page=FIRST_PAGE
)
POPULAR_BY_QUERY = replace(POPULAR, rank_scope="query")
SAMPLE = 50


def sources(spark, folder) -> Sources:
    return Sources(
        R.beacons(spark, folder),
        R.visit_beacons(spark, folder),
        R.rpc_logs(spark, folder),
        R.ab_tests(spark, folder),
        R.visits(spark, folder),
    )


def stage(spark, folder):
    """The rank table of the experiment, from stored searches."""
    stored = new_store(spark).replace("searches", searches(spark, folder))
    return stage_ranks_pivot(stored, R.rpc_logs(spark, folder), R.DAYS, R.PLACEMENT, CAP)


def base(spark, folder):
    """The stored rank table with page flags."""
    stored = new_store(spark).replace("stage_ranks", stage(spark, folder), "_date")
    tests, visits = R.ab_tests(spark, folder), R.visits(spark, folder)
    return page_flags(stored, tests, visits, R.FLAG, R.DAYS, R.PAGE_SIZES)


@check(f"""SELECT * FROM all_sample
           ORDER BY md5('0|' || request_uuid || '|' || ab_flag || '|' || ab_flag_variant)
           LIMIT {SAMPLE}""")
def experiment_sample_(spark, folder):
    beacons = R.beacons(spark, folder)
    return experiment_sample(beacons, R.FLAG, R.DAYS, SAMPLE, event_name=R.EVENT)


@check("""SELECT CAST(_date AS VARCHAR) AS _date, request_uuid, ab_flag, visit_id, query
          FROM all_searches""")
def sample_searches_(spark, folder):
    sample = experiment_sample(
        R.beacons(spark, folder), R.FLAG, R.DAYS, EXPERIMENT.sample_size, event_name=R.EVENT
    )
    found = sample_searches(
        sample, R.visit_beacons(spark, folder), R.DAYS, R.EVENT, EXPERIMENT.sample_size
    )
    return found.withColumn("_date", day_text("_date"))


@check(f"""SELECT CAST(s._date AS VARCHAR) AS _date, s.request_uuid, s.ab_flag, s.visit_id, s.query,
                  CAST(k.log_date AS VARCHAR) AS log_date, k.final_ids
           FROM all_searches AS s
           JOIN (SELECT logs.request_uuid, logs.log_date, coalesce(ids, '') AS final_ids FROM logs
                 LEFT JOIN (SELECT request_uuid, log_date,
                                   string_agg(CAST(lid AS VARCHAR), ',' ORDER BY rnk) AS ids
                            FROM log_ranks WHERE step = 'mo_last' GROUP BY 1, 2) AS f
                   USING (request_uuid, log_date)
                 WHERE log_date IN {IN_DAYS} AND placement = '{R.PLACEMENT}'
                   AND sort_by = 'relevance' AND sort_order = 'desc') AS k
             ON k.request_uuid = s.request_uuid""")
def request_logs_(spark, folder):
    logs = R.rpc_logs(spark, folder)
    found = request_logs(searches(spark, folder), logs, R.DAYS, R.PLACEMENT)
    final = step_ids("candidateSources", STEPS[-1]).cast("array<string>")
    return found.select(
        day_text("_date").alias("_date"),
        "request_uuid",
        "ab_flag",
        "visit_id",
        "query",
        F.to_date("query_time").cast("string").alias("log_date"),
        F.array_join(final, ",").alias("final_ids"),
    )


_POPULAR_LOGS = f"""
    SELECT DISTINCT request_uuid, query FROM logs
    WHERE placement = '{R.PLACEMENT}' AND sort_by = 'relevance' AND sort_order = 'desc'
      AND first_item = 0 AND query_type = 'main' AND bucket = 'live' AND organic
      AND log_date >= DATE '{R.AS_OF}' - 30
      AND query IN (SELECT query FROM popular WHERE rank <= 20)"""


@check(f"""SELECT request_uuid, query, CAST(log_date AS VARCHAR) AS log_date
           FROM logs JOIN (SELECT * FROM ({_POPULAR_LOGS}) AS p
                           ORDER BY md5('3|' || request_uuid || '|' || query) LIMIT 40) AS c
             USING (request_uuid, query)
           WHERE log_date >= DATE '{R.AS_OF}' - 30""")
def request_logs_by_query_(spark, folder):
    listed = most_used(top_queries(R.query_sessions(spark, folder), R.AS_OF), POPULAR.top)
    found = request_logs_by_query(
        listed, R.rpc_logs(spark, folder), POPULAR.logs_since, FILTERS, max_requests=40, seed="3"
    )
    return found.select(
        "request_uuid", "query", F.to_date("query_time").cast("string").alias("log_date")
    )


# Literal ranks: a number for each listing of each log row of each visit of a request.
_VISIT_RANKS = f"""
    SELECT s._date, s.request_uuid, s.ab_flag, s.visit_id, s.query, k.step, k.lid,
           row_number() OVER (PARTITION BY s.request_uuid, k.step
                              ORDER BY k.query_time, s.visit_id, s._date, s.query, k.rnk) AS rnk
    FROM all_searches AS s
    JOIN (SELECT * FROM kind_ranks WHERE log_date IN {IN_DAYS}) AS k
      ON k.request_uuid = s.request_uuid"""
_CHAIN_JOINS = " ".join(
    f"LEFT JOIN (SELECT * FROM v WHERE step = '{name}' AND rnk <= {CAP}) AS {name}"
    f" ON {name}.request_uuid = m.request_uuid AND {name}.lid = m.lid"
    for name in STEP_NAMES[:-1]
)
_CHAIN_RANKS = ", ".join(f"{name}.rnk AS {name}" for name in STEP_NAMES[:-1])


@check(doubles(f"""
    SELECT CAST(m._date AS VARCHAR) AS _date, m.request_uuid, m.ab_flag, m.visit_id, m.query,
           m.lid AS listing_id, {_CHAIN_RANKS}, m.rnk AS mo_last
    FROM (SELECT * FROM ({_VISIT_RANKS}) AS a WHERE step = 'mo_last' AND rnk <= {CAP}) AS m
    {_CHAIN_JOINS.replace("FROM v ", f"FROM ({_VISIT_RANKS}) AS v ")}"""))
def stage_ranks_joined_(spark, folder):
    """The literal form over every log row of every visit, ranks stored by step before the joins."""
    logs = request_logs(searches(spark, folder), R.rpc_logs(spark, folder), R.DAYS, R.PLACEMENT)
    facts = ["_date", "request_uuid", "ab_flag", "visit_id", "query"]
    ranked = ranked_candidates(
        logs, facts, order=["query_time", "visit_id", "_date", "query"], cap=CAP
    )
    stored = new_store(spark).replace("ranked", ranked, "step")
    chained = stage_ranks_joined(stored, ["request_uuid"])
    return R.doubles(chained.withColumn("_date", day_text("_date")))


@check(f"""SELECT count(*) AS requests, count(*) FILTER (WHERE n > 1) AS repeated_requests,
                  CAST(sum(n - 1) AS BIGINT) AS repeated_rows
           FROM (SELECT request_uuid, count(*) AS n FROM logs
                 WHERE log_date IN {IN_DAYS} AND placement = '{R.PLACEMENT}'
                   AND sort_by = 'relevance' AND sort_order = 'desc' GROUP BY 1) AS c""")
def logged_more_than_once_(spark, folder):
    return logged_more_than_once(R.rpc_logs(spark, folder), R.DAYS, R.PLACEMENT)


@check("SELECT * FROM all_sample")
def experiment_sample_unlimited(spark, folder):
    return experiment_sample(R.beacons(spark, folder), R.FLAG, R.DAYS, None, event_name=R.EVENT)


@check(doubles("SELECT CAST(_date AS VARCHAR) AS _date, stage.* EXCLUDE (_date) FROM stage"))
def stage_ranks_pivot_(spark, folder):
    return R.doubles(stage(spark, folder).withColumn("_date", day_text("_date")))


@check(doubles("""
    SELECT CAST(_date AS VARCHAR) AS _date, base.* EXCLUDE (_date, on_first, on_three),
           CAST(on_first AS INTEGER) AS page_1_flag, CAST(on_three AS INTEGER) AS top_3_flag
    FROM base"""))
def page_flags_(spark, folder):
    return R.doubles(base(spark, folder).withColumn("_date", day_text("_date")))


def stored_base(spark, folder):
    """The rank table with page flags as a table of its own, which reports read."""
    return new_store(spark).replace("temp_base", base(spark, folder))


@check(report(SHARES))
def retrieval_report_(spark, folder):
    return retrieval_report(stored_base(spark, folder))


@check(
    report(
        {name: mask for name, mask in SHARES.items() if name != "other"},
        suffix="_first_page_share",
    )
)
def retrieval_report_15_(spark, folder):
    return retrieval_report_15(stored_base(spark, folder))


_WIDE = pivot("log_runs", "request_uuid, query")


@check(first_page(f"({_WIDE}) AS w"))
def first_page_overall_(spark, folder):
    return first_page_overall(rank_rows(spark, folder), FIRST_PAGE)


@check(first_page(f"({_WIDE}) AS w", "query"))
def first_page_by_query_(spark, folder):
    return first_page_by_query(rank_rows(spark, folder), FIRST_PAGE)


@check("SELECT query, visits_that_used_query, pct_of_visits_covered, rank FROM popular")
def top_queries_(spark, folder):
    return top_queries(R.query_sessions(spark, folder), R.AS_OF)


@check(f"""SELECT DISTINCT request_uuid AS uuid, visit_id FROM beacon
           WHERE event_type = '{R.EVENT}' AND dt >= DATE '{R.DAY}'
             AND request_uuid IN (SELECT request_uuid FROM ({_WIDE}) AS w)""")
def request_to_visit_(spark, folder):
    ranks = rank_rows(spark, folder).withColumnRenamed("request_uuid", "uuid")
    return request_to_visit(
        ranks, R.visit_beacons(spark, folder), R.DAY, R.EVENT, store=new_store(spark)
    )


@check(report(SHARES))
def experiment_report(spark, folder):
    return build_report(sources(spark, folder), EXPERIMENT, new_store(spark))


@check(first_page("day_stage"), name="experiment_quicklook")
def quicklook_overall(spark, folder):
    return experiment_quicklook(sources(spark, folder), QUICKLOOK, new_store(spark))[0]


@check(first_page("day_stage", "query"), name="experiment_quicklook_by_query")
def quicklook_by_query(spark, folder):
    return experiment_quicklook(sources(spark, folder), QUICKLOOK, new_store(spark))[1]


_DAY_RUNNING = pivot(
    """(SELECT request_uuid, query, step, lid,
               row_number() OVER (PARTITION BY query, step
                 ORDER BY md5(request_uuid || '|' || log_date || '|' || query), query_time, rnk)
                 AS rnk
        FROM (SELECT DISTINCT request_uuid, query FROM day_searches) AS s
        JOIN (SELECT request_uuid, query_time, log_date, step, lid, rnk FROM day_runs) AS d
          USING (request_uuid)) AS n""",
    "request_uuid, query",
)


@check(first_page(
    f"day_searches AS s JOIN ({_DAY_RUNNING}) AS w USING (request_uuid, query)",
    "query",
))
def experiment_quicklook_query_ranks(spark, folder):
    params = replace(QUICKLOOK, rank_scope="query")
    return experiment_quicklook(sources(spark, folder), params, new_store(spark))[1]


_POPULAR_RANKS = f"""
    SELECT l.* FROM log_ranks AS l JOIN ({_POPULAR_LOGS}) AS p USING (request_uuid, query)
    WHERE log_date >= DATE '{R.AS_OF}' - 30"""
_POPULAR_WIDE = pivot(
    f"({running(f'({_POPULAR_RANKS}) AS l', 'request_uuid, query')}) AS r", "request_uuid, query"
)
_RUNNING_WIDE = pivot(
    f"""(SELECT request_uuid, query, step, lid,
                row_number() OVER (PARTITION BY query, step
                                   ORDER BY md5(request_uuid || '|' || query),
                                            query_time, rnk) AS rnk
         FROM ({_POPULAR_RANKS}) AS l) AS n""",
    "request_uuid, query",
)


@check(first_page(f"({_POPULAR_WIDE}) AS w"))
def top_query_report_(spark, folder):
    sessions, logs = R.query_sessions(spark, folder), R.rpc_logs(spark, folder)
    return top_query_report(sessions, logs, POPULAR, new_store(spark))[0]


@check(first_page(f"({_POPULAR_WIDE}) AS w", "query"))
def top_query_report_by_query(spark, folder):
    sessions, logs = R.query_sessions(spark, folder), R.rpc_logs(spark, folder)
    return top_query_report(sessions, logs, POPULAR)[1]


@check(first_page(f"({_RUNNING_WIDE}) AS w", "query"))
def top_query_report_query_ranks(spark, folder):
    sessions, logs = R.query_sessions(spark, folder), R.rpc_logs(spark, folder)
    return top_query_report(sessions, logs, POPULAR_BY_QUERY)[1]
