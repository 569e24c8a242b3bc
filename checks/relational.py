"""Unnesting, joins, aggregates, ranks, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from checks import relations as R
from checks.expressions import flat_logs
from checks.registry import check
from checks.scans import day_text
from checks.sql import CAP, FIRST_PAGE, IN_DAYS, STEP_NAMES, doubles, first_page, pivot
from checks.stores import new_store
from rankloom.functions import ratio, source_mask
from rankloom.operators.joins import spread_join
from rankloom.operators.logs import HEAVY_LOGS, request_logs, requests_of_kind
from rankloom.operators.metrics import first_page_by_query, first_page_overall, visit_facts
from rankloom.operators.popular import most_used, rank_by_count, top_queries
from rankloom.operators.ranks import (
    candidate_entries,
    listing_ranks,
    pivot_ranks,
    ranked_candidates,
    running_ranks,
    sort_stage_ranks,
    stage_ranks_joined,
)
from rankloom.operators.sampling import INELIGIBLE, flagged_requests, stable_sample
from rankloom.operators.searches import sample_searches, search_events

TOP = 10
SAMPLE = 500
REQUESTS = 300


def run_ranks(spark, folder, keys=("request_uuid",), cap=CAP):
    """Ranks over all log rows of each request, in the order of their time."""
    logs = flat_logs(spark, folder)
    return running_ranks(logs, "request_uuid", keys, cap, by_time=True, gather=True)


def rank_rows(spark, folder):
    """The rank table of every request and query, without visits, over all log rows."""
    keys = ["request_uuid", "query"]
    return pivot_ranks(run_ranks(spark, folder, keys), keys)


def eligible(spark, folder):
    rows = flagged_requests(R.beacons(spark, folder), R.FLAG)
    return rows.filter(F.col("ab_flag_variant") != INELIGIBLE)


def searches(spark, folder):
    """Searches of all eligible requests on the listed dates."""
    sample = flagged_requests(
        R.beacons(spark, folder).filter(F.col("dt").isin(list(R.DAYS))), R.FLAG, R.EVENT
    )
    sample = sample.filter(F.col("ab_flag_variant") != INELIGIBLE).distinct()
    return sample_searches(sample, R.visit_beacons(spark, folder), R.DAYS, R.EVENT)


_WIDE = pivot("log_runs", "request_uuid, query")


@check("""SELECT request_uuid, CAST(log_date AS VARCHAR) AS log_date, stage, source, listings
          FROM (SELECT req, request_uuid, log_date, stage, source, slot FROM logs,
                (VALUES ('POST_FILTER', 'SOLR', 0), ('POST_FILTER', 'ANN', 1),
                        ('POST_FILTER', 'XWALK', 2), ('POST_FILTER', 'XML', 3),
                        ('POST_BORDA', NULL, 4), ('RANKING', NULL, 5), ('MO_LISTWISE', NULL, 6),
                        ('MO_LASTPASS', NULL, 7), ('POST_FILTER', NULL, 0)) AS e(stage, source, slot))
          JOIN (SELECT c.req, s.slot, count(lid) AS listings
                FROM (SELECT DISTINCT req FROM cand) AS c CROSS JOIN steps AS s
                LEFT JOIN cand ON cand.req = c.req AND cand.slot = s.slot GROUP BY 1, 2) AS sizes
            USING (req, slot)""")
def unnest_struct_array(spark, folder):
    entries = candidate_entries(flat_logs(spark, folder), ["request_uuid", "query_time"])
    return entries.select(
        "request_uuid",
        F.to_date("query_time").cast("string").alias("log_date"),
        "stage",
        "source",
        F.size("listingIds").cast("bigint").alias("listings"),
    )


@check(f"SELECT request_uuid, '{R.FLAG}' AS ab_flag, variant AS ab_flag_variant FROM beacon")
def unnest_two_arrays(spark, folder):
    return flagged_requests(R.beacons(spark, folder), R.FLAG)


@check("""SELECT request_uuid, CAST(log_date AS VARCHAR) AS log_date, step, rnk - 1 AS position,
                 lid AS listing_id FROM log_ranks""")
def unnest_scalar_array(spark, folder):
    logs = flat_logs(spark, folder).withColumn("day", F.to_date("query_time").cast("string"))
    ranked = listing_ranks(logs, ["request_uuid", "day"], cap=None)
    return ranked.select(
        "request_uuid",
        F.col("day").alias("log_date"),
        "step",
        (F.col("rank") - 1).alias("position"),
        "listing_id",
    )


@check(f"""SELECT e.visit_id, e.request_uuid, s.variant AS ab_flag_variant, e.asked AS query
           FROM sent AS e
           JOIN (SELECT DISTINCT request_uuid, variant FROM beacon WHERE variant <> 'ineligible') AS s
             ON e.request_uuid = s.request_uuid
           WHERE e.event_type = '{R.EVENT}'""")
def join_inner_eq(spark, folder):
    events = search_events(R.visit_beacons(spark, folder), R.EVENT)
    sample = eligible(spark, folder).distinct()
    return events.join(sample, "request_uuid").select(
        "visit_id", "request_uuid", "ab_flag_variant", "query"
    )


_SEARCH_LOGS = f"""SELECT CAST(_date AS VARCHAR) AS day, s.request_uuid, visit_id,
                          CAST(log_date AS VARCHAR) AS log_date
                   FROM all_searches AS s, logs AS l
                   WHERE s.request_uuid = l.request_uuid AND l.placement = '{R.PLACEMENT}'
                     AND l.sort_by = 'relevance' AND l.sort_order = 'desc'
                     AND l.log_date IN {IN_DAYS}"""


def _search_logs(spark, folder, match_date):
    found = request_logs(
        searches(spark, folder), R.rpc_logs(spark, folder), R.DAYS, R.PLACEMENT, match_date
    )
    return found.select(
        day_text("_date").alias("day"),
        "request_uuid",
        "visit_id",
        F.to_date("query_time").cast("string").alias("log_date"),
    )


@check(_SEARCH_LOGS)
def join_cross_filtered(spark, folder):
    return _search_logs(spark, folder, match_date=False)


@check(f"{_SEARCH_LOGS} AND l.log_date = s._date")
def join_date_correlated(spark, folder):
    return _search_logs(spark, folder, match_date=True)


@check(f"""SELECT query, rank, request_uuid, CAST(log_date AS VARCHAR) AS log_date
           FROM logs JOIN popular USING (query) WHERE rank <= {TOP}""")
def join_query_list(spark, folder):
    listed = most_used(top_queries(R.query_sessions(spark, folder), R.AS_OF), TOP)
    logs = flat_logs(spark, folder).drop("candidateSources")
    joined = spread_join(logs, listed, ["query"], HEAVY_LOGS)
    return joined.select(
        "query", "rank", "request_uuid", F.to_date("query_time").cast("string").alias("log_date")
    )


def chain(source: str, keys: list[str], cap: int = CAP) -> str:
    """The left joins written out: every copy of a listing in a step meets every copy in the next."""
    on = " AND ".join(f"mo_last.{key} = {{0}}.{key}" for key in keys)
    joins = " ".join(
        f"LEFT JOIN (SELECT * FROM {source} WHERE step = '{name}' AND rnk <= {cap}) AS {name}"
        f" ON {on.format(name)} AND mo_last.lid = {name}.lid"
        for name in STEP_NAMES[:-1]
    )
    ranks = ", ".join(f"{name}.rnk AS {name}" for name in STEP_NAMES)
    kept = ", ".join(f"mo_last.{key}" for key in keys)
    return f"""SELECT {kept}, mo_last.lid AS listing_id, {ranks}
               FROM (SELECT * FROM {source} WHERE step = 'mo_last' AND rnk <= {cap}) AS mo_last {joins}"""


@check(doubles(chain("log_runs", ["request_uuid"])))
def join_left_chain_2key(spark, folder):
    ranked = new_store(spark).replace("ranked", run_ranks(spark, folder), "step")
    return R.doubles(stage_ranks_joined(ranked, ["request_uuid"]))


@check(doubles(chain("log_runs", ["request_uuid", "query"])))
def join_left_chain_3key(spark, folder):
    keys = ["request_uuid", "query"]
    ranked = new_store(spark).replace("ranked", run_ranks(spark, folder, keys), "step")
    return R.doubles(stage_ranks_joined(ranked, keys))


@check(f"""SELECT s.visit_id, s.request_uuid, a.ab_variant FROM all_searches AS s
           JOIN assigned AS a
             ON a.visit_id = s.visit_id AND a.ab_test = '{R.FLAG}' AND a._date IN {IN_DAYS}""")
def join_inner_on_filter(spark, folder):
    tests = R.ab_tests(spark, folder).filter(
        (F.col("ab_test") == R.FLAG) & F.col("_date").isin(list(R.DAYS))
    )
    return (
        searches(spark, folder)
        .join(tests.select("visit_id", "ab_variant"), "visit_id")
        .select("visit_id", "request_uuid", "ab_variant")
    )


@check(f"""SELECT s.visit_id, s.request_uuid, a.ab_variant, v.platform
           FROM all_searches AS s, assigned AS a, seen AS v
           WHERE a.visit_id = s.visit_id AND v.visit_id = a.visit_id AND a.ab_test = '{R.FLAG}'
             AND a._date IN {IN_DAYS} AND v._date IN {IN_DAYS}""")
def join_three_way(spark, folder):
    facts = visit_facts(R.ab_tests(spark, folder), R.visits(spark, folder), R.FLAG, R.DAYS)
    joined = searches(spark, folder).join(facts, "visit_id")
    return joined.select("visit_id", "request_uuid", "ab_variant", "platform")


@check(f"""SELECT a.request_uuid, a.lid AS listing_id, a.rnk AS mo_last,
                  CAST(b.rnk AS DOUBLE) AS ranking
           FROM (SELECT * FROM log_runs WHERE step = 'mo_last' AND rnk <= {CAP}) AS a
           LEFT JOIN (SELECT * FROM log_runs WHERE step = 'ranking' AND rnk <= {CAP}) AS b
             ON a.request_uuid = b.request_uuid AND a.lid = b.lid""")
def derived_table(spark, folder):
    ranked = run_ranks(spark, folder)
    parts = {
        name: ranked.filter(F.col("step") == name).select(
            "request_uuid", "listing_id", F.col("rank").alias(name)
        )
        for name in ("mo_last", "ranking")
    }
    joined = parts["mo_last"].join(parts["ranking"], ["request_uuid", "listing_id"], "left")
    return R.doubles(joined, ["ranking"])


@check("""SELECT query_raw AS query, count(DISTINCT visit_id)
                 / (SELECT count(DISTINCT visit_id) FROM sessions) AS share
          FROM sessions GROUP BY 1""")
def scalar_subquery(spark, folder):
    pairs = R.query_sessions(spark, folder).select("query_raw", "visit_id").distinct()
    visits = pairs.select("visit_id").distinct().agg(F.count("visit_id"))
    used = pairs.groupBy(F.col("query_raw").alias("query")).agg(F.count("visit_id").alias("n"))
    return used.select("query", ratio(F.col("n"), visits.scalar()).alias("share"))


@check(f"""SELECT request_uuid, '{R.FLAG}' AS ab_flag, variant AS ab_flag_variant FROM beacon
           WHERE variant <> 'ineligible' GROUP BY 1, 2, 3""")
def group_dedupe(spark, folder):
    return eligible(spark, folder).dropDuplicates(["request_uuid", "ab_flag", "ab_flag_variant"])


@check("SELECT DISTINCT request_uuid, asked AS query FROM beacon WHERE event_type = 'view'")
def select_distinct(spark, folder):
    events = search_events(R.visit_beacons(spark, folder), R.EVENT)
    return events.select("request_uuid", "query").distinct()


@check("""SELECT query_raw AS query, count(DISTINCT visit_id) AS visits FROM sessions GROUP BY 1""")
def count_distinct_grouped(spark, folder):
    sessions = R.query_sessions(spark, folder)
    return sessions.groupBy(F.col("query_raw").alias("query")).agg(
        F.countDistinct("visit_id").alias("visits")
    )


@check("SELECT count(DISTINCT visit_id) AS visits FROM sessions")
def count_distinct_global(spark, folder):
    return R.query_sessions(spark, folder).agg(F.countDistinct("visit_id").alias("visits"))


@check("SELECT ab_test, ab_variant, count(*) AS rows_of_variant FROM assigned GROUP BY 1, 2")
def count_star(spark, folder):
    rows = R.ab_tests(spark, folder)
    return rows.groupBy("ab_test", "ab_variant").agg(F.count("*").alias("rows_of_variant"))


@check(f"""SELECT query, count(*) FILTER (WHERE solr > 0 AND mo_last <= {FIRST_PAGE}) AS solr_rows,
                  count(*) FILTER (WHERE mo_last <= {FIRST_PAGE}) AS page_rows
           FROM ({_WIDE}) AS w GROUP BY 1""")
def sum_case(spark, folder):
    on_page = F.col("mo_last") <= FIRST_PAGE
    solr = F.when(on_page & F.col("solr").isNotNull(), 1).otherwise(0)
    return (
        rank_rows(spark, folder)
        .groupBy("query")
        .agg(
            F.sum(solr).alias("solr_rows"),
            F.sum(F.when(on_page, 1).otherwise(0)).alias("page_rows"),
        )
    )


_PAGE = first_page(f"({_WIDE}) AS w")
_SHARES = ["solr_first_page_share", "nir_first_page_share", "xwalk_first_page_share"]
_MEANS = [
    "borda_avg_first_page_rank",
    "ranking_avg_first_page_rank",
    "mo_avg_first_page_rank",
]


@check(f"SELECT {', '.join(_SHARES)} FROM ({_PAGE}) AS p")
def share_marginal(spark, folder):
    return first_page_overall(rank_rows(spark, folder), FIRST_PAGE).select(*_SHARES)


@check(f"SELECT {', '.join(_MEANS)} FROM ({_PAGE}) AS p")
def avg_case(spark, folder):
    return first_page_overall(rank_rows(spark, folder), FIRST_PAGE).select(*_MEANS)


@check(f"""SELECT CAST(mask AS INTEGER) AS mask, count(*) / any_value(total) AS share
           FROM (SELECT (solr IS NOT NULL)::INT + 2 * (nir IS NOT NULL)::INT
                        + 4 * (xwalk IS NOT NULL)::INT + 8 * (xml IS NOT NULL)::INT AS mask,
                        count(*) OVER () AS total
                 FROM ({_WIDE}) AS w WHERE mo_last <= {FIRST_PAGE}) AS m
           GROUP BY 1""")
def share_exclusive(spark, folder):
    on_page = rank_rows(spark, folder).filter(F.col("mo_last") <= FIRST_PAGE)
    masks = on_page.groupBy(source_mask().alias("mask")).agg(F.count("*").alias("n"))
    total = masks.agg(F.sum("n"))
    return masks.select("mask", ratio(F.col("n"), total.scalar()).alias("share"))


@check(f"""SELECT count(*) AS listings, count(DISTINCT request_uuid) AS requests,
                  min(mo_last) AS best, max(mo_last) AS worst, avg(solr) AS mean_solr
           FROM ({_WIDE}) AS w""")
def agg_global(spark, folder):
    return rank_rows(spark, folder).agg(
        F.count("*").alias("listings"),
        F.countDistinct("request_uuid").alias("requests"),
        F.min("mo_last").alias("best"),
        F.max("mo_last").alias("worst"),
        F.avg("solr").alias("mean_solr"),
    )


@check(f"SELECT query, mo_avg_first_page_rank FROM ({first_page(f'({_WIDE}) AS w', 'query')}) AS p")
def agg_by_query(spark, folder):
    metrics = first_page_by_query(rank_rows(spark, folder), FIRST_PAGE)
    return metrics.select("query", "mo_avg_first_page_rank")


@check(f"""SELECT ab_variant, count(DISTINCT s.visit_id) AS visits, count(*) AS searches
           FROM all_searches AS s JOIN assigned AS a
             ON a.visit_id = s.visit_id AND ab_test = '{R.FLAG}' AND a._date IN {IN_DAYS}
           GROUP BY 1""")
def agg_by_variant(spark, folder):
    facts = visit_facts(R.ab_tests(spark, folder), R.visits(spark, folder), R.FLAG, R.DAYS)
    joined = searches(spark, folder).join(facts, "visit_id")
    return joined.groupBy("ab_variant").agg(
        F.countDistinct("visit_id").alias("visits"), F.count("*").alias("searches")
    )


@check("SELECT platform, count(*) AS visits FROM seen GROUP BY 1")
def group_by_ordinal(spark, folder):
    return spark.sql(
        "SELECT platform, count(*) AS visits FROM {seen} GROUP BY 1",
        seen=R.visits(spark, folder),
    )


@check("SELECT 'u' || user_id AS request, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2")
def group_by_alias(spark, folder):
    return spark.sql(
        "SELECT concat('u', user_id) AS request, event_type AS kind, count(*) AS n"
        " FROM {events} GROUP BY request, kind",
        events=R.table(spark, folder, "events"),
    )


@check("SELECT request_uuid, step, lid AS listing_id, rnk AS rank FROM log_runs")
def rank_in_request(spark, folder):
    return run_ranks(spark, folder, cap=None).select("request_uuid", "step", "listing_id", "rank")


@check("""SELECT query, request_uuid, step, lid AS listing_id,
                 row_number() OVER (PARTITION BY query, step
                                    ORDER BY md5(request_uuid || '|' || log_date), rnk) AS rank
          FROM log_ranks""")
def rank_in_query(spark, folder):
    logs = flat_logs(spark, folder).withColumn("log_date", F.to_date("query_time"))
    ranked = running_ranks(logs, "query", ["request_uuid", "log_date"], cap=None)
    return ranked.select("query", "request_uuid", "step", "listing_id", "rank")


@check("SELECT query, visits_that_used_query, rank FROM popular")
def rank_popular(spark, folder):
    queries = top_queries(R.query_sessions(spark, folder), R.AS_OF)
    return queries.select("query", "visits_that_used_query", "rank")


@check(f"""SELECT query, request_uuid, step, lid AS listing_id, rank
           FROM (SELECT query, request_uuid, step, lid,
                        row_number() OVER (PARTITION BY query, step
                                           ORDER BY query_time, request_uuid, rnk, lid) AS rank
                 FROM log_ranks) AS w WHERE rank <= {CAP}""")
def topk_per_group(spark, folder):
    return ranked_candidates(
        flat_logs(spark, folder),
        ["query", "request_uuid"],
        scope="query",
        order=["query_time", "request_uuid"],
        cap=CAP,
    )


@check(f"SELECT query, rank FROM popular WHERE rank <= {TOP}")
def topk_by_rank(spark, folder):
    queries = top_queries(R.query_sessions(spark, folder), R.AS_OF)
    return most_used(queries, TOP).select("query", "rank")


@check(f"""SELECT o_custkey, o_orderpriority FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders)
           ORDER BY md5('7|' || o_custkey || '|' || o_orderpriority) LIMIT {SAMPLE}""")
def sample_random_n(spark, folder):
    pairs = R.table(spark, folder, "orders").select("o_custkey", "o_orderpriority").distinct()
    return stable_sample(pairs, SAMPLE, "7", ["o_custkey", "o_orderpriority"])


_SORTED = ["query", "mo_last", "mo_list", "ranking", "borda", "solr", "nir", "xwalk", "xml"]
_BY_STEPS = ", ".join(f"{name} NULLS LAST" for name in _SORTED[1:])


@check(f"{doubles(_WIDE)} ORDER BY query NULLS FIRST, {_BY_STEPS}", ordered=_SORTED)
def sort_multi_nulls_last(spark, folder):
    return R.doubles(sort_stage_ranks(rank_rows(spark, folder)))


@check("SELECT query_raw AS query, count(*) AS uses FROM sessions GROUP BY 1 ORDER BY uses DESC", ordered=["uses"])
def sort_desc(spark, folder):
    sessions = R.query_sessions(spark, folder)
    uses = sessions.groupBy(F.col("query_raw").alias("query")).agg(F.count("*").alias("uses"))
    return uses.orderBy(F.col("uses").desc())


@check("SELECT ab_variant, count(*) AS n FROM assigned GROUP BY 1 ORDER BY 1 NULLS FIRST", ordered=["ab_variant"])
def sort_by_ordinal_or_alias(spark, folder):
    return spark.sql(
        "SELECT ab_variant, count(*) AS n FROM {tests} GROUP BY ab_variant ORDER BY 1",
        tests=R.ab_tests(spark, folder),
    )


@check(f"""SELECT request_uuid FROM (SELECT DISTINCT request_uuid FROM logs
             WHERE placement = '{R.PLACEMENT}' AND sort_by = 'relevance' AND sort_order = 'desc') AS l
           ORDER BY md5('0|' || request_uuid) LIMIT {REQUESTS}""")
def limit_unordered(spark, folder):
    kept = requests_of_kind(R.rpc_logs(spark, folder), R.PLACEMENT)
    ids = kept.select(F.col("RequestIdentifiers.requestUUID").alias("request_uuid")).distinct()
    return stable_sample(ids, REQUESTS, "0", ["request_uuid"])


@check("""SELECT 'type' AS metric, event_type AS name, count(*) AS share FROM events GROUP BY 2
          UNION ALL SELECT 'platform', platform, count(*) FROM seen GROUP BY 2""")
def union_all_positional(spark, folder):
    events = R.table(spark, folder, "events").groupBy("event_type").agg(F.count("*"))
    visits = R.visits(spark, folder).groupBy("platform").agg(F.count("*"))
    first = events.select(F.lit("type"), "event_type", "count(1)").toDF("metric", "name", "share")
    return first.union(visits.select(F.lit("platform"), "platform", "count(1)"))
