"""From query popularity to first-page metrics."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators.logs import request_logs_by_query
from rankloom.operators.metrics import first_page_by_query, first_page_overall
from rankloom.operators.popular import most_used, top_queries
from rankloom.operators.ranks import (
    STEP_NAMES,
    pivot_ranks,
    request_ranks,
    running_ranks,
    trimmed_candidates,
)
from rankloom.params import TopQueryParams
from rankloom.session import require_utc
from rankloom.sources import TableStore


def popular_rank_table(
    query_sessions: DataFrame,
    rpc_logs: DataFrame,
    params: TopQueryParams,
    store: TableStore | None = None,
) -> DataFrame:
    """The rank table of logged requests for the most used queries and ``extra_queries``.

    ``rank_scope`` is ``request``, or ``query`` for ranks that run on over the requests of a query.
    With a store the top list is a table.
    """
    spark = rpc_logs.sparkSession
    require_utc(spark)
    popular = top_queries(query_sessions, params.as_of, params.days)
    if store is not None:
        popular = store.replace("top_queries", popular)
    listed = most_used(popular, params.top).select("query")
    if params.extra_queries:
        extra = spark.createDataFrame([(text,) for text in params.extra_queries], "query string")
        listed = listed.unionByName(extra)
    logs = request_logs_by_query(
        listed,
        rpc_logs,
        params.logs_since,
        params.filters,
        params.max_requests,
        params.seed,
        partial(trimmed_candidates, cap=params.cap),
        params.repeats,
    )
    keys = ["request_uuid", "query"]
    if params.rank_scope == "query":
        ranks = pivot_ranks(running_ranks(logs, "query", keys, params.cap, gather=True), keys)
    else:
        ranks = request_ranks(logs, keys, params.cap, params.repeats)
    ranks = ranks.select(F.col("request_uuid").alias("uuid"), "query", "listing_id", *STEP_NAMES)
    return ranks if store is None else store.replace("stage_ranks", ranks)


def top_query_report(
    query_sessions: DataFrame,
    rpc_logs: DataFrame,
    params: TopQueryParams,
    store: TableStore | None = None,
) -> tuple[DataFrame, DataFrame]:
    """First-page metrics for the most used queries: overall, and for each query."""
    ranks = popular_rank_table(query_sessions, rpc_logs, params, store)
    return (
        first_page_overall(ranks, params.first_page, params.strict),
        first_page_by_query(ranks, params.first_page, params.strict),
    )
