"""Choosing ranking-service log rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.operators.joins import semi_join, spread_join
from rankloom.operators.sampling import stable_sample
from rankloom.params import ALL, ANY, RequestFilters
from rankloom.sources import on_timestamp_dates, since_timestamp_date

REQUEST_ID = "RequestIdentifiers.requestUUID"
# Log rows of one request that a task joins with the request's searches.
HEAVY_LOGS = 20_000


def requests_of_kind(
    logs: DataFrame, placement: str, sort_by: str = "relevance", sort_order: str = "desc"
) -> DataFrame:
    """Log rows of one placement, sorted in the given way."""
    return logs.filter(
        (F.col("request.options.searchPlacement") == placement)
        & (F.col("request.sortBy") == sort_by)
        & (F.col("request.sortOrder") == sort_order)
    )


def request_fields(logs: DataFrame) -> DataFrame:
    """The few log fields later steps need, flat."""
    return logs.select(
        F.col(REQUEST_ID).alias("request_uuid"),
        F.col("request.query").alias("query"),
        F.col("queryTime").alias("query_time"),
        F.col("OrganicRequestMetadata.candidateSources").alias("candidateSources"),
    )


def with_candidates(logs: DataFrame, trim: Callable[[str], Column] | None) -> DataFrame:
    """The log rows with ``trim`` applied to their candidate array."""
    return logs if trim is None else logs.withColumn("candidateSources", trim("candidateSources"))


def first_log(logs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The earliest log row of every key.

    Spark limits the groups before the exchange as well, so a request logged over and over sends
    one row from each task. Only used where repeats are asked to be left out.
    """
    order = Window.partitionBy(*keys).orderBy("query_time", F.xxhash64("candidateSources"))
    return logs.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").drop("_nth")


def request_logs(
    searches: DataFrame,
    logs: DataFrame,
    dates: Sequence[date],
    placement: str,
    match_date: bool = False,
    max_requests: int | None = None,
) -> DataFrame:
    """Each search with the candidates of each log row of its request.

    With ``match_date`` the log row must be of the day of the search; otherwise any listed day.
    Log rows of other requests are dropped where they are read, before any row is shuffled, and a
    request with very many log rows is joined in slices.
    """
    kept = request_fields(requests_of_kind(on_timestamp_dates(logs, dates, "queryTime"), placement))
    kept = kept.drop("query")
    keys = ["request_uuid"]
    if match_date:
        kept = kept.withColumn("_date", F.to_date("query_time"))
        keys.append("_date")
        max_requests = None if max_requests is None else max_requests * len(dates)
    found = semi_join(kept, searches, keys, max_requests)
    joined = spread_join(found, searches, keys, HEAVY_LOGS)
    return joined.select(*searches.columns, "query_time", "candidateSources")


def sampled_logs(
    searches: DataFrame,
    logs: DataFrame,
    dates: Sequence[date],
    placement: str,
    match_date: bool = False,
    max_requests: int | None = None,
    trim: Callable[[str], Column] | None = None,
    repeats: str = ALL,
) -> DataFrame:
    """The log rows of every request (and day, with ``match_date``) in ``searches``.

    ``repeats`` is ``all``, or ``first`` for the earliest row of each request only.
    ``trim`` is applied to the candidate array. ``max_requests`` is the most requests ``searches``
    can hold; without it they are counted. Log rows of other requests are dropped where they are
    read, at any number of requests: no row of theirs is shuffled.
    """
    kept = request_fields(requests_of_kind(on_timestamp_dates(logs, dates, "queryTime"), placement))
    kept = kept.drop("query")
    keys = ["request_uuid"]
    if match_date:
        kept = kept.withColumn("_date", F.to_date("query_time"))
        keys.append("_date")
        max_requests = None if max_requests is None else max_requests * len(dates)
    found = with_candidates(semi_join(kept, searches, keys, max_requests), trim)
    return found if repeats == ALL else first_log(found, keys)


def logged_more_than_once(logs: DataFrame, dates: Sequence[date], placement: str) -> DataFrame:
    """How many requests were logged, how many more than once, and the rows beyond the first.

    One row; a missing request id counts as a request. Rows are counted before the exchange.
    """
    kept = request_fields(requests_of_kind(on_timestamp_dates(logs, dates, "queryTime"), placement))
    counts = kept.groupBy("request_uuid").agg(F.count("*").alias("n"))
    return counts.agg(
        F.count("*").alias("requests"),
        F.count_if(F.col("n") > 1).alias("repeated_requests"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_rows"),
    )


def optional_filters(filters: RequestFilters) -> Column:
    """Conjunction of the behaviour and user tests that are switched on."""
    behavior = "request.options.behavior"
    texts = {
        f"{behavior}.matching": filters.matching,
        f"{behavior}.ranking": filters.ranking,
        f"{behavior}.marketOptimization": filters.market_optimization,
    }
    test = F.lit(True)
    for column, wanted in texts.items():
        if wanted != ANY:
            test = test & (F.col(column) == wanted)
    if filters.user_id > 0:
        test = test & (F.col("request.options.personalizationOptions.userId") == filters.user_id)
    if filters.user_id < 0:
        test = test & (F.col("request.options.signedInUser") == F.lit(False))
    return test


def popular_requests(logs: DataFrame, filters: RequestFilters) -> DataFrame:
    """Log rows of the request class that popular queries are measured on."""
    kept = requests_of_kind(logs, filters.placement, filters.sort_by, filters.sort_order)
    kept = kept.filter((F.col("request.offset") == filters.offset) & optional_filters(filters))
    if filters.query_type is not None:
        kept = kept.filter(F.col("request.options.queryType") == filters.query_type)
    if filters.cache_bucket is not None:
        kept = kept.filter(F.col("request.options.cacheBucketId") == filters.cache_bucket)
    if filters.organic_only:
        kept = kept.filter(F.col("request.options.organicOnly") == F.lit(True))
    return kept


def request_logs_by_query(
    queries: DataFrame,
    logs: DataFrame,
    since: date,
    filters: RequestFilters,
    max_requests: int | None = None,
    seed: str = "0",
    trim: Callable[[str], Column] | None = None,
    repeats: str = ALL,
) -> DataFrame:
    """The log rows of every request whose text is in ``queries.query``.

    With ``max_requests`` only so many requests are kept, and ``seed`` decides which; the choice is
    made on ids alone, so candidate lists travel only for requests that are kept. ``repeats`` is
    ``all``, or ``first`` for the earliest row of each request. A top list has no limit of its own,
    as its last ranks may be tied: its bytes are counted before it is broadcast.
    """
    kept = request_fields(
        popular_requests(since_timestamp_date(logs, since, "queryTime"), filters)
    )
    keys = ["request_uuid", "query"]
    asked = semi_join(kept, queries, ["query"])
    found = asked
    if max_requests is not None:
        chosen = stable_sample(asked.select(*keys).distinct(), max_requests, seed, keys)
        found = semi_join(asked, chosen, keys, max_requests)
    found = with_candidates(found, trim)
    return found if repeats == ALL else first_log(found, keys)
