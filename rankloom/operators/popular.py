"""The most used queries."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.functions import ratio
from rankloom.operators.distinct import count_distinct
from rankloom.sources import since_date


def rank_by_count(rows: DataFrame, count: str, name: str = "rank") -> DataFrame:
    """Rank of each row by a count, largest first; ties share a rank and leave a gap.

    A row's rank is one more than the rows with a larger count. Counts that add up to ``t`` take
    less than ``sqrt(2t)`` values, so the rows of each value are counted and only the values are
    put in order: some million for 10^12, small enough to broadcast.
    """
    larger = Window.orderBy(F.col(count).desc()).rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        rows.groupBy(count)
        .agg(F.count("*").alias("_rows"))
        .withColumn(name, F.coalesce(F.sum("_rows").over(larger), F.lit(0)) + 1)
        .drop("_rows")
    )
    return rows.join(F.broadcast(levels), count).select(*rows.columns, name)


def top_queries(
    query_sessions: DataFrame, as_of: date, days: int = 7, approximate: bool = False
) -> DataFrame:
    """Queries of the last days by visits that used them, with their share of all visits.

    With ``approximate`` visits are estimated by sketches (see ``distinct.SKETCH_POWER``), and so
    the ranks of queries with nearly as many visits may be exchanged. Off by default.
    """
    recent = since_date(query_sessions, as_of - timedelta(days=days), "_date")
    recent = recent.withColumnRenamed("query_raw", "query")
    used = count_distinct(recent, ["query"], "visit_id", "visits_that_used_query", approximate)
    visits = count_distinct(recent, [], "visit_id", "visits", approximate)
    covered = used.withColumn(
        "pct_of_visits_covered", ratio(F.col("visits_that_used_query"), visits.scalar())
    )
    return rank_by_count(covered, "visits_that_used_query")


def most_used(queries: DataFrame, top: int) -> DataFrame:
    """Queries up to rank ``top``; more than ``top`` of them when the last ranks are tied."""
    return queries.filter(F.col("rank") <= top)


def top_queries_bounded(
    query_sessions: DataFrame, as_of: date, top: int, days: int = 7
) -> DataFrame:
    """``most_used(top_queries(..), top)`` without the distinct visits of all queries.

    A query has no more visits than rows, and rows are counted without a shuffle of visits. The
    visits of the ``top`` queries with the most rows give a floor: so many visits, at least, the
    query of rank ``top`` has. Only queries with as many rows as the floor can be in the list, tied
    or not, and only their visits are counted. The result is exact.
    """
    recent = since_date(query_sessions, as_of - timedelta(days=days), "_date")
    recent = recent.withColumnRenamed("query_raw", "query").select("query", "visit_id")
    rows = recent.groupBy("query").agg(F.count("visit_id").alias("_rows"))
    most = rows.orderBy(F.desc("_rows"), "query").limit(top)
    # The list is short, so it is joined as it is; a NULL query is one like others.
    busy = F.broadcast(most.select(F.struct("query").alias("_query")))
    first = recent.withColumn("_query", F.struct("query")).join(busy, "_query", "left_semi")
    counts = first.groupBy("_query").agg(F.countDistinct("visit_id").alias("n"))
    floor = counts.agg(
        F.when(F.count("*") >= top, F.min("n")).otherwise(F.lit(0)).alias("floor")
    )
    able = rows.filter(F.col("_rows") >= floor.scalar()).select(F.struct("query").alias("_query"))
    held = recent.withColumn("_query", F.struct("query")).join(able.hint("merge"), "_query", "left_semi")
    used = count_distinct(held, ["query"], "visit_id", "visits_that_used_query")
    visits = recent.agg(F.countDistinct("visit_id").alias("visits"))
    covered = used.withColumn(
        "pct_of_visits_covered", ratio(F.col("visits_that_used_query"), visits.scalar())
    )
    return most_used(rank_by_count(covered, "visits_that_used_query"), top)
