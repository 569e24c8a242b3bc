"""Exact sets of visits for each query and day, kept small, so that any span of days can be counted.

Visits have dense numbers. A set is cut into blocks of 32,768 numbers: a block with many visits is a
bitmap of 4 KB, one with few is a list of places. Sets of several days are joined without the visits.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.functions import ratio
from rankloom.operators.popular import rank_by_count
from rankloom.sources import since_date

# Numbers in a block: what bitmap_construct_agg builds.
BLOCK = 4096 * 8
# A block with fewer visits is a list of places.
LEAST_BITMAP = 256
# Hex digits of a digest that name a bucket: 65,536 buckets, whose counts are put in order.
BUCKET_DIGITS = 4


def number_visits(visits: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``visit_id`` and ``number`` of the visits that ``known`` does not have, numbered after its last.

    Numbers are dense and follow from the ids alone: ids are counted by digest prefix, and numbered
    within their prefix. No task orders all ids. A NULL id has no number.
    """
    ids = visits.select("visit_id").filter(F.col("visit_id").isNotNull()).distinct()
    first = F.lit(0).cast("bigint")
    if known is not None:
        ids = ids.join(known, "visit_id", "left_anti")
        last = known.agg(F.coalesce(F.max("number") + 1, F.lit(0)).cast("bigint").alias("n"))
        first = last.scalar()
    digest = F.md5(F.col("visit_id").cast("string"))
    placed = ids.withColumn("_bucket", F.substring(digest, 1, BUCKET_DIGITS))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_bucket").agg(F.count("*").alias("_held"))
    starts = starts.withColumn("_start", F.coalesce(F.sum("_held").over(before), F.lit(0))).drop("_held")
    own = F.row_number().over(Window.partitionBy("_bucket").orderBy("visit_id")) - 1
    numbered = placed.join(F.broadcast(starts), "_bucket")
    return numbered.select("visit_id", (first + F.col("_start") + own).cast("bigint").alias("number"))


def visit_sets(rows: DataFrame, numbers: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by``, ``block``, ``bitmap``, ``places``: the visits of each group, one row for each block.

    A block has either a bitmap or a list of fewer than ``LEAST_BITMAP`` places. A frequent group's
    rows are made distinct before they are gathered, and a block holds 32,768 visits at most.
    """
    placed = rows.select(*by, "visit_id").distinct().join(numbers, "visit_id")
    placed = placed.select(
        *by,
        F.floor(F.col("number") / BLOCK).cast("bigint").alias("block"),
        (F.col("number") % BLOCK).alias("_place"),
    )
    sets = placed.groupBy(*by, "block").agg(
        F.bitmap_construct_agg("_place").alias("bitmap"),
        F.sort_array(F.collect_list(F.col("_place").cast("int"))).alias("places"),
    )
    many = F.size("places") >= LEAST_BITMAP
    return sets.select(
        *by,
        "block",
        F.when(many, F.col("bitmap")).alias("bitmap"),
        F.when(~many, F.col("places")).alias("places"),
    )


def _is_set(bitmap: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substr(bitmap, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10)
    return F.getbit(byte.cast("bigint"), place % 8) == 1


def count_sets(sets: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """Distinct visits of coarser groups, such as all days of a span. A visit of two days counts once."""
    joined = sets.groupBy(*by, "block").agg(
        F.max(F.col("bitmap").isNotNull()).alias("_any"),
        F.bitmap_or_agg(F.coalesce("bitmap", F.lit(b""))).alias("_bitmap"),
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("_places"),
    )
    others = F.filter("_places", lambda p: ~F.col("_any") | ~_is_set(F.col("_bitmap"), p))
    held = F.when(F.col("_any"), F.bitmap_count("_bitmap")).otherwise(F.lit(0)) + F.size(others)
    return joined.groupBy(*by).agg(F.sum(held).cast("bigint").alias(name))


def top_queries_of_sets(sets: DataFrame, as_of: date, days: int = 7) -> DataFrame:
    """``top_queries`` from the stored sets of (query, day): a further day adds the sets of that day.

    ``sets`` has the columns ``query`` and ``_date``. The visits of all queries are the join of
    their sets, so no other table is read.
    """
    recent = since_date(sets, as_of - timedelta(days=days), "_date")
    used = count_sets(recent, ["query"], "visits_that_used_query")
    visits = count_sets(recent, [], "visits")
    covered = used.withColumn(
        "pct_of_visits_covered",
        ratio(F.col("visits_that_used_query"), visits.scalar()),
    )
    return rank_by_count(covered, "visits_that_used_query")
