"""Counts of distinct ids for very large groups: exact, or by mergeable sketches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Two to this power are the registers of a sketch: a standard error of some 0.8 % (0.8 / sqrt(2^14))
# for large groups, and nearly none for groups of up to some 1,000 ids. At most 16 KB a group.
SKETCH_POWER = 14


def distinct_sketches(
    rows: DataFrame, by: Sequence[str], column: str, power: int = SKETCH_POWER
) -> DataFrame:
    """``by`` and ``sketch``: a HyperLogLog sketch of the ids of each group. NULL ids don't count.

    Sketches are built in each task before anything travels, so a group of any size sends a few KB
    from a task. Store them by date to count any set of dates later without the ids.
    """
    return rows.groupBy(*by).agg(F.hll_sketch_agg(column, power).alias("sketch"))


def merge_sketches(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sketches of coarser groups, as if they were built from all ids. Ids in several count once."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))


def estimate_sketches(sketches: DataFrame, name: str) -> DataFrame:
    """The sketches' estimated numbers of distinct ids as ``name``."""
    rest = [column for column in sketches.columns if column != "sketch"]
    return sketches.select(*rest, F.hll_sketch_estimate("sketch").alias(name))


def count_distinct(
    rows: DataFrame, by: Sequence[str], column: str, name: str, approximate: bool = False
) -> DataFrame:
    """Distinct ids of each group as ``name``: exact, or estimated with ``approximate``."""
    if approximate:
        return estimate_sketches(distinct_sketches(rows, by, column), name)
    return rows.groupBy(*by).agg(F.countDistinct(column).alias(name))
