"""Repeatable samples of distinct rows."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.functions import nth, pairs_with_key
from rankloom.sources import on_dates

# Hex digits of the digest that name a bucket: 65,536 buckets, so the quota table is small.
BUCKET_DIGITS = 4
# Fixed value: the variant of requests that take no part in the experiment.
INELIGIBLE = "ineligible"


def stable_sample(rows: DataFrame, n: int | None, seed: str, keys: Sequence[str]) -> DataFrame:
    """The ``n`` rows with the smallest ``md5(seed|keys)``; ``rows`` must be distinct by ``keys``.

    All rows if ``n`` is None.

    Equal to ordering by the digest and limiting, without sending ``n`` rows from every partition
    to a single task: digests are counted by prefix, whole prefixes are kept while they fit, and
    only the last one is ordered.
    """
    if n is None:
        return rows
    text = F.concat_ws("|", F.lit(seed), *[F.col(key).cast("string") for key in keys])
    digested = rows.withColumn("_digest", F.md5(text)).withColumn(
        "_bucket", F.substring("_digest", 1, BUCKET_DIGITS)
    )
    # One row for each prefix, 65,536 at most.
    upto = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    quota = (
        digested.groupBy("_bucket")
        .agg(F.count("*").alias("_held"))
        .withColumn("_room", F.lit(n) - F.sum("_held").over(upto) + F.col("_held"))
        .filter("_room > 0")
        .select("_bucket", "_room")
    )
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy("_digest", *keys))
    return (
        digested.join(F.broadcast(quota), "_bucket")
        .withColumn("_place", place)
        .filter(F.col("_place") <= F.col("_room"))
        .select(*rows.columns)
    )


def flagged_requests(
    beacons: DataFrame, flag: str, event_name: str | None = None, strict: bool = False
) -> DataFrame:
    """Every pairing of the flag entries and request ids of a beacon, repeats included.

    Both arrays are cut down to the wanted key before they are unnested.
    """
    if event_name is not None:
        beacons = beacons.filter(F.col("event_name") == event_name)
    ids = beacons.select(
        pairs_with_key("ab.map", flag).alias("flags"),
        F.explode(pairs_with_key("properties.map", "request_uuid")).alias("property"),
    )
    return ids.select(
        F.col("property.value").alias("request_uuid"), F.explode("flags").alias("entry")
    ).select(
        "request_uuid",
        F.col("entry.key").alias("ab_flag"),
        nth(F.col("entry.value.value_tuple"), 0, strict).alias("ab_flag_variant"),
    )


def experiment_sample(
    beacons: DataFrame,
    flag: str,
    dates: Sequence[date],
    n: int | None,
    seed: str = "0",
    event_name: str | None = None,
    strict: bool = False,
) -> DataFrame:
    """Up to ``n`` distinct (request, flag, variant) rows of eligible requests."""
    eligible = flagged_requests(on_dates(beacons, dates), flag, event_name, strict).filter(
        F.col("ab_flag_variant") != INELIGIBLE
    )
    return stable_sample(
        eligible.distinct(), n, seed, ["request_uuid", "ab_flag", "ab_flag_variant"]
    )


def merge_samples(
    states: Sequence[DataFrame], n: int | None, seed: str, keys: Sequence[str]
) -> DataFrame:
    """The sample of all rows behind ``states``, which are samples of ``n`` or more of their rows.

    Equal to ``stable_sample`` over all rows: one of the ``n`` smallest digests of all is one of the
    ``n`` smallest wherever it stands. So the sample of further dates follows from a stored sample
    of each date, and merging may go on in any order.
    """
    rows = reduce(DataFrame.unionByName, states)
    return stable_sample(rows.distinct(), n, seed, keys)
