"""Search beacons: from requests to visits and query texts."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions import kv_lookup
from rankloom.operators.joins import BROADCAST_BYTES, fits_broadcast, held_size, semi_join, spread_join
from rankloom.sources import TableStore, on_dates, since_date

# Beacons of one request that a task joins with the request's sample rows.
HEAVY_BEACONS = 200_000


def search_events(visit_beacons: DataFrame, event_name: str, strict: bool = False) -> DataFrame:
    """Date, visit, request id and query text of the beacons of one event."""
    pairs = "beacon.properties.key_value"
    return visit_beacons.filter(F.col("beacon.event_name") == event_name).select(
        F.col("dt").alias("_date"),
        "visit_id",
        kv_lookup(pairs, "request_uuid", strict).alias("request_uuid"),
        kv_lookup(pairs, "query", strict).alias("query"),
    )


def sample_searches(
    sample: DataFrame,
    visit_beacons: DataFrame,
    dates: Sequence[date],
    event_name: str = "search",
    max_sample: int | None = None,
    strict: bool = False,
) -> DataFrame:
    """Visits and query texts of the sampled requests, one row for each beacon.

    ``max_sample`` is the row limit the sample was drawn with. When a sample of that size may be
    broadcast the beacons are not shuffled, however many of them share a request id. A larger
    sample meets them in a join that cuts such a request into slices.
    """
    events = search_events(on_dates(visit_beacons, dates), event_name, strict)
    events = events.filter(F.col("query").isNotNull())
    wanted = sample.select("request_uuid", "ab_flag")
    # The limit says whether counting is worth it; the bytes that are counted decide.
    if fits_broadcast(wanted, max_sample) and held_size(wanted)[1] <= BROADCAST_BYTES:
        found = events.join(F.broadcast(wanted), "request_uuid")
    else:
        found = spread_join(events, wanted, ["request_uuid"], HEAVY_BEACONS)
    return found.select("_date", "request_uuid", "ab_flag", "visit_id", "query")


def request_to_visit(
    requests: DataFrame,
    visit_beacons: DataFrame,
    since: date,
    event_name: str = "search",
    key: str = "uuid",
    strict: bool = False,
    store: TableStore | None = None,
) -> DataFrame:
    """Distinct (request, visit) pairs of the requests named in ``requests[key]``.

    Beacons of other requests are dropped where they are read. The ids are counted and then joined:
    with a ``store`` they become a table first (``requests``), so that a rank table that is not
    stored itself is worked out once.
    """
    events = search_events(since_date(visit_beacons, since), event_name, strict)
    visits = events.select(F.col("request_uuid").alias(key), "visit_id")
    if store is not None:
        requests = store.replace("requests", requests.select(key).dropna().distinct())
    return semi_join(visits, requests, [key]).distinct()
