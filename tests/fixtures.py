"""Small nested tables written by hand."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from rankloom.operators.ranks import STEPS

BEACON = (
    "dt date, event_name string,"
    " ab struct<map: array<struct<key: string, value: struct<value_tuple: array<string>>>>>,"
    " properties struct<map: array<struct<key: string, value: string>>>"
)
VISIT_BEACON = (
    "dt date, visit_id string, beacon struct<event_name: string, timestamp: timestamp,"
    " properties: struct<key_value: array<struct<key: string, value: string>>>>"
)
LOG = (
    "queryTime timestamp, request struct<query: string, sortBy: string, sortOrder: string,"
    " offset: bigint, options: struct<searchPlacement: string, queryType: string,"
    " cacheBucketId: string, organicOnly: boolean, signedInUser: boolean,"
    " behavior: struct<matching: string, ranking: string, marketOptimization: string>,"
    " personalizationOptions: struct<userId: bigint>>>,"
    " OrganicRequestMetadata struct<candidateSources: array<struct<stage: string, source: string,"
    " interleavedBehavior: string, listingIds: array<bigint>>>>,"
    " RequestIdentifiers struct<requestUUID: string>"
)
SEARCH = "_date date, request_uuid string, ab_flag string, visit_id string, query string"
AB_TEST = "_date date, visit_id string, ab_test string, ab_variant string"
VISIT = "_date date, visit_id string, platform string"
LABELS = {step.name: (step.stage, step.source) for step in STEPS}
MONDAY = date(2024, 3, 4)
TUESDAY = date(2024, 3, 5)
FLAG = "exp.one"


def moment(day: date, minute: int = 0) -> datetime:
    return datetime(day.year, day.month, day.day) + timedelta(hours=12, minutes=minute)


def entry(step: str, ids, mixed: str | None = None):
    return (*LABELS[step], mixed, ids)


def log(
    uuid,
    entries,
    day=MONDAY,
    minute=0,
    query="ring",
    placement="web",
    sort_by="relevance",
    sort_order="desc",
    offset=0,
    query_type="main",
    bucket="live",
    organic=True,
    signed_in=False,
    behavior=("m", "r", "o"),
    user=1,
):
    options = (placement, query_type, bucket, organic, signed_in, behavior, (user,))
    request = (query, sort_by, sort_order, offset, options)
    return (moment(day, minute), request, (entries,), (uuid,))


def beacon(uuid, variants, event="search", day=MONDAY, flag=FLAG):
    flags = [("other", (["x"],)), (flag, (variants,))]
    return (day, event, (flags,), ([("page", "p"), ("request_uuid", uuid)],))


def visit_beacon(visit, uuid, query, event="search", day=MONDAY):
    pairs = [("request_uuid", uuid), ("ranking_variant", "v")]
    if query is not None:
        pairs.append(("query", query))
    return (day, visit, (event, moment(day), (pairs,)))


def flat_logs(spark, rows):
    """Request id, query, time and candidates of hand-written log rows."""
    from rankloom.operators.logs import request_fields

    return request_fields(spark.createDataFrame(rows, LOG))


def as_set(frame, *columns):
    rows = [tuple(row) for row in (frame.select(*columns) if columns else frame).collect()]
    assert len(rows) == len(set(rows)), "repeated rows"
    return set(rows)


def as_list(frame, *columns):
    rows = [tuple(row) for row in (frame.select(*columns) if columns else frame).collect()]
    return sorted(rows, key=str)
