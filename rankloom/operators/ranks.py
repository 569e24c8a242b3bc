"""Rank of every candidate listing at every ranking step.

The position in a candidate list is the rank, and ranks run on over the log rows of a request.
Only the sizes of lists are summed for that; the ranks of a listing are then brought together by
one aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import partial, reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.operators.joins import spread_join
from rankloom.operators.logs import HEAVY_LOGS, sampled_logs
from rankloom.params import ALL, MIXED, QUICKLOOK_SCOPES, RANK_CAP, REPEATS, require_one_of


class Step(NamedTuple):
    name: str
    stage: str
    source: str | None


# The ranking steps and the (stage, source) labels they carry in the logs.
STEPS = (
    Step("solr", "POST_FILTER", "SOLR"),
    Step("nir", "POST_FILTER", "ANN"),
    Step("xwalk", "POST_FILTER", "XWALK"),
    Step("xml", "POST_FILTER", "XML"),
    Step("borda", "POST_BORDA", None),
    Step("ranking", "RANKING", None),
    Step("mo_list", "MO_LISTWISE", None),
    Step("mo_last", "MO_LASTPASS", None),
)
STEP_NAMES = tuple(step.name for step in STEPS)
# The step that decides what the user saw.
FINAL = "mo_last"
# Hex digits of a digest that tell the parts of a rank scope.
PREFIX_DIGITS = 3
# Searches of one request that a task joins with the request's listings.
HEAVY_SEARCHES = 20_000
# Order of the stored rank table after the query text, the last step first.
SORT_STEPS = ("mo_last", "mo_list", "ranking", "borda", "solr", "nir", "xwalk", "xml")


def is_step(step: Step, stage: Column, source: Column) -> Column:
    """Whether an entry belongs to ``step``; merged steps carry a NULL source."""
    labelled = source.isNull() if step.source is None else source == step.source
    return (stage == step.stage) & labelled


def step_name(stage: Column, source: Column) -> Column:
    """Name of the step of an entry, NULL when it belongs to none."""
    return F.coalesce(*[F.when(is_step(s, stage, source), F.lit(s.name)) for s in STEPS])


def organic_entries(entries: str | Column) -> Column:
    """The entries of a candidate array that were not interleaved."""
    return F.filter(entries, lambda entry: entry["interleavedBehavior"].isNull())


def candidate_entries(logs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row for each organic entry, with its place in the log row."""
    kept = [F.col(name) for name in keep]
    placed = logs.select(*kept, F.posexplode(organic_entries("candidateSources")))
    return placed.select(
        *kept,
        F.col("pos").alias("entry_pos"),
        F.col("col.stage").alias("stage"),
        F.col("col.source").alias("source"),
        F.col("col.listingIds").alias("listingIds"),
    )


def trimmed_candidates(entries: str | Column, cap: int) -> Column:
    """The entries that take part in some step, each cut to its first ``cap`` listings."""
    used = F.filter(
        organic_entries(entries), lambda e: step_name(e["stage"], e["source"]).isNotNull()
    )
    return F.transform(
        used,
        lambda e: F.struct(
            e["stage"].alias("stage"),
            e["source"].alias("source"),
            e["interleavedBehavior"].alias("interleavedBehavior"),
            F.slice(e["listingIds"], 1, cap).alias("listingIds"),
        ),
    )


def step_ids(entries: str | Column, step: Step, cap: int | None = None) -> Column:
    """Listing ids of one step in rank order, its entries one after the other."""
    mine = F.filter(
        entries,
        lambda e: e["interleavedBehavior"].isNull() & is_step(step, e["stage"], e["source"]),
    )
    none = F.array().cast("array<bigint>")
    ids = F.flatten(F.transform(mine, lambda e: F.coalesce(e["listingIds"], none)))
    return ids if cap is None else F.slice(ids, 1, cap)


def step_lists(
    logs: DataFrame,
    keep: Sequence[str],
    cap: int | None = None,
    steps: Sequence[str] = STEP_NAMES,
) -> DataFrame:
    """One row for each log row and step: ``step`` and its ``ids``, cut to ``cap``."""
    lists = [
        F.struct(F.lit(s.name).alias("step"), step_ids("candidateSources", s, cap).alias("ids"))
        for s in STEPS
        if s.name in steps
    ]
    kept = [F.col(name) for name in keep]
    exploded = logs.select(*kept, F.explode(F.array(*lists)).alias("list"))
    return exploded.select(*kept, "list.step", "list.ids")


def listing_ranks(logs: DataFrame, keys: Sequence[str], cap: int | None = RANK_CAP) -> DataFrame:
    """Ranks within each log row: ``keys``, ``step``, ``listing_id``, ``rank``.

    ``logs`` holds one row for each key. Lists are cut before they are unnested.
    """
    kept = [F.col(name) for name in keys]
    placed = step_lists(logs, keys, cap).select(*kept, "step", F.posexplode("ids"))
    return placed.select(
        *kept,
        "step",
        F.col("col").alias("listing_id"),
        (F.col("pos") + 1).cast("bigint").alias("rank"),
    )


def running_ranks(
    logs: DataFrame,
    scope: str | Sequence[str],
    keys: Sequence[str],
    cap: int | None = RANK_CAP,
    by_time: bool = False,
    gather: bool = False,
    steps: Sequence[str] = STEP_NAMES,
) -> DataFrame:
    """Ranks that run on over all log rows with the same ``scope`` value.

    The rows of a scope follow each other by the digest of their ``keys``, or by log time with
    ``by_time``; rows of one key follow each other by log time, then by content. Only list sizes
    are summed, never listings counted, first within a part of the scope (a digest prefix, or a
    minute) and then over the parts. So a scope that holds a large part of the log is spread over
    many tasks, and no task sums over more than 4,096 prefixes or the minutes of the days at hand.
    With a ``cap`` each task sends ``cap`` lists of a scope, step and part at most.
    ``gather`` brings the lists of a key together before they are unnested, for ``pivot_ranks``.
    """
    scopes = [scope] if isinstance(scope, str) else list(scope)
    columns = list(dict.fromkeys([*scopes, *keys]))
    kept = [F.col(name) for name in columns]
    text = F.concat_ws("|", *[F.col(key).cast("string") for key in keys])
    place = F.date_format("query_time", "yyyyMMddHHmm") if by_time else F.md5(text)
    placed_logs = logs.withColumns(
        {
            "_place": place,
            "_prefix": place if by_time else F.substring(place, 1, PREFIX_DIGITS),
            "_content": F.xxhash64("candidateSources"),
        }
    )
    # A struct with a NULL field equals another such struct, so a NULL scope joins with itself.
    lists = (
        step_lists(placed_logs, [*columns, "_place", "_prefix", "_content", "query_time"], cap, steps)
        .withColumn("_n", F.size("ids").cast("bigint"))
        .filter("_n > 0")
        .withColumn("_scope", F.struct(*scopes))
        .withColumn("_prefix", F.coalesce("_prefix", F.lit("")))
    )
    parts = ["_scope", "step", "_prefix"]
    prefixes = Window.partitionBy("_scope", "step").orderBy("_prefix")
    earlier = prefixes.rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        lists.groupBy(*parts)
        .agg(F.sum("_n").alias("_size"))
        .withColumn("_start", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
        .drop("_size")
    )
    if cap is not None:
        starts = starts.filter(F.col("_start") < cap)
    ordered = ["query_time", "_content", *keys] if by_time else ["_place", *keys, "query_time", "_content"]
    order = Window.partitionBy(*parts).orderBy(*ordered)
    if cap is not None:
        # A list that is not empty moves the rank by one at least, so lists after the first ``cap``
        # of a part cannot count. Spark drops them in each task, before they travel.
        nth = F.row_number().over(order)
        lists = lists.withColumn("_nth", nth).filter(F.col("_nth") <= cap).drop("_nth")
    ahead = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = lists.join(starts, parts).withColumn(
        "_offset", F.col("_start") + F.coalesce(ahead, F.lit(0))
    )
    ids = F.col("ids")
    if cap is not None:
        placed = placed.filter(F.col("_offset") < cap)
        ids = F.slice(ids, F.lit(1), (F.lit(cap) - F.col("_offset")).cast("int"))
    placed = placed.select(*kept, "step", "_offset", ids.alias("ids"))
    if gather:
        placed = placed.repartition(*keys)
    return placed.select(*kept, "step", "_offset", F.posexplode("ids")).select(
        *kept,
        "step",
        F.col("col").alias("listing_id"),
        (F.col("_offset") + F.col("pos") + 1).alias("rank"),
    )


def mixed_ranks(logs: DataFrame, keys: Sequence[str], cap: int | None = RANK_CAP) -> DataFrame:
    """Ranks of the first step within each of ``keys``, of all other steps within ``query``."""
    first, others = STEP_NAMES[:1], STEP_NAMES[1:]
    own = running_ranks(logs, keys, keys, cap, by_time=True, steps=first)
    shared = running_ranks(logs, "query", keys, cap, steps=others)
    return own.unionByName(shared.select(*own.columns))


def pivot_ranks(ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each listing of the final step, with its rank at every step.

    A listing that occurs twice in a step has its smallest rank.
    """
    ranks = [F.min(F.when(F.col("step") == name, F.col("rank"))).alias(name) for name in STEP_NAMES]
    return ranked.groupBy(*keys, "listing_id").agg(*ranks).filter(F.col(FINAL).isNotNull())


def sampled_candidates(
    searches: DataFrame,
    logs: DataFrame,
    dates: Sequence[date],
    placement: str,
    cap: int = RANK_CAP,
    match_date: bool = False,
    max_requests: int | None = None,
    repeats: str = ALL,
) -> DataFrame:
    """The log rows of the searched requests, their candidates cut to what can be ranked."""
    trim = partial(trimmed_candidates, cap=cap)
    return sampled_logs(searches, logs, dates, placement, match_date, max_requests, trim, repeats)


def request_ranks(
    rows: DataFrame, keys: Sequence[str], cap: int = RANK_CAP, repeats: str = ALL
) -> DataFrame:
    """The rank table of requests, without visit or query.

    With ``all`` repeats ranks run on over the log rows of a request in the order of their time.
    With ``first`` there must be one row for each request.
    """
    if repeats == ALL:
        return pivot_ranks(running_ranks(rows, keys, keys, cap, True, True), keys)
    return pivot_ranks(listing_ranks(rows, keys, cap), keys)


def ranked_requests(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of the requests that have any rank, known from the length of the final list."""
    final = next(step for step in STEPS if step.name == FINAL)
    listed = rows.filter(F.size(step_ids("candidateSources", final)) > 0)
    return listed.select(*keys).distinct()


def search_rows(searches: DataFrame, repeats: str) -> DataFrame:
    """Every search, or each distinct one with ``first``."""
    return searches if repeats == ALL else searches.distinct()


def stage_ranks_pivot(
    searches: DataFrame,
    logs: DataFrame,
    dates: Sequence[date],
    placement: str,
    cap: int = RANK_CAP,
    match_date: bool = False,
    max_requests: int | None = None,
    rank_scope: str = "request",
    repeats: str = ALL,
) -> DataFrame:
    """The rank table: one row for each search and final listing.

    Ranks are built for each request before searches are joined, so two visits of one request
    have two rows for a listing, both with its true rank. With the rank scope ``query`` ranks run
    on over the requests of a query and are no longer places on a page; with ``mixed`` those of the
    first step stay within the request. With ``all`` repeats every
    log row and every search beacon counts; with ``first`` the earliest log row of a request and
    distinct searches. Another scope or kind of repeats is an error.
    """
    require_one_of("rank_scope", rank_scope, QUICKLOOK_SCOPES)
    require_one_of("repeats", repeats, REPEATS)
    keys = ["request_uuid", "_date"] if match_date else ["request_uuid"]
    rows = sampled_candidates(
        searches, logs, dates, placement, cap, match_date, max_requests, repeats
    )
    columns = ["_date", "request_uuid", "ab_flag", "visit_id", "query", "listing_id", *STEP_NAMES]
    seen = search_rows(searches, repeats)
    if rank_scope != "request":
        asked = searches.select(*keys, "query").distinct()
        rows = spread_join(rows, asked, keys, HEAVY_LOGS)
        keys = [*keys, "query"]
        if rank_scope == MIXED:
            ranked = mixed_ranks(rows, keys, cap)
        else:
            ranked = running_ranks(rows, "query", keys, cap, gather=True)
        ranks = pivot_ranks(ranked, keys)
        return spread_join(seen, ranks, keys, HEAVY_SEARCHES).select(*columns)

    def ranks_of(only: DataFrame | None) -> DataFrame:
        """Ranks of all requests, or of a few: then only their log rows are unnested."""
        mine = rows if only is None else rows.join(only, keys, "left_semi")
        return request_ranks(mine, keys, cap, repeats)

    return spread_join(seen, ranks_of, keys, HEAVY_SEARCHES).select(*columns)


def ranked_candidates(
    logs: DataFrame,
    keep: Sequence[str],
    scope: str = "request_uuid",
    order: Sequence[str] = ("query_time", "visit_id"),
    cap: int = RANK_CAP,
) -> DataFrame:
    """Ranks by a window over ``scope`` and step, over every copy of every entry.

    Copies of a request (two visits, two log rows) are numbered one after the other. Entries are
    cut to the cap and limited before they are unnested, and each task does so before the exchange:
    it sorts entries, not listings, and sends ``cap`` of them at most for a scope and step.
    """
    entries = candidate_entries(logs, list(dict.fromkeys([*keep, scope, *order])))
    entries = entries.withColumn("step", step_name(F.col("stage"), F.col("source")))
    entries = entries.filter(F.col("step").isNotNull() & (F.size("listingIds") > 0))
    entries = entries.withColumn("listingIds", F.slice("listingIds", 1, cap))
    # Each of the first ``cap`` entries has a listing before all listings of a later entry. Of entries
    # in the same place the one with the smaller first listing is earlier, as in the window below.
    nth = F.row_number().over(
        Window.partitionBy(scope, "step").orderBy(*order, "entry_pos", "listingIds")
    )
    entries = entries.withColumn("_nth", nth).filter(F.col("_nth") <= cap).drop("_nth")
    listed = entries.select("*", F.posexplode("listingIds"))
    window = Window.partitionBy(scope, "step").orderBy(*order, "entry_pos", "pos", "col")
    ranked = listed.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= cap)
    return ranked.select(
        *keep, "step", F.col("col").alias("listing_id"), F.col("rank").cast("bigint")
    )


def stage_ranks_weighted(ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The chain of left joins over distinct rows: each with ``copies``, how often it stands there.

    Equal (key, listing, rank) rows of a step are counted before the joins and their counts are
    multiplied along the chain, so no intermediate holds a row twice. What is summed over the rank
    table can be summed over these rows times ``copies``. A missing rank counts as one copy.
    """
    on = [*keys, "listing_id"]
    rest = [name for name in ranked.columns if name not in (*on, "step", "rank")]

    def relation(name: str, kept: Sequence[str]) -> DataFrame:
        mine = ranked.filter(F.col("step") == name)
        counted = mine.groupBy(*on, *kept, F.col("rank").alias(name))
        return counted.agg(F.count("*").alias(f"_{name}"))

    wide = relation(FINAL, rest)
    for name in reversed(STEP_NAMES):
        if name != FINAL:
            wide = wide.join(relation(name, []), on, "left")
    copies = reduce(
        lambda a, b: a * b, [F.coalesce(F.col(f"_{name}"), F.lit(1)) for name in STEP_NAMES]
    )
    return wide.select(*keys, *rest, "listing_id", *STEP_NAMES, copies.alias("copies"))


def expand_copies(weighted: DataFrame) -> DataFrame:
    """Rows once for each copy; beyond 2^20 copies in portions, so that no array grows large."""
    portion = 1 << 20
    sizes = F.transform(
        F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / portion).cast("int")),
        lambda n: F.least(F.lit(portion).cast("bigint"), F.col("copies") - n * portion),
    )
    rest = [name for name in weighted.columns if name != "copies"]
    parts = weighted.select(*rest, F.explode(sizes).alias("_times"))
    once = F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))).alias("_once")
    return parts.select(*rest, once).drop("_once")


def stage_ranks_joined(ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rank table as a chain of left joins from the final step.

    Equal to ``pivot_ranks`` where every step lists a listing once per key. Otherwise each copy in
    one step meets each copy in the next, so prefer the pivot. The joins run over weighted rows.
    """
    return expand_copies(stage_ranks_weighted(ranked, keys))


def rank_order() -> list[Column]:
    """By query (NULLs first), then by the steps from last to first, missing ranks last."""
    steps = [F.col(name).asc_nulls_last() for name in SORT_STEPS]
    return [F.col("query").asc_nulls_first(), *steps]


def sort_stage_ranks(stage_ranks: DataFrame) -> DataFrame:
    """The rank table in its order (see ``rank_order``)."""
    return stage_ranks.orderBy(*rank_order())
