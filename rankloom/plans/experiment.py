"""From an experiment flag to the retrieval report or the first-page quick look."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame

from rankloom.operators.metrics import (
    first_page_by_query,
    first_page_overall,
    flag_pages,
    platform_counts,
    report_from_counts,
    retrieval_report,
    retrieval_report_by_request,
    visit_facts,
)
from rankloom.operators.ranks import (
    rank_order,
    ranked_requests,
    request_ranks,
    sampled_candidates,
    search_rows,
    stage_ranks_pivot,
)
from rankloom.operators.sampling import experiment_sample
from rankloom.operators.searches import sample_searches
from rankloom.params import ExperimentParams
from rankloom.session import require_utc
from rankloom.sources import TableStore


@dataclass(frozen=True)
class Sources:
    """The tables an experiment is read from; the quick look needs the first three."""

    beacons: DataFrame
    visit_beacons: DataFrame
    rpc_logs: DataFrame
    ab_tests: DataFrame | None = None
    visits: DataFrame | None = None


def _stored(store: TableStore | None, name: str, rows: DataFrame) -> DataFrame:
    return rows if store is None else store.replace(name, rows)


def experiment_searches(
    sources: Sources, params: ExperimentParams, store: TableStore | None = None
) -> DataFrame:
    """Sample requests of the experiment and find their searches.

    With a store the sample and the searches become tables, and later steps read those.
    """
    sample = experiment_sample(
        sources.beacons,
        params.flag,
        params.dates,
        params.sample_size,
        params.seed,
        params.sample_event,
        params.strict,
    )
    sample = _stored(store, "uuids_sample", sample)
    searches = sample_searches(
        sample,
        sources.visit_beacons,
        params.dates,
        params.search_event,
        params.sample_size,
        params.strict,
    )
    return _stored(store, "searches", searches)


def rank_table(
    sources: Sources, params: ExperimentParams, store: TableStore | None = None
) -> DataFrame:
    """The rank table of the sampled requests."""
    require_utc(sources.rpc_logs.sparkSession)
    ranks = stage_ranks_pivot(
        experiment_searches(sources, params, store),
        sources.rpc_logs,
        params.dates,
        params.placement,
        params.cap,
        params.match_date,
        params.sample_size,
        params.rank_scope,
        params.repeats,
    )
    return ranks if store is None else store.replace("stage_ranks", ranks, "_date")


def store_sorted_ranks(
    ranks: DataFrame, store: TableStore, then: Sequence[str] = ("request_uuid", "listing_id")
) -> DataFrame:
    """Write a rank table as ``stage_ranks_sorted``, by query and then by the steps from last to first.

    Rows of equal ranks are in the order of ``then``, as far as the table has these columns. The
    result is the stored table in its order; ``TableStore.sorted_table`` gives it again later.
    """
    ties = [name for name in then if name in ranks.columns]
    store.replace_sorted("stage_ranks_sorted", ranks, *rank_order(), *ties)
    return store.sorted_table("stage_ranks_sorted")


def experiment_report(
    sources: Sources, params: ExperimentParams, store: TableStore | None = None
) -> DataFrame:
    """Retrieval report of an experiment: 21 columns, three rows for each variant.

    The report counts places on pages, so ranks within a query are refused. With a store the rank
    table is written (``stage_ranks``, which ``page_flags``, the reports and ``request_to_visit``
    read) and reported on; without one listings are counted within their request, and the rank
    table of all searches is never built.
    """
    if params.rank_scope != "request":
        raise ValueError("the report needs ranks within a request")
    require_utc(sources.rpc_logs.sparkSession)
    facts = visit_facts(sources.ab_tests, sources.visits, params.flag, params.dates)
    if store is not None:
        flagged = flag_pages(
            rank_table(sources, params, store), facts, params.page_sizes, params.pages
        )
        report = retrieval_report(flagged, params.cap, params.strict)
        return store.replace("retrieval_metrics", report)
    searches = experiment_searches(sources, params)
    rows = sampled_candidates(
        searches,
        sources.rpc_logs,
        params.dates,
        params.placement,
        params.cap,
        params.match_date,
        params.sample_size,
        params.repeats,
    )
    keys = ["request_uuid", "_date"] if params.match_date else ["request_uuid"]
    return retrieval_report_by_request(
        request_ranks(rows, keys, params.cap, params.repeats),
        ranked_requests(rows, keys),
        search_rows(searches, params.repeats),
        facts,
        keys,
        params.page_sizes,
        params.pages,
        params.cap,
        params.strict,
    )


def experiment_report_by_date(
    sources: Sources, params: ExperimentParams, store: TableStore
) -> DataFrame:
    """The report over counts that are stored for each date, so that a further date reads its own logs only.

    For each date there are four tables: its searches, their log rows, the requests that have ranks,
    and their listings counted by platform and source combination, which add up. The log rows are
    stored because two tables are made of them: so the logs are read once. Dates whose tables are in
    the store are not read again; visits and assignments of all dates are. Log rows must serve
    searches of their own day (``match_date``) and every request must be taken (no sample size), for
    otherwise a further date changes the counts of earlier ones. A request is sampled by the beacons
    of the date it is searched on.
    """
    if params.rank_scope != "request" or not params.match_date or params.sample_size is not None:
        raise ValueError("counts by date need ranks within a request, match_date and no sample size")
    require_utc(sources.rpc_logs.sparkSession)
    keys = ["request_uuid", "_date"]
    tables = []
    for day in params.dates:
        names = [f"{name}_{day:%Y%m%d}" for name in ("searches", "ranked", "counts", "log_rows")]
        if not store.has(names[2]):
            one = replace(params, dates=(day,))
            searches = store.replace(names[0], experiment_searches(sources, one))
            rows = sampled_candidates(
                searches, sources.rpc_logs, one.dates, one.placement, one.cap, True, None, one.repeats
            )
            rows = store.replace(names[3], rows)
            store.replace(names[1], ranked_requests(rows, keys))
            ranks = request_ranks(rows, keys, one.cap, one.repeats)
            counts = platform_counts(ranks, keys, one.page_sizes, one.pages, one.cap)
            # The table that says that the date is complete comes last.
            store.replace(names[2], counts)
        tables.append([store.table(name) for name in names[:3]])
    searches, ranked, counts = (reduce(DataFrame.unionByName, part) for part in zip(*tables))
    facts = visit_facts(sources.ab_tests, sources.visits, params.flag, params.dates)
    seen = search_rows(searches, params.repeats)
    return report_from_counts(counts, ranked, seen, facts, keys, params.page_sizes, params.strict)


def experiment_quicklook(
    sources: Sources, params: ExperimentParams, store: TableStore | None = None
) -> tuple[DataFrame, DataFrame]:
    """First-page metrics of the sampled requests: overall, and for each query."""
    ranks = rank_table(sources, params, store)
    return (
        first_page_overall(ranks, params.first_page, params.strict),
        first_page_by_query(ranks, params.first_page, params.strict),
    )
