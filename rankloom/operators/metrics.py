"""Which retrieval sources fill the result pages."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions import page_flag, ratio, source_mask
from rankloom.operators.distinct import SKETCH_POWER
from rankloom.operators.joins import spread_join
from rankloom.params import PAGE_SIZES, QUICKLOOK_PAGE_SIZE, RANK_CAP, REPORT_PAGES
from rankloom.sources import on_dates

# Report column of every presence mask (solr 1, nir 2, xwalk 4, xml 8).
SHARES = {
    "solr_only": 1,
    "nir_only": 2,
    "xwalk_only": 4,
    "xml_only": 8,
    "solr_nir": 3,
    "solr_xwalk": 5,
    "solr_xml": 9,
    "nir_xwalk": 6,
    "nir_xml": 10,
    "xwalk_xml": 12,
    "solr_nir_xwalk": 7,
    "solr_nir_xml": 11,
    "solr_xwalk_xml": 13,
    "nir_xwalk_xml": 14,
    "solr_nir_xwalk_xml": 15,
    "other": 0,
}
# Rows of one visit in the rank table that a task joins with the visit's facts.
HEAVY_LISTINGS = 2_000_000
# Searches of one visit, or visits of one request, that a task joins.
HEAVY_SEARCHES = 200_000
# Label of every report block and the prefix of its counters here.
BLOCKS = {"First Page": "p1", "Three Pages": "p3", "1K": "k1"}


def visit_facts(
    ab_tests: DataFrame, visits: DataFrame, flag: str, dates: Sequence[date]
) -> DataFrame:
    """Variant and platform of the visits assigned to ``flag`` on the listed dates.

    A visit present on two listed dates in either table has two rows.
    """
    assigned = on_dates(ab_tests, dates, "_date").filter(F.col("ab_test") == flag)
    seen = on_dates(visits, dates, "_date").select("visit_id", "platform")
    return assigned.select("visit_id", "ab_variant").join(seen, "visit_id")


def with_page_flags(
    rows: DataFrame, page_sizes: dict[str, int] = PAGE_SIZES, pages: int = REPORT_PAGES
) -> DataFrame:
    return rows.withColumns(
        {
            "page_1_flag": page_flag("mo_last", "platform", page_sizes),
            "top_3_flag": page_flag("mo_last", "platform", page_sizes, pages),
        }
    )


def page_flags(
    stage_ranks: DataFrame,
    ab_tests: DataFrame,
    visits: DataFrame,
    flag: str,
    dates: Sequence[date],
    page_sizes: dict[str, int] = PAGE_SIZES,
    pages: int = REPORT_PAGES,
) -> DataFrame:
    """The rank table with variant, platform and page flags of its visits.

    The two small tables are joined first, so the large one meets a single join.
    """
    return flag_pages(stage_ranks, visit_facts(ab_tests, visits, flag, dates), page_sizes, pages)


def flag_pages(
    stage_ranks: DataFrame,
    facts: DataFrame,
    page_sizes: dict[str, int] = PAGE_SIZES,
    pages: int = REPORT_PAGES,
) -> DataFrame:
    """The rank table with the variant and platform in ``facts`` and the page flags."""
    joined = spread_join(stage_ranks, facts, ["visit_id"], HEAVY_LISTINGS)
    return with_page_flags(
        joined.select(*stage_ranks.columns, "ab_variant", "platform"), page_sizes, pages
    )


def block_counts(flagged: DataFrame, keys: Sequence[str], top: int = RANK_CAP) -> DataFrame:
    """For each key and source combination: all rows, and the rows in scope of each block."""
    scopes = {"p1": "page_1_flag = 1", "p3": "top_3_flag = 1", "k1": f"mo_last <= {top}"}
    counters = [F.count_if(F.expr(scope)).alias(block) for block, scope in scopes.items()]
    masked = flagged.withColumn("mask", source_mask())
    return masked.groupBy(*keys, "mask").agg(F.count("*").alias("listing_count"), *counters)


def platform_counts(
    ranks: DataFrame,
    keys: Sequence[str],
    page_sizes: dict[str, int] = PAGE_SIZES,
    pages: int = REPORT_PAGES,
    top: int = RANK_CAP,
) -> DataFrame:
    """``block_counts`` for every kind of platform, the empty text for one without known pages.

    A listing is read once: each page size has counters of its own, which become rows only after
    the aggregation, at most 16 for a request and platform.
    """
    counters = [F.count("*").alias("listing_count"), F.count_if(F.col("mo_last") <= top).alias("k1")]
    kinds = [
        F.struct(F.lit("").alias("platform"), F.lit(0).alias("p1"), F.lit(0).alias("p3"))
    ]
    for n, (platform, size) in enumerate(page_sizes.items()):
        counters.append(F.count_if(F.col("mo_last") <= size).alias(f"p1_{n}"))
        counters.append(F.count_if(F.col("mo_last") <= size * pages).alias(f"p3_{n}"))
        kinds.append(
            F.struct(
                F.lit(platform).alias("platform"),
                F.col(f"p1_{n}").alias("p1"),
                F.col(f"p3_{n}").alias("p3"),
            )
        )
    kinds[0] = kinds[0].cast("struct<platform:string,p1:bigint,p3:bigint>")
    counts = ranks.withColumn("mask", source_mask()).groupBy(*keys, "mask").agg(*counters)
    return counts.select(*keys, "mask", "listing_count", "k1", F.inline(F.array(*kinds)))


def variant_totals(counts: DataFrame, pairs: DataFrame, approximate: bool = False) -> DataFrame:
    """``counts`` added up by variant, with the distinct visits and requests of ``pairs``.

    Sums are taken by combination, which leaves 16 rows for a variant. Distinct counts run over
    bare ids, so no wide row is multiplied for them. Both are then laid side by side. With
    ``approximate`` the ids go into sketches in each task, and no id is shuffled.
    """
    added = ["listing_count", *BLOCKS.values()]
    sums = counts.groupBy("ab_variant", "mask").agg(*[F.sum(name).alias(name) for name in added])
    if approximate:
        distinct = pairs.groupBy("ab_variant").agg(
            *[
                F.hll_sketch_estimate(F.hll_sketch_agg(column, SKETCH_POWER)).alias(name)
                for column, name in (("visit_id", "visit_count"), ("request_uuid", "request_count"))
            ]
        )
    else:
        ids = pairs.select("ab_variant", "visit_id", "request_uuid").distinct()
        distinct = ids.groupBy("ab_variant").agg(
            F.countDistinct("visit_id").alias("visit_count"),
            F.countDistinct("request_uuid").alias("request_count"),
        )
    both = sums.unionByName(distinct, allowMissingColumns=True)
    shares = [
        F.expr(f"coalesce(sum({block}) FILTER (WHERE mask = {mask}), 0) AS {block}_{share}")
        for block in BLOCKS.values()
        for share, mask in SHARES.items()
    ]
    single = ["visit_count", "request_count", "listing_count"]
    return both.groupBy("ab_variant").agg(*[F.sum(name).alias(name) for name in single], *shares)


def report_blocks(totals: DataFrame, strict: bool = False) -> DataFrame:
    """One row for each block of each variant."""
    blocks = []
    for label, block in BLOCKS.items():
        counted = ", ".join(f"{block}_{share} AS {share}" for share in SHARES)
        # The combinations cover every row, so together they are the rows in scope.
        whole = " + ".join(f"{block}_{share}" for share in SHARES)
        blocks.append(f"struct('{label}' AS metric, {whole} AS whole, {counted})")
    counts = ["visit_count", "request_count", "listing_count"]
    stacked = totals.select(
        "ab_variant", *counts, F.expr(f"inline(array({', '.join(blocks)}))")
    )
    shares = [ratio(F.col(share), F.col("whole"), strict).alias(share) for share in SHARES]
    return stacked.select("metric", "ab_variant", *counts, *shares)


def retrieval_report(
    base: DataFrame, top: int = RANK_CAP, strict: bool = False, approximate: bool = False
) -> DataFrame:
    """Three blocks for each variant: first page, first three pages, top 1000.

    Shares are of the rows in scope of the block; the three counts are of all rows of the variant
    and so alike in its blocks. All blocks come from one pass: rows are first counted for each
    visit, request and source combination, and everything else is taken from those few. With
    ``approximate`` visits and requests are estimated by sketches; off by default.
    """
    counts = block_counts(base, ["ab_variant", "visit_id", "request_uuid"], top)
    # True for every row. It keeps the counters in the plan of the ids, so that Spark sees one
    # exchange for both and reads the table once.
    pairs = counts.filter(" + ".join(["listing_count", *BLOCKS.values()]) + " > 0")
    return report_blocks(variant_totals(counts, pairs, approximate), strict)


def short_report(report: DataFrame) -> DataFrame:
    """The report without ``other``, under the column names of its first block."""
    shares = [F.col(s).alias(f"{s}_first_page_share") for s in SHARES if s != "other"]
    counts = ["visit_count", "request_count", "listing_count"]
    return report.select("metric", "ab_variant", *counts, *shares)


def retrieval_report_15(base: DataFrame, top: int = RANK_CAP, strict: bool = False) -> DataFrame:
    """The report in its short form."""
    return short_report(retrieval_report(base, top, strict))


def retrieval_report_by_request(
    ranks: DataFrame,
    ranked: DataFrame,
    searches: DataFrame,
    facts: DataFrame,
    keys: Sequence[str] = ("request_uuid",),
    page_sizes: dict[str, int] = PAGE_SIZES,
    pages: int = REPORT_PAGES,
    top: int = RANK_CAP,
    strict: bool = False,
) -> DataFrame:
    """The report over ranks by request, searches and visit facts, without the joined rank table.

    ``ranked`` has the keys of all requests in ``ranks``, once each. Every row of ``searches``
    counts, repeats as well.

    Listings are counted within their request, and searches are counted for each request, variant
    and platform before the two meet: a request or visit that holds a large part of the searches
    is cut into slices or counted beforehand.
    """
    counts = platform_counts(ranks, list(keys), page_sizes, pages, top)
    return report_from_counts(counts, ranked, searches, facts, keys, page_sizes, strict)


def report_from_counts(
    counts: DataFrame,
    ranked: DataFrame,
    searches: DataFrame,
    facts: DataFrame,
    keys: Sequence[str] = ("request_uuid",),
    page_sizes: dict[str, int] = PAGE_SIZES,
    strict: bool = False,
) -> DataFrame:
    """The report over ``platform_counts`` of requests, which may have been stored by date.

    ``counts`` holds each request (and date, if that is a key) once for each platform and source
    combination; counts of other dates are added by a union.
    """
    keys = list(keys)
    # Platforms without known pages are alike: the empty text stands for them.
    known = F.when(F.col("platform").isin(list(page_sizes)), F.col("platform"))
    seen = spread_join(searches, facts, ["visit_id"], HEAVY_SEARCHES)
    seen = seen.withColumn("platform", F.coalesce(known, F.lit("")))
    asked = seen.groupBy(*keys, "ab_variant", "platform").agg(F.count("*").alias("_times"))
    added = ["listing_count", *BLOCKS.values()]
    met = asked.join(counts, [*keys, "platform"]).select(
        "ab_variant", "mask", *[(F.col(name) * F.col("_times")).alias(name) for name in added]
    )
    pairs = spread_join(
        seen.select(*keys, "ab_variant", "visit_id").distinct(), ranked, keys, HEAVY_SEARCHES
    )
    return report_blocks(variant_totals(met, pairs), strict)


def _first_page_metrics(page_size: int, strict: bool) -> list:
    on_page = F.col("mo_last") <= page_size
    whole = F.count_if(on_page)
    shares = [
        ratio(F.count_if(on_page & F.col(source).isNotNull()), whole, strict).alias(
            f"{source}_first_page_share"
        )
        for source in ("solr", "nir", "xwalk")
    ]
    labels = {"borda": "borda", "ranking": "ranking", "mo_last": "mo"}
    means = [
        F.avg(F.when(on_page, F.col(step))).alias(f"{label}_avg_first_page_rank")
        for step, label in labels.items()
    ]
    return shares + means


def first_page_overall(
    stage_ranks: DataFrame, page_size: int = QUICKLOOK_PAGE_SIZE, strict: bool = False
) -> DataFrame:
    """Share of each source on the first page (sources overlap) and mean rank at three steps."""
    return stage_ranks.agg(*_first_page_metrics(page_size, strict))


def first_page_by_query(
    stage_ranks: DataFrame, page_size: int = QUICKLOOK_PAGE_SIZE, strict: bool = False
) -> DataFrame:
    """The same for each query text; a NULL text is a group."""
    return stage_ranks.groupBy("query").agg(*_first_page_metrics(page_size, strict))
