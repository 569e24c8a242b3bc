"""The derived relations in SQL, flat, for checking results on another engine."""

from __future__ import annotations

from checks.relations import (
    AS_OF,
    CAP,
    DAY,
    DAYS,
    EVENT,
    FIRST_PAGE,
    FLAG,
    LISTINGS,
    OTHER_FLAG,
    PAGE_SIZES,
    PLACEMENT,
)

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
STEP_NAMES = ("solr", "nir", "xwalk", "xml", "borda", "ranking", "mo_list", "mo_last")
IN_DAYS = "(" + ", ".join(f"DATE '{day}'" for day in DAYS) + ")"

_VARIANT = """CASE WHEN user_id % 10 = 9 THEN 'ineligible'
              WHEN user_id % 10 = 8 THEN NULL
              WHEN user_id % 2 = 0 THEN 'off' ELSE 'on' END"""

# Each relation may use the ones before it.
RELATIONS = {
    "steps": "SELECT * FROM (VALUES "
    + ", ".join(f"({i}, '{name}')" for i, name in enumerate(STEP_NAMES))
    + ") AS s(slot, step)",
    "cand": f"""
        SELECT o_custkey AS req, l_partkey % {LISTINGS} AS lid,
               (l_linenumber + l_suppkey) % {len(STEP_NAMES)} AS slot, min(l_extendedprice) AS p
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3""",
    "ranked": """
        SELECT req, lid, slot, n, row_number() OVER (PARTITION BY req, slot ORDER BY p DESC, lid) AS r
        FROM (SELECT *, count(*) OVER (PARTITION BY req, slot) AS n FROM cand) AS c""",
    "vdays": f"""
        SELECT *, day = min(day) OVER (PARTITION BY user_id) AS is_first
        FROM (SELECT user_id, CAST(ts AS DATE) AS day, min(ts) AS first_ts,
                     first(props ORDER BY ts, event_id) AS first_text
              FROM events WHERE event_type = '{EVENT}' GROUP BY 1, 2) AS v""",
    "logs": f"""
        SELECT c_custkey AS req, 'u' || c_custkey AS request_uuid,
               coalesce(first_ts, odate) AS query_time,
               CAST(coalesce(first_ts, odate) AS DATE) AS log_date,
               coalesce(first_text, c_mktsegment) AS query, coalesce(is_first, true) AS is_first,
               CASE WHEN c_nationkey < 20 THEN '{PLACEMENT}' ELSE 'app' END AS placement,
               CASE WHEN c_mktsegment = 'MACHINERY' THEN 'price' ELSE 'relevance' END AS sort_by,
               CASE WHEN c_nationkey = 3 THEN 'asc' ELSE 'desc' END AS sort_order,
               CASE WHEN c_acctbal < 0 THEN 48 ELSE 0 END AS first_item,
               CASE WHEN c_nationkey = 4 THEN 'broad' ELSE 'main' END AS query_type,
               CASE WHEN c_nationkey = 5 THEN 'test' ELSE 'live' END AS bucket,
               CASE WHEN c_nationkey <> 6 THEN c_nationkey <> 7 END AS organic,
               c_acctbal >= 2000 AS signed_in,
               CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS matching,
               lower(c_mktsegment) AS ranking_model,
               CASE WHEN c_nationkey < 10 THEN 'low' ELSE 'high' END AS market
        FROM customer
        JOIN (SELECT o_custkey, max(o_orderdate) AS odate FROM orders GROUP BY 1) AS o
          ON o_custkey = c_custkey
        LEFT JOIN vdays ON user_id = c_custkey
        WHERE c_custkey IN (SELECT req FROM cand)""",
    "log_ranks": """
        SELECT logs.*, lid, slot, step, CASE WHEN is_first THEN r ELSE n + 1 - r END AS rnk
        FROM logs JOIN ranked USING (req) JOIN steps USING (slot)""",
    "beacon": f"""
        SELECT *, CAST(ts AS DATE) AS dt, 'u' || user_id AS request_uuid, 'v' || event_id AS visit_id,
               {_VARIANT} AS variant, CASE WHEN value >= 2 THEN props END AS asked
        FROM events""",
    # A fifth of the beacons tied to visits was sent twice.
    "sent": "SELECT * FROM beacon UNION ALL SELECT * FROM beacon WHERE event_id % 5 = 0",
    "assigned": f"""
        SELECT dt AS _date, visit_id, '{FLAG}' AS ab_test, variant AS ab_variant FROM beacon
        UNION ALL
        SELECT dt, visit_id, '{OTHER_FLAG}', event_type FROM beacon""",
    "seen": """
        SELECT dt AS _date, visit_id, CASE event_id % 4 WHEN 0 THEN 'desktop'
               WHEN 1 THEN 'mobile_web' WHEN 2 THEN 'boe' ELSE 'tv' END AS platform
        FROM beacon""",
    "sessions": "SELECT dt AS _date, user_id AS visit_id, props AS query_raw FROM beacon",
    "all_sample": f"""
        SELECT DISTINCT request_uuid, '{FLAG}' AS ab_flag, variant AS ab_flag_variant
        FROM beacon
        WHERE dt IN {IN_DAYS} AND event_type = '{EVENT}' AND variant <> 'ineligible'""",
    "day_sample": f"""
        SELECT DISTINCT request_uuid, '{FLAG}' AS ab_flag, variant AS ab_flag_variant
        FROM beacon WHERE dt = DATE '{DAY}' AND variant <> 'ineligible'""",
    "all_searches": f"""
        SELECT dt AS _date, request_uuid, ab_flag, visit_id, asked AS query
        FROM sent JOIN all_sample USING (request_uuid)
        WHERE dt IN {IN_DAYS} AND event_type = '{EVENT}' AND asked IS NOT NULL""",
    "day_searches": f"""
        SELECT dt AS _date, request_uuid, ab_flag, visit_id, asked AS query
        FROM sent JOIN day_sample USING (request_uuid)
        WHERE dt = DATE '{DAY}' AND event_type = '{EVENT}' AND asked IS NOT NULL""",
    "kind_ranks": f"""
        SELECT * FROM log_ranks
        WHERE placement = '{PLACEMENT}' AND sort_by = 'relevance' AND sort_order = 'desc'""",
}


def running(source: str, scope: str = "request_uuid") -> str:
    """Ranks that run on over the log rows of a request in the order of their time."""
    return f"""SELECT * REPLACE (row_number() OVER (PARTITION BY {scope}, step
                                                    ORDER BY query_time, rnk) AS rnk)
               FROM {source}"""


# Every log row of a request, of the wanted kind on the listed days or on one day.
RELATIONS |= {
    "log_runs": running("log_ranks"),
    "kind_runs": running(f"(SELECT * FROM kind_ranks WHERE log_date IN {IN_DAYS}) AS k"),
    "day_runs": running(f"(SELECT * FROM kind_ranks WHERE log_date = DATE '{DAY}') AS k"),
}


def pivot(source: str, keys: str, cap: int = CAP) -> str:
    """Rank of each listing at each step, for listings of the last step."""
    ranks = ", ".join(
        f"min(rnk) FILTER (WHERE step = '{name}' AND rnk <= {cap}) AS {name}" for name in STEP_NAMES
    )
    return f"""SELECT {keys}, lid AS listing_id, {ranks} FROM {source}
               GROUP BY {keys}, lid HAVING min(rnk) FILTER (WHERE step = 'mo_last') <= {cap}"""


_LIMIT = " ".join(f"WHEN '{name}' THEN {size}" for name, size in PAGE_SIZES.items())
_COLUMNS = ", ".join(STEP_NAMES)

RELATIONS |= {
    "request_wide": pivot("kind_runs", "request_uuid"),
    "stage": f"""
        SELECT _date, request_uuid, ab_flag, visit_id, query, listing_id, {_COLUMNS}
        FROM all_searches AS s JOIN request_wide USING (request_uuid)""",
    "base": f"""
        SELECT stage.*, ab_variant, platform,
               coalesce(mo_last <= CASE platform {_LIMIT} END, false) AS on_first,
               coalesce(mo_last <= 3 * CASE platform {_LIMIT} END, false) AS on_three
        FROM stage
        JOIN (SELECT * FROM assigned WHERE ab_test = '{FLAG}' AND _date IN {IN_DAYS}) AS a
          USING (visit_id)
        JOIN (SELECT * FROM seen WHERE _date IN {IN_DAYS}) AS v USING (visit_id)""",
    # Log rows serve searches of their own day.
    "date_wide": pivot(
        f"""({running(f"(SELECT * FROM kind_ranks WHERE log_date IN {IN_DAYS}) AS k", "request_uuid, log_date")})
            AS r""",
        "request_uuid, log_date",
    ),
    "date_stage": f"""
        SELECT _date, s.request_uuid, ab_flag, visit_id, query, listing_id, {_COLUMNS}
        FROM all_searches AS s JOIN date_wide AS w
          ON w.request_uuid = s.request_uuid AND w.log_date = s._date""",
    "date_base": "",
    "day_wide": pivot("day_runs", "request_uuid"),
    "day_stage": f"""
        SELECT query, {_COLUMNS}
        FROM day_searches AS s JOIN day_wide USING (request_uuid)""",
    "popular": f"""
        SELECT *, rank() OVER (ORDER BY visits_that_used_query DESC) AS rank
        FROM (SELECT query_raw AS query, count(DISTINCT visit_id) AS visits_that_used_query,
                     count(DISTINCT visit_id)
                       / (SELECT count(DISTINCT visit_id) FROM sessions
                          WHERE _date >= DATE '{AS_OF}' - 7) AS pct_of_visits_covered
              FROM sessions WHERE _date >= DATE '{AS_OF}' - 7 GROUP BY 1) AS used""",
}
RELATIONS["date_base"] = RELATIONS["base"].replace("stage", "date_stage")
_ORDER = [
    "steps", "cand", "ranked", "vdays", "logs", "log_ranks", "log_runs", "kind_ranks",
    "kind_runs", "day_runs", "beacon", "sent", "assigned", "seen", "sessions", "all_sample", "day_sample",
    "all_searches", "day_searches", "request_wide", "stage", "base", "date_wide",
    "date_stage", "date_base", "day_wide",
    "day_stage", "popular",
]


def _mentions(text: str) -> set[str]:
    words = set(text.replace("(", " ").replace(")", " ").replace(".", " ").replace(",", " ").split())
    return words & set(RELATIONS)


def sql(body: str) -> str:
    """``body`` with the relations it mentions, directly or through another, put in front."""
    wanted = _mentions(body)
    while True:
        more = set().union(*[_mentions(RELATIONS[name]) for name in wanted]) if wanted else set()
        if more <= wanted:
            break
        wanted |= more
    # Relations that many joins read are held once.
    held = {"log_ranks": "MATERIALIZED ", "log_runs": "MATERIALIZED ", "kind_ranks": "MATERIALIZED "}
    parts = [f"{name} AS {held.get(name, '')}({RELATIONS[name]})" for name in _ORDER if name in wanted]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def doubles(body: str, columns=STEP_NAMES) -> str:
    """``body`` with whole numbers that may be missing as doubles, which every client reads alike."""
    casts = ", ".join(f"CAST({name} AS DOUBLE) AS {name}" for name in columns)
    return f"SELECT * REPLACE ({casts}) FROM ({body}) AS d"


def in_block(metric: str) -> str:
    return {"First Page": "on_first", "Three Pages": "on_three", "1K": "mo_last <= 1000"}[metric]


def first_page(source: str, by: str = "") -> str:
    """First-page shares and mean ranks of a relation, optionally by a column."""
    on_page = f"mo_last <= {FIRST_PAGE}"
    shares = ", ".join(
        f"sum(CASE WHEN {on_page} AND {s} > 0 THEN 1 ELSE 0 END)"
        f" / nullif(sum(CASE WHEN {on_page} THEN 1 ELSE 0 END), 0) AS {s}_first_page_share"
        for s in ("solr", "nir", "xwalk")
    )
    means = ", ".join(
        f"avg({step}) FILTER (WHERE {on_page}) AS {label}_avg_first_page_rank"
        for step, label in (("borda", "borda"), ("ranking", "ranking"), ("mo_last", "mo"))
    )
    grouped = f" GROUP BY {by}" if by else ""
    return f"SELECT {by + ', ' if by else ''}{shares}, {means} FROM {source}{grouped}"


def report(shares: dict[str, int], suffix: str = "", source: str = "base") -> str:
    """The report over ``source``: one row for each block and variant."""
    mask = " + ".join(
        f"(CASE WHEN {source} IS NULL THEN 0 ELSE {bit} END)"
        for source, bit in (("solr", 1), ("nir", 2), ("xwalk", 4), ("xml", 8))
    )
    scope = " ".join(
        f"WHEN '{metric}' THEN {in_block(metric)}" for metric in ("First Page", "Three Pages", "1K")
    )
    columns = ", ".join(
        f"count(*) FILTER (WHERE hit AND mask = {bits})"
        f" / nullif(count(*) FILTER (WHERE hit), 0) AS {name}{suffix}"
        for name, bits in shares.items()
    )
    return f"""
        SELECT metric, ab_variant, count(DISTINCT visit_id) AS visit_count,
               count(DISTINCT request_uuid) AS request_count, count(*) AS listing_count, {columns}
        FROM (SELECT {source}.*, metric, {mask} AS mask, CASE metric {scope} END AS hit
              FROM {source}, (VALUES ('First Page'), ('Three Pages'), ('1K')) AS b(metric)) AS rows
        GROUP BY metric, ab_variant"""
