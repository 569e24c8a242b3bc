import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rankloom.operators import metrics
from rankloom.operators.metrics import (
    SHARES,
    first_page_by_query,
    first_page_overall,
    page_flags,
    visit_facts,
    retrieval_report,
    retrieval_report_15,
    retrieval_report_by_request,
    with_page_flags,
)
from rankloom.operators.ranks import STEP_NAMES
from tests.fixtures import AB_TEST, FLAG, MONDAY, SEARCH, TUESDAY, VISIT, as_list, as_set

SIZES = {"desktop": 3, "mobile_web": 2, "boe": 1}
RANKS = (
    "_date date, request_uuid string, ab_flag string, visit_id string, query string,"
    " listing_id bigint, " + ", ".join(f"{name} bigint" for name in STEP_NAMES)
)
BASE = RANKS + ", ab_variant string, platform string"


def ranks_of(chance, uuid, day, visit, query="ring", count=9):
    rows = []
    for place in range(1, count + 1):
        steps = [chance.choice([None, chance.randrange(1, 9)]) for _ in STEP_NAMES[:-1]]
        rows.append((day, uuid, FLAG, visit, query, place * 10, *steps, place))
    return rows


def random_base(spark, seed):
    chance = random.Random(seed)
    rows = []
    for n in range(30):
        facts = (chance.choice(["on", "off", None]), chance.choice([*SIZES, "tv", None]))
        for row in ranks_of(chance, f"u{n % 20}", MONDAY, f"v{n}", count=chance.randrange(1, 12)):
            rows.append((*row, *facts))
    return with_page_flags(spark.createDataFrame(rows, BASE), SIZES)


def block_by_block(base, one_k=1000):
    """The report the long way: a filter and an aggregate for each block and share."""
    scopes = {"First Page": "page_1_flag = 1", "Three Pages": "top_3_flag = 1"}
    scopes["1K"] = f"mo_last <= {one_k}"
    found = {}
    rows = [row.asDict() for row in base.collect()]
    inside = {m: {id(r) for r in rows if check(r, m, one_k)} for m in scopes}
    for variant in {row["ab_variant"] for row in rows}:
        mine = [row for row in rows if row["ab_variant"] == variant]
        for metric in scopes:
            hits = [row for row in mine if id(row) in inside[metric]]
            counts = (
                len({row["visit_id"] for row in mine}),
                len({row["request_uuid"] for row in mine}),
                len(mine),
            )
            shares = [None] * len(SHARES)
            if hits:
                shares = [sum(combination(r) == s for r in hits) / len(hits) for s in SHARES]
            found[metric, variant] = (*counts, *shares)
    return found


def check(row, metric, one_k):
    if metric == "1K":
        return row["mo_last"] <= one_k
    return row["page_1_flag" if metric == "First Page" else "top_3_flag"] == 1


def combination(row):
    present = [name for name in ("solr", "nir", "xwalk", "xml") if row[name] is not None]
    if not present:
        return "other"
    return "_".join(present) if len(present) > 1 else f"{present[0]}_only"


@pytest.mark.parametrize("seed", [1, 2])
def test_report_equals_block_by_block(spark, seed):
    base = random_base(spark, seed)
    report = retrieval_report(base)
    assert report.columns[:5] == [
        "metric",
        "ab_variant",
        "visit_count",
        "request_count",
        "listing_count",
    ]
    assert report.columns[5:] == list(SHARES) and len(report.columns) == 21
    found = {(row[0], row[1]): tuple(row[2:]) for row in report.collect()}
    expected = block_by_block(base)
    assert found.keys() == expected.keys()
    for key, row in expected.items():
        assert found[key] == pytest.approx(row)


def test_report_invariants(spark):
    for row in retrieval_report(random_base(spark, 3)).collect():
        shares = [row[name] for name in SHARES]
        if shares[0] is not None:
            assert sum(shares) == pytest.approx(1)
        else:
            assert set(shares) == {None}


def test_short_report(spark):
    base = random_base(spark, 4)
    short = retrieval_report_15(base)
    assert len(short.columns) == 20 and "other_first_page_share" not in short.columns
    wide = {(r.metric, r.ab_variant): r.nir_xml for r in retrieval_report(base).collect()}
    narrow = {(r.metric, r.ab_variant): r.nir_xml_first_page_share for r in short.collect()}
    assert wide == narrow


def test_a_variant_without_page_rows(spark):
    row = ranks_of(random.Random(1), "u", MONDAY, "v", count=1)[0]
    base = with_page_flags(spark.createDataFrame([(*row, "on", "tv")], BASE), SIZES)
    blocks = {r.metric: r for r in retrieval_report(base).collect()}
    assert blocks["First Page"].other is None and blocks["First Page"].listing_count == 1
    assert sum(blocks["1K"][name] for name in SHARES) == 1
    with pytest.raises(PySparkException, match="division by zero"):
        retrieval_report(base, strict=True).collect()


def experiment(spark, seed, days=(MONDAY, TUESDAY)):
    """Ranks by request, searches, assignments and platforms with repeats and gaps."""
    chance = random.Random(seed)
    ranks, searches, tests, visits = [], [], [], []
    for n in range(12):
        ranks += ranks_of(chance, f"u{n}", MONDAY, "", count=chance.randrange(1, 11))
    for n in range(40):
        day = chance.choice(days)
        row = (day, f"u{chance.randrange(14)}", FLAG, f"v{n % 30}", chance.choice(["ring", "mug"]))
        searches += [row] * chance.choice([1, 1, 2])
    for n in range(28):
        for day in chance.sample(days, chance.choice([1, 1, 2])):
            tests.append((day, f"v{n}", FLAG, chance.choice(["on", "off"])))
            tests.append((day, f"v{n}", "other", "x"))
            visits.append((day, f"v{n}", chance.choice([*SIZES, "tv", None])))
    frames = (
        spark.createDataFrame(ranks, RANKS).drop("_date", "ab_flag", "visit_id", "query"),
        spark.createDataFrame(searches, SEARCH),
        spark.createDataFrame(tests, AB_TEST),
        spark.createDataFrame(visits, VISIT),
    )
    return frames


@pytest.mark.parametrize("seed", [1, 2])
def test_report_by_request_equals_the_report_over_the_joined_table(spark, seed):
    ranks, searches, tests, visits = experiment(spark, seed)
    days = [MONDAY, TUESDAY]
    table = ranks.join(searches, "request_uuid")
    table = table.select("_date", "request_uuid", "ab_flag", "visit_id", "query", "listing_id", *STEP_NAMES)
    long = retrieval_report(page_flags(table, tests, visits, FLAG, days, SIZES))
    facts = visit_facts(tests, visits, FLAG, days)
    ranked = ranks.select("request_uuid").distinct()
    short = retrieval_report_by_request(ranks, ranked, searches, facts, page_sizes=SIZES)
    assert as_list(short) == as_list(long, *short.columns) and short.columns == long.columns


@pytest.mark.parametrize("heavy", [1, 2_000_000])
def test_page_flags_join(spark, monkeypatch, heavy):
    monkeypatch.setattr(metrics, "HEAVY_LISTINGS", heavy)
    rows = ranks_of(random.Random(1), "u1", MONDAY, "v1", count=4)
    rows += ranks_of(random.Random(2), "u2", MONDAY, "v2", count=1)
    table = spark.createDataFrame(rows, RANKS)
    tests = spark.createDataFrame([(MONDAY, "v1", FLAG, "on"), (MONDAY, "v2", "x", "on")], AB_TEST)
    visits = spark.createDataFrame([(MONDAY, "v1", "mobile_web"), (MONDAY, "v2", "boe")], VISIT)
    found = page_flags(table, tests, visits, FLAG, [MONDAY], SIZES, 1)
    assert as_set(found, "mo_last", "ab_variant", "page_1_flag", "top_3_flag") == {
        (1, "on", 1, 1),
        (2, "on", 1, 1),
        (3, "on", 0, 0),
        (4, "on", 0, 0),
    }
    assert found.columns == [*table.columns, "ab_variant", "platform", "page_1_flag", "top_3_flag"]


def test_a_visit_on_two_listed_dates_doubles_its_rows(spark):
    table = spark.createDataFrame(ranks_of(random.Random(1), "u1", MONDAY, "v1", count=2), RANKS)
    tests = spark.createDataFrame([(d, "v1", FLAG, "on") for d in (MONDAY, TUESDAY)], AB_TEST)
    visits = spark.createDataFrame([(MONDAY, "v1", "boe")], VISIT)
    assert page_flags(table, tests, visits, FLAG, [MONDAY, TUESDAY]).count() == 4
    assert page_flags(table, tests, visits, FLAG, [MONDAY]).count() == 2


QUERY_RANKS = "query string, solr bigint, nir bigint, xwalk bigint, borda bigint, ranking bigint, mo_last bigint"


def test_first_page_metrics(spark):
    rows = [
        ("ring", 1, None, None, 10, 2, 1),
        ("ring", 2, 1, None, None, 4, 48),
        ("ring", 3, 1, 1, 90, 90, 49),
        ("mug", 1, 1, 1, 7, 7, 49),
        (None, None, 5, None, 1, 1, 2),
    ]
    table = spark.createDataFrame(rows, QUERY_RANKS)
    by_query = {row[0]: tuple(row[1:]) for row in first_page_by_query(table).collect()}
    assert by_query == {
        "ring": (1.0, 0.5, 0.0, 10.0, 3.0, 24.5),
        "mug": (None,) * 6,
        None: (0.0, 1.0, 0.0, 1.0, 1.0, 2.0),
    }
    overall = first_page_overall(table).first()
    assert tuple(overall) == pytest.approx((2 / 3, 2 / 3, 0.0, 5.5, 7 / 3, 17.0))
    assert tuple(first_page_overall(table.limit(0)).first()) == (None,) * 6
    with pytest.raises(PySparkException, match="division by zero"):
        first_page_by_query(table, strict=True).collect()


def test_report_reads_the_table_once(spark, tmp_path):
    random_base(spark, 1).write.parquet(f"{tmp_path}/base")
    report = retrieval_report(spark.read.parquet(f"{tmp_path}/base"))
    assert len([row for row in report.collect() if row.metric == "1K"]) == 3
    text = report._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert text.count("FileScan") == 1 and "borda" not in text
