"""The registered queries and the pipeline on the small tables."""

from pathlib import Path

import pytest

import corpus_pipeline
from checks.compare import connect, difference
from rankloom.llm.decontaminate import find_leaks
from rankloom.llm.queries import ORACLES, QUERIES, table
from rankloom.llm.simhash import simhash_groups
from tests.llm.conftest import ODD, prose

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
COLUMNS = list(corpus_pipeline.COLUMNS)


@pytest.mark.parametrize("name", [n for n in QUERIES if n != "pipeline"])
def test_query(spark, name):
    if name in ORACLES:
        assert difference(spark, connect(FOLDER), QUERIES[name], ORACLES[name], FOLDER) is None
    else:
        rows = QUERIES[name](spark, FOLDER).collect()
        if name in ("op2_best_fit_packing", "op3_benchmark_decontamination"):
            assert rows
        elif name == "op11_spelling_variants":  # a row for each word
            assert rows and len({r.word for r in rows}) == len(rows)
        else:
            whole = table(spark, FOLDER, "pages" if name == "op6_language_id" else "documents")
            assert len(rows) == whole.count()


def test_stages_on_the_tables(spark):
    docs, counts = table(spark, FOLDER, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        counts.append(docs.count())
        if name != "best-fit packing":
            assert docs.columns == COLUMNS
        if name == "SimHash near-dedup":
            groups = simhash_groups(docs)
            assert groups.select("component_id").distinct().count() == groups.count()
        if name == "benchmark decontamination":
            assert find_leaks(docs, table(spark, FOLDER, "benchmark")).count() == 0
    assert sorted(counts[:4], reverse=True) == counts[:4]
    assert QUERIES["pipeline"](spark, FOLDER).count() == counts[-1]


def test_stages_on_odd_rows(spark, make):
    pairs = [*ODD, (40, prose(200, 40)), (41, prose(200, 40).upper().lower()), (None, prose(150, 43))]
    for rows in (pairs, []):
        docs = make(rows, ("key", "record"))
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, FOLDER)
            got = docs.collect()
            if name == "line dedup" and rows:
                assert all(r["n_chars"] == len(r["text"]) for r in got)
            if name == "SimHash near-dedup" and rows:
                ids = [r["doc_id"] for r in got if r["doc_id"] is not None]
                assert len(ids) == len(set(ids)) and 40 in ids and 41 not in ids
                assert sum(r["doc_id"] is None for r in got) == 2
        assert bool(got) == bool(rows)


def test_stages_broadcast_no_more_than_they_are_sized_at(spark, make):
    """Ten thousand documents have 340,000 SimHash cells, which must not go through the driver."""
    docs = make([(100_000 + i, prose(60, 100 + i)) for i in range(10_000)])
    limit = "spark.sql.maxBroadcastTableSize"
    spark.conf.set(limit, "20m")  # the least that a table with a key of several fields takes is 16 MB
    try:
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, FOLDER)
        assert docs.select("doc_id").distinct().count() > 9000
    finally:
        spark.conf.unset(limit)
