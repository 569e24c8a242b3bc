"""Text statistics, learned rules and pairwise ranking."""

import re
import zlib
from collections import Counter
from pathlib import Path

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rankloom.llm.ranking import learn_ranking, ranked
from rankloom.llm.rules import judged, learn_rules, verdict
from rankloom.llm.text import COUNTS, stored, text_stats
from tests.llm.conftest import CLASHES, ODD, prose

FOLDER = "/root/testdata/sf0.01"
has_tables = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_upper": len(re.findall(r"[A-ZÀ-ÖØ-Þ]", text)),
        "n_digits": len(re.findall(r"[0-9]", text)),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_distinct_words": len(set(words)),
        "n_repeat_words": len(covered),
    }


def counted(docs):
    return Counter((str(r["doc_id"]), tuple(r[c] for c in COUNTS)) for r in text_stats(docs).collect())


def wanted(pairs):
    return Counter((str(i), tuple(plain(t)[c] for c in COUNTS)) for i, t in pairs)


def test_counts(make):
    pairs = [*ODD, (20, "a b c a b c a"), (21, "x x x x"), (22, "x x"), (23, "É\xa0a\x1fb #*|\n\n É\xa0a\x1fb\n É")]
    assert counted(make(pairs, CLASHES)) == wanted(pairs)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab \n\t#A1é", max_size=60), min_size=20, max_size=40))
def test_counts_of_any_text(make, texts):
    pairs = list(enumerate(texts))
    assert counted(make(pairs)) == wanted(pairs)


def labelled(spark, make):
    good = [(i, prose(80 + i % 50, i)) for i in range(300)]
    loud = [(1000 + i, prose(90, i).upper()) for i in range(60)]
    marks = [(2000 + i, prose(90, i).replace(" ", "### ")) for i in range(60)]
    pairs = good + loud + marks + [(None, prose(80)), (5000, prose(70, 5)), (5001, prose(70, 5).upper())]
    labels = [(i, 1) for i, _ in good] + [(i, 0) for i, _ in loud + marks] + [(None, 0), (7, None), (8, 3)]
    return make(pairs), spark.createDataFrame(labels, "doc_id long, quality int")


def test_learned_rules_reject_what_is_labelled_so(spark, make):
    docs, labels = labelled(spark, make)
    stats = stored(text_stats(docs))
    rules = learn_rules(stats, labels)
    assert {c.feature for rule in rules for c in rule} & {"upper", "symbols", "word_length"}
    kept = {r["doc_id"]: r["kept"] for r in judged(stats, rules).collect()}
    assert not any(kept[i] for i in kept if i is not None and 1000 <= i < 3000)
    assert all(kept[i] for i in range(300)) and kept[5000] and not kept[5001]


def test_rules_cover_more_than_eight_kinds(spark):
    """Bad rows lie in ten bands of length between eleven bands of good ones."""
    bands = [(100 + 50 * k, 1 - k % 2) for k in range(21)]
    rows = [(100 * k + i, words, q) for k, (words, q) in enumerate(bands) for i in range(30)]
    table = spark.createDataFrame(rows, "doc_id long, n_words long, quality int")
    stats = stored(table.selectExpr("doc_id", *[c if c == "n_words" else f"0L as {c}" for c in COUNTS]))
    rules = learn_rules(stats, table.select("doc_id", "quality"))
    wrong = judged(stats, rules).join(table.select("doc_id", "quality"), "doc_id").filter("kept <> (quality = 1)")
    assert len(rules) == 10 and wrong.count() == 0


def test_rules_need_labels_of_both_kinds(spark, make):
    stats = text_stats(make(ODD))
    for rows in ([], [(5, 1), (6, 1)], [(None, 0)]):
        rules = learn_rules(stats, spark.createDataFrame(rows, "doc_id long, quality int"))
        assert rules == []
    result = judged(stats, []).collect()
    assert len(result) == len(ODD)
    assert all(r["kept"] == (not r["base_failed"]) for r in result)
    assert judged(text_stats(make([])), []).count() == 0
    assert "true" in str(verdict([], {}))


@has_tables
def test_rules_on_the_tables(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    stats = stored(text_stats(docs))
    found = judged(stats, learn_rules(stats, labels)).join(labels, "doc_id").filter("n_words >= 50")
    assert found.filter("quality = 1 and not kept").count() <= 0.01 * found.filter("quality = 1").count()
    assert found.filter("quality = 0 and kept").count() <= 0.1 * found.filter("quality = 0").count()


@has_tables
def test_ranking_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    stats = stored(text_stats(docs))
    rows = ranked(stats, learn_ranking(stats, labels)).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.95 * len(held)
    low = [r["score"] for r in held if r["quality"] == 0]
    high = [r["score"] for r in held if r["quality"] == 1]
    assert sum(a < b for a in low for b in high) >= 0.95 * len(low) * len(high)


def test_held_out_labels_change_nothing(spark, make):
    docs, labels = labelled(spark, make)
    stats = stored(text_stats(docs))
    turned = spark.createDataFrame(
        [
            (r["doc_id"], 1 - r["quality"])
            if r["doc_id"] is not None and r["quality"] in (0, 1) and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1
            else (r["doc_id"], r["quality"])
            for r in labels.collect()
        ],
        labels.schema,
    )
    scores = [sorted(map(str, ranked(stats, learn_ranking(stats, x)).collect())) for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_only_the_fit_is_sampled(spark, make):
    docs, labels = labelled(spark, make)
    stats = stored(text_stats(docs))
    few, every = learn_ranking(stats, labels, max_rows=30), learn_ranking(stats, labels)
    assert {n: [t for t, _ in x] for n, x in few.steps.items()} == {n: [t for t, _ in x] for n, x in every.steps.items()}
    rows = ranked(stats, few).join(labels.filter("quality in (0, 1)"), "doc_id").filter("not held_out").collect()
    share = sum(r["quality"] == 0 for r in rows) / len(rows)
    assert abs(sum(r["predicted"] == 0 for r in rows) / len(rows) - share) <= 0.03


def test_every_draw_meets_a_row(spark, make):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1][:5]
    pairs = [(i, prose(80 + i, i + 1)) for i in ids[1:]] + [(ids[0], prose(90, 3).upper())]
    stats = stored(text_stats(make(pairs)))
    labels = spark.createDataFrame([(i, int(i != ids[0])) for i in ids], "doc_id long, quality int")
    got = {r["doc_id"]: r["predicted"] for r in ranked(stats, learn_ranking(stats, labels)).collect()}
    assert got == {i: int(i != ids[0]) for i in ids}


def test_ranking_without_labels(spark, make):
    stats = text_stats(make(ODD, CLASHES))
    model = learn_ranking(stats, spark.createDataFrame([(5, 1)], "doc_id long, quality int"))
    rows = ranked(stats, model).collect()
    assert len(rows) == len(ODD) and all(r["score"] == 0.5 and r["predicted"] == 1 for r in rows)
    assert ranked(text_stats(make([])), model).count() == 0
