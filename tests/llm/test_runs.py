"""Runs against a search over all periods, and the digests against a plain reading of the contract."""

import hashlib
import random
import re
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.llm.runs import BASE, find_runs, least_length, periodic_runs, runs_digest
from tests.llm.conftest import CLASHES, ODD, prose


def plain_runs(words):
    """Every period by itself; a stretch that a smaller period explains is left out."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        at = 0
        while at + q < n:
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if end > at and end + q - at >= max(6, 4 * q):
                found.setdefault((at, end + q), q)
            at = max(end, at) + 1
    return sorted(((a, b, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_digest(key, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = crc32(str(key).encode())
    if key is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = [(a, b - a, q) for a, b, q in plain_runs(words)]
    dropped = {i for a, length, q in runs for i in range(a + q, a + length)}
    best = min(((-length, a, q) for a, length, q in runs), default=None)
    said = "".join(f"{a},{length},{q}\n" for a, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    row = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    return (key, len(runs), *row, *(hashlib.sha256(x.encode()).hexdigest() for x in (said, kept)))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=40), st.integers(1, 90)), max_size=6))
def test_runs_of_any_sequence(blocks):
    words = [w for block, times in blocks for w in (block * times)[: 20 + times * 2]]
    assert periodic_runs(np.array(words, np.int32)) == plain_runs(words)


@pytest.mark.parametrize("seed", range(60))
def test_long_periods_with_periodic_insides(seed):
    """Periods of every scale whose blocks hold highly periodic stretches, next to noise."""
    rng = random.Random(seed)
    words = []
    for _ in range(rng.randint(1, 4)):
        q = rng.choice([1, 2, 3, 5, BASE - 1, BASE, 15, 16, 17, 31, 32, 33, 63, 64, 100, 127])
        block = []
        while len(block) < q:
            inner = [rng.randrange(2) for _ in range(rng.randint(1, 4))]
            block += inner * rng.randint(1, max(1, q // 3))
        block = block[:q]
        length = least_length(q) + rng.randint(-3, q)
        words += (block * 9)[:length] + [rng.randrange(2) for _ in range(rng.randint(0, 6))]
    assert periodic_runs(np.array(words, np.int32)) == plain_runs(words)


def test_random_words_of_small_alphabets():
    rng = random.Random(9)
    for letters in (1, 2, 3, 50):
        words = [rng.randrange(letters) for _ in range(700)]
        assert periodic_runs(np.array(words, np.int32)) == plain_runs(words)


def test_digests_of_rows_of_any_kind(spark, make):
    rng = random.Random(4)
    rows = [(i, t) for i, t in ODD if i != 7]
    rows += [(i, prose(rng.randint(0, 90), i)) for i in range(20, 120)]
    rows += [(200, "a b " * 40 + "c " * 9 + "x"), (201, "é\x1cé\x85é " * 8), (202, "w" * 5000), (203, "a " * 5), (204, "a " * 6)]
    out = runs_digest(find_runs(make(rows, CLASHES), planted=True))
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(repr(plain_digest(k, t)) for k, t in rows)


def test_the_very_long_text_and_texts_beside_it(spark, make):
    text = prose(60_000, 7) + " ab cd" * 500
    out = find_runs(make([(1, "ab cd"), (7, text), (9, "ab cd " * 2)]).coalesce(1)).collect()
    found = {r.doc_id: [tuple(x) for x in r.runs] for r in out}
    assert found == {1: [], 7: [(60_000, 1000, 2)], 9: []}
    assert {r.doc_id: r.collapsed for r in out}[7] == prose(60_000, 7) + " ab cd"


def test_empty_table_and_other_names(spark, make):
    assert runs_digest(find_runs(make([]))).count() == 0
    named = spark.createDataFrame([("k", "x x x x x x x")], "name string, body string")
    row = find_runs(named, "name", "body").first()
    assert (row.doc_id, [tuple(r) for r in row.runs], row.collapsed) == ("k", [(0, 7, 1)], "x")


def test_given_documents(spark):
    from rankloom.llm.queries import op12_periodic_runs

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    out = {r.doc_id: tuple(r) for r in op12_periodic_runs(spark, folder).collect()}
    short = {k: t for k, t in texts.items() if len(t or "") < 20_000}
    assert out.keys() == texts.keys() and any(out[k][1] for k in short)
    assert {k: out[k] for k in short} == {k: plain_digest(k, t) for k, t in short.items()}
