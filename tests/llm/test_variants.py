"""Spelling variants against plain counts and a comparison of all words."""

import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.llm import variants
from rankloom.llm.variants import (
    affected_grams,
    count_words,
    frequent_grams,
    gram_reach,
    marks,
    near_words,
    rarest_grams,
    spelling_variants,
)
from tests.llm.conftest import CLASHES, ODD, prose


def edits(word, letters):
    """All words at one edit."""
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    for c in letters:
        out |= {word[:i] + c + word[i:] for i in range(len(word) + 1)}
        out |= {word[:i] + c + word[i + 1 :] for i in range(len(word))}
    return out - {word}


def plain_counts(rows):
    held = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if key is None else key}:{low}".encode())
            held[low[: h % len(low)] + low[h % len(low) + 1 :] if h % 31 == 0 else low] += 1
    return {w: n for w, n in held.items() if len(w) >= 7 and n >= 2}


def plain_near(words):
    by_gap = defaultdict(list)
    for w in words:
        for i in range(len(w) + 1):
            by_gap[i, w[:i], w[i:]].append(w)  # an insertion at i
            if i < len(w):
                by_gap[i, w[:i], w[i + 1 :]].append(w)
    return {(a, b) for held in by_gap.values() for a in set(held) for b in set(held) if a != b}


def plain_variants(words):
    near = defaultdict(set)
    for a, b in plain_near(words):
        near[a].add(b)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def test_plain_near_is_one_edit():
    words = ["abcdefg", "abcdefh", "abcdef", "abcdefgh", "xabcdefg", "bacdefg", "aaaaaaa", "aaaaaaaa"]
    assert plain_near(words) == {(a, b) for a in words for b in words if b in edits(a, "abcdefghx")}


def frame(spark, words):
    return spark.createDataFrame(sorted(words.items()), "word string, n bigint")


def syllables(rng, n, parts):
    """Words of few syllables, so that grams are frequent and lists long, and edits of them."""
    out = {}
    while len(out) < n:
        w = "".join(rng.choice(parts) for _ in range(rng.randint(3, 6)))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(w))
            w = w[:at] + rng.choice(["", "é", "s", "ab"]) + w[at + rng.randint(0, 1) :]
            if len(w) >= 7:
                out[w] = 10 ** rng.randint(0, 5) + rng.randint(1, 3)
        if len(w) >= 7:
            out[w] = 2 * 10 ** rng.randint(0, 3)
    return out


@pytest.mark.parametrize("least, slice_size", [(64, 2000), (1, 3), (5, 1)])
def test_near_words_are_those_of_all_pairs(spark, monkeypatch, least, slice_size):
    monkeypatch.setattr(variants, "LEAST_LIST", least)
    monkeypatch.setattr(variants, "LIST_SHARE", 10**9)
    monkeypatch.setattr(variants, "SLICE", slice_size)
    words = syllables(random.Random(least), 900, ["the", "re", "tion", "in", "er", "a", "ou", "aaa"])
    words |= {"a" * k: k for k in range(7, 15)} | {"ab" * k: k for k in range(4, 8)}
    found = near_words(frame(spark, words)).collect()
    assert {(r.a, r.b) for r in found} | {(r.b, r.a) for r in found} == plain_near(words)
    assert len(found) * 2 == len(plain_near(words)) > 100


def test_words_without_a_bound_meet_in_shorter_grams(spark, monkeypatch):
    """With all grams frequent, every word of 7 characters has all its grams over one character."""
    monkeypatch.setattr(variants, "LEAST_LIST", 0)
    monkeypatch.setattr(variants, "LIST_SHARE", 10**9)
    words = {f"{a}{b}cdef{c}": 2 for a in "abcx" for b in "bcdx" for c in "ghx"}
    held = frequent_grams(frame(spark, words), 3, 5)
    assert not any(rarest_grams(w, held, 3, 5)[1] for w in words)
    found = near_words(frame(spark, words)).collect()
    assert {(r.a, r.b) for r in found} | {(r.b, r.a) for r in found} == plain_near(words)


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=7, max_size=12), st.data())
def test_an_edit_changes_no_more_than_the_affected_grams(word, data):
    held = frozenset(data.draw(st.lists(st.text("abc", min_size=3, max_size=5), max_size=30)))
    ends = gram_reach(word, held, 3, 6)
    most = affected_grams(ends)
    own = Counter((word[a:e], a) for a, e in enumerate(ends))
    for other in edits(word, "abcd"):
        theirs = [(other[a:e], a) for a, e in enumerate(gram_reach(other, held, 3, 6))]
        shift = len(other) - len(word)
        changed = marks(word) ^ marks(other)
        assert (changed & 0xFFFFFFFF).bit_count() <= 2 and changed.bit_count() <= 6
        kept = sum(any(g == x and p in (a, a + shift) for g, p in theirs) for x, a in own)
        assert kept >= len(ends) - most


def test_forms_roots_and_ties(spark):
    words = {"aaaaaaab": 2, "aaaaaaa": 20, "aaaaaac": 20, "aaaaaad": 200, "aaaaaax": 199, "bbbbbbb": 2, "bbbbbbc": 19}
    words |= {"ccccccc": 3, "cccccca": 30, "ccccccb": 30}
    out = sorted(map(tuple, spelling_variants(frame(spark, words)).collect()), key=lambda r: r[0])
    assert out == plain_variants(words)
    said = {r[0]: r[1:3] for r in out}
    assert said["aaaaaaab"] == ("aaaaaaa", "aaaaaad") and said["bbbbbbb"] == (None, "bbbbbbb")
    assert said["ccccccc"] == ("cccccca", "cccccca")


def test_long_chain_of_forms(spark):
    words = {"x" * 7 + "y" * k: 10**k * 2 for k in range(19)}
    out = {r.word: r.root for r in spelling_variants(frame(spark, words)).collect()}
    assert set(out.values()) == {"x" * 7 + "y" * 18}


def test_counts_of_rows_of_any_kind(spark, make, monkeypatch):
    rows = [*ODD, (20, "Éçàü×÷ÿÀ ÉÇÀÜxyz çççççççç" * 3), (21, "a" * 70_000 + " " + "Abcdefg-aBCDEFG " * 40), (None, "ABCdefgh " * 9)]
    got = {r.word: r.n for r in count_words(make(rows, CLASHES), 7, 2, planted=True).collect()}
    assert got == plain_counts(rows) and len(got) > 5
    assert not count_words(make(rows), 7, 2).filter("word = 'ABCdefgh'").count()


def test_stretches_cut_no_run(monkeypatch):
    monkeypatch.setattr(variants, "PART", 7)
    text = prose(80) + "x" * 50 + " é" * 30
    parts = list(variants._stretches(text))
    assert "".join(parts) == text and len(parts) > 20
    assert [w for p in parts for w in re.findall(variants.LETTERS, p)] == re.findall(variants.LETTERS, text)


def test_empty_tables(spark, make):
    assert spelling_variants(count_words(make([]), 7, 2)).count() == 0
    assert spelling_variants(count_words(make([(1, None), (2, "few words")]), 7, 2)).count() == 0


def test_given_documents(spark):
    from rankloom.llm.queries import op11_spelling_variants

    folder = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    out = op11_spelling_variants(spark, folder)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = sorted(map(tuple, out.collect()), key=lambda r: r[0])
    assert got == plain_variants(plain_counts(rows)) and sum(1 for r in got if r[1]) > 50
