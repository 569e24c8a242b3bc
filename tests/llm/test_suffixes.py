"""Repeated byte strings against a count of all of them."""

import hashlib
import re
from collections import Counter

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rankloom.llm import suffixes
from rankloom.llm.suffixes import remove_repeats, repeats_digest
from rankloom.llm.windows import bucket_ids, first_least, pair_ids, prefix_marks
from tests.llm.conftest import CLASHES, ODD, prose


def plain(pairs, length):
    texts = [(i, (t or "").encode()) for i, t in pairs]
    counts = Counter(b[k : k + length] for _, b in texts for k in range(len(b) - length + 1))
    out = Counter()
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if counts[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[str(i), len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def found(docs, length):
    rows = repeats_digest(remove_repeats(docs, length=length)).collect()
    return Counter((str(r[0]), *r[1:]) for r in rows)


def test_same_as_plain(make):
    passage, tail = prose(60, 21), prose(45, 22)
    pairs = [
        (1, f"{prose(30, 23)} {passage} {prose(30, 24)}"),
        (2, f"{passage[:250]}é{passage[251:]}"),
        (3, f"{prose(10, 25)}{passage[100:]}{tail}"),
        (4, "ab" * 300 + "é" * 150),
        (9, passage[:199]),
        *[(10 + i, f"{prose(8, 40 + i)} {passage[i % 5 :]} {prose(8, 80 + i)} {tail[: 190 + i]}") for i in range(40)],
        *[(i, t) for i, t in ODD if t is None or len(t) < 10_000],
    ]
    assert found(make(pairs, CLASHES).repartition(5), 200) == plain(pairs, 200)


def test_small_flushes_and_many_tasks_give_the_same(make, monkeypatch):
    monkeypatch.setattr(suffixes, "FLUSH", 50)
    pairs = [(i, f"{prose(9, i)} {prose(40, i % 4)} {prose(9, i + 50)}") for i in range(60)]
    assert found(make(pairs).repartition(9), 64) == plain(pairs, 64)


def test_chunks_of_a_text_give_the_same(make, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", 70)
    pairs = [(i, f"{prose(9, i)} {prose(40, i % 4)} {prose(9, i + 50)} {'xy' * (i % 3 * 60)}") for i in range(40)]
    assert found(make(pairs).repartition(5), 64) == plain(pairs, 64)


def test_forced_collisions_remove_nothing(make, monkeypatch):
    monkeypatch.setattr(suffixes, "FLUSH", 300)
    monkeypatch.setattr(suffixes, "pair_ids", lambda a, b: pair_ids(a, b) & np.uint64(15))
    pairs = [(i, f"{prose(9, i)} {prose(40, i % 4)} {prose(9, i + 50)}") for i in range(40)]
    pairs += [(100 + i, prose(90, 500 + i)) for i in range(10)]
    assert found(make(pairs).repartition(6), 64) == plain(pairs, 64)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab", min_size=0, max_size=90), min_size=1, max_size=12))
def test_any_text(make, texts):
    pairs = list(enumerate(texts))
    assert found(make(pairs).repartition(3), 20) == plain(pairs, 20)


def test_nothing_repeated_within_a_long_text(make):
    row = repeats_digest(remove_repeats(make([(7, ODD[7][1]), (8, "")]))).collect()
    assert {r["doc_id"]: r["n_bytes"] for r in row} == {7: len(ODD[7][1]), 8: 0}


def test_buckets_tell_strings_apart():
    data = np.frombuffer(b"abcabcabdabc" * 20, np.uint8)
    for length, ids in bucket_ids(data, (10, 16, 100, 200)).items():
        strings = [data[i : i + length].tobytes() for i in range(len(data) - length + 1)]
        assert len(ids) == len(strings)
        assert len(set(ids.tolist())) == len(set(strings)) == len(set(zip(ids.tolist(), strings, strict=True)))


def test_marks_follow_the_bytes():
    data = np.frombuffer((prose(300, 3) * 2).encode(), np.uint8)
    marks = prefix_marks(data, 50).tolist()
    strings = [data[i : i + 50].tobytes() for i in range(len(data) - 49)]
    assert len(marks) == len(strings) and max(marks) < 1 << 24
    assert len(set(strings)) == len(set(zip(marks, strings, strict=True)))
    assert len(set(marks)) >= 0.99 * len(set(strings))
    assert prefix_marks(data[:49], 50).tolist() == []


def test_first_least():
    values = np.array([5, 3, 3, 9, 1, 7, 1, 1], np.uint64)
    for width in range(1, 9):
        wanted = [i + int(np.argmin(values[i : i + width])) for i in range(len(values) - width + 1)]
        assert first_least(values, width).tolist() == wanted


def test_empty_table(make):
    assert found(make([]), 200) == Counter()
