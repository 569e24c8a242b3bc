"""Line deduplication against a plain pass over all documents."""

import hashlib
from collections import Counter, defaultdict

import pytest

from rankloom.llm.lines import apply_line_bitmaps, line_keep_bitmaps, lines_digest
from tests.llm.conftest import CLASHES, ODD, prose

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def key_of(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(UP, LOW))


def plain(pairs):
    last = 1 << 62
    first = defaultdict(set)
    for i, t in pairs:
        for line in (t or "").split("\n"):
            if len(key_of(line)) >= 10:
                first[key_of(line)].add(last if i is None else i)
    out = []
    for i, t in pairs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key_of(x)) < 10 or min(first[key_of(x)]) == (last if i is None else i)]
        text = "\n".join(kept)
        out.append((str(i), len(lines), len(lines) - len(kept), hashlib.sha256(text.encode()).hexdigest()))
    return Counter(out)


COMMON = "Éa Common Line of ALL documents"
PAIRS = [
    (3, f"{COMMON}\nshort\n only here, once more\n only here, once more\n"),
    (1, f"\t{COMMON.lower()} \r\nshort\nown line of one"),
    (2, "éA common line of all documents\nOWN LINE OF ONE\x0b\nown line of two"),
    (4, "\n".join(prose(6, i % 150) for i in range(400))),
    (9, "\n".join(prose(6, i % 150) for i in range(149, -50, -1))),
    (None, f"{COMMON}\na line of the nameless\na line of the nameless"),
    (None, "a line of the nameless"),
    *[(100 + i, f"{COMMON}\nanother line that many share\n{prose(8, 900 + i)}") for i in range(300)],
]


@pytest.mark.parametrize("chunks", [1024, 3])
def test_same_as_plain(make, chunks):
    pairs = PAIRS + [p for p in ODD if p[0] != 8]
    docs = make(pairs, CLASHES)
    rows = lines_digest(apply_line_bitmaps(docs, line_keep_bitmaps(docs, chunks=chunks))).collect()
    assert Counter((str(r[0]), *r[1:]) for r in rows) == plain(pairs)


def test_bitmaps_hold_only_what_changes(make):
    bits = {r["doc_id"]: r["bits"] for r in line_keep_bitmaps(make(PAIRS[:5])).collect()}
    assert 1 not in bits and 3 not in bits
    assert [(b["word"], b["dropped"]) for b in bits[2]] == [(0, 3)]
    assert all(b["dropped"] for rows in bits.values() for b in rows)


def test_empty_table(make):
    docs = make([])
    assert lines_digest(apply_line_bitmaps(docs, line_keep_bitmaps(docs))).count() == 0
