import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make(spark):
    """Documents from (doc_id, text) pairs, with further columns whose names the operators use inside."""

    def docs(pairs, extra=()):
        rows = [(i, t, "en", f"src{n % 3}", None if t is None else len(t)) for n, (i, t) in enumerate(pairs)]
        frame = spark.createDataFrame(rows, SCHEMA)
        for name in extra:
            frame = frame.selectExpr("*", f"'x' AS {name}")
        return frame

    return docs


CLASHES = ("record", "words", "bits", "variant", "fp", "slot", "shard", "key", "draw", "bucket", "spans", "id", "kept")
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards mix potent brews near dark old mills".split()


def prose(n, seed=1):
    """n words that repeat no pair of neighbours for long."""
    out, state = [], seed
    for _ in range(n):
        state = (state * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[state >> 16 & 15] + "abcdefgh"[state >> 12 & 7])
    return " ".join(out)


#: Null and empty texts, null ids, repeated rows and ties, a very long text.
ODD = [
    (1, None),
    (2, ""),
    (None, prose(120, 3)),
    (None, None),
    (5, prose(120, 5)),
    (5, prose(120, 5)),
    (6, prose(120, 5)),
    (7, prose(60_000, 7)),
    (8, " \n\t\n"),
]
