"""Edit matching against the plain dynamic programme."""

from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.llm.decontaminate import Item, _finder, _masks, find_leaks, matches, myers, normal
from tests.llm.conftest import CLASHES, ODD, prose


def distances(pattern, text):
    """Edit distance of the pattern to the best string that ends at each place."""
    row = list(range(len(pattern) + 1))
    out = [row[-1]]
    for ch in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p != ch)))
        row = new
        out.append(row[-1])
    return out


@settings(max_examples=150, deadline=None)
@given(st.text("ab ", min_size=1, max_size=70), st.text("ab ", max_size=90))
def test_myers_is_the_edit_distance(pattern, text):
    assert myers(_masks(pattern), len(pattern), text)[0] == min(distances(pattern, text))


@settings(max_examples=150, deadline=None)
@given(st.text("abc", min_size=10, max_size=40), st.text("abc", max_size=120))
def test_no_match_within_budget_is_missed(pattern, text):
    item = Item(1, pattern, len(pattern) // 10)
    best = min(distances(pattern, text))
    found = list(matches(text, [item], _finder([item])))
    assert [f[1] for f in found] == ([best] if best <= item.errors else [])
    for _, distance, a, b in found:
        assert min(distances(pattern, text[a:b])[-1:]) == distance


def test_leaks(spark, make):
    item, other = prose(40, 11), prose(30, 12)
    words = item.split()
    words[5], words[20] = "zz", "yyyyy"
    pairs = [
        (10, f"{prose(50, 13)}\n{item.upper()} {prose(20, 14)}"),
        (11, f"{prose(50, 15)} {' '.join(words)} end"),
        (12, prose(500, 16)),
        (None, other),
        *ODD,
    ]
    items = spark.createDataFrame(
        [(1, item), (2, other), (3, ""), (4, None), (5, "short"), (None, prose(35, 17)), (1, item)], "item_id long, text string"
    )
    for block in (10_000, 100):
        got = find_leaks(make(pairs, CLASHES), items, block_chars=block).collect()
        assert sorted((str(r["doc_id"]), r["item_id"]) for r in got) == [("10", 1), ("11", 1), ("None", 2)]
    exact = next(r for r in got if r["doc_id"] == 10)
    assert exact["distance"] == 0
    assert normal(pairs[0][1])[exact["first"] : exact["last"]] == normal(item)
    assert 0 < next(r for r in got if r["doc_id"] == 11)["distance"] <= int(0.08 * len(item))


def test_short_items_are_found_at_word_bounds(spark, make):
    pairs = [(1, "The answer:\n FORTY  two."), (2, "forty twos"), (3, "x-forty two"), (4, "afforty two, forty two"), (5, "forti two")]
    items = spark.createDataFrame([(1, "Forty two"), (2, "?"), (3, "who wrote the odyssey?"), (4, " ")], "item_id long, text string")
    more = [(6, "So: who wrote the odyssey?Homer"), (7, "who wrote the odyssex?")]
    got = find_leaks(make(pairs + more), items).collect()
    assert sorted((r["doc_id"], r["item_id"], r["distance"], r["first"], r["last"]) for r in got) == [
        (1, 1, 0, 12, 21), (3, 1, 0, 2, 11), (4, 1, 0, 13, 22), (6, 2, 0, 25, 26), (6, 3, 0, 4, 26), (7, 2, 0, 21, 22)
    ]
    assert all(r["exact_short"] for r in got)


def test_a_letter_as_item_is_marked(spark, make):
    items = spark.createDataFrame([(1, "A"), (2, "yes"), (3, prose(30, 4))], "item_id long, text string")
    got = find_leaks(make([(1, "a cat sat on a mat"), (2, "yes it is"), (3, prose(30, 4))]), items).collect()
    assert sorted((r["doc_id"], r["item_id"], r["exact_short"]) for r in got if r["doc_id"] < 3) == [(1, 1, True), (2, 2, True)]
    assert (3, 3, False) in [(r["doc_id"], r["item_id"], r["exact_short"]) for r in got]


def test_empty_tables(spark, make):
    items = spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(make(ODD), items).count() == 0
    assert find_leaks(make([]), spark.createDataFrame([(1, prose(20))], "item_id long, text string")).count() == 0
