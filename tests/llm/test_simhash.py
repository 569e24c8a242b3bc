"""SimHash groups against all pairs, and the covering of the anchors."""

import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankloom.llm.components import components
from rankloom.llm.simhash import anchors, fingerprint, fingerprint_links, simhash_digest, simhash_groups
from tests.llm.conftest import CLASHES, ODD, prose


def plain_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def near(prints):
    a = np.array(prints, np.uint64)
    return [(i, j) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 4) + i + 1]


@settings(max_examples=200, deadline=None)
@given(st.text("aBÉ \n\t\r\x0b\x0c\x1f\xa0", max_size=60))
def test_fingerprint_of_any_text(text):
    assert fingerprint(text.encode()) == plain_print(text)


def test_fingerprints_are_those_of_spark(spark):
    for text in ("", "one", "One two THREE", prose(30), "É é\xa0x\x0by z z z z z"):
        assert fingerprint(text.encode()) == plain_print(text)
    shingle = "one two three four"
    spark_hash = spark.range(1).select(F.xxhash64(F.lit(shingle))).first()[0]
    assert spark_hash % (1 << 64) == fingerprint(shingle.encode()) == xxhash.xxh64_intdigest(shingle.encode(), 42)


def test_anchors_cover(spark):
    """Words of 32 bits with up to 2 differing bits share an anchor."""
    rng = random.Random(5)
    pairs = []
    for _ in range(4000):
        word = rng.getrandbits(32)
        flips = rng.sample(range(32), rng.randint(0, 2))
        pairs.append((word, word ^ sum(1 << f for f in flips)))
    frame = spark.createDataFrame(pairs, "a long, b long")
    shared = frame.select(F.arrays_overlap(anchors(F.col("a")), anchors(F.col("b"))).alias("met"))
    assert shared.filter("not met").count() == 0
    sizes = frame.select(F.size(F.array_distinct(anchors(F.col("a")))).alias("n")).distinct().collect()
    assert {r["n"] for r in sizes} <= {2, 17}


def test_links_join_what_all_pairs_join(spark):
    rng = random.Random(6)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 30)):
            prints.add(base ^ sum(1 << f for f in rng.sample(range(64), rng.randint(1, 5))))
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    wanted = roots(range(len(prints)), near(prints))
    for part in (4096, 8):
        place = {p: i for i, p in enumerate(signed)}
        links = [(place[r["a"]], place[r["b"]]) for r in fingerprint_links(frame, part=part).collect()]
        assert roots(range(len(prints)), links) == wanted


def test_cells_are_not_broadcast(spark):
    """34 cells for each fingerprint are more than Spark takes them for, however few the fingerprints seem to be."""
    links = fingerprint_links(spark.range(1000).select(F.xxhash64("id").alias("fp")))
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components(spark):
    rng = random.Random(7)
    links = [(i, i + 1) for i in range(200)] + [(rng.randrange(300, 900), rng.randrange(300, 900)) for _ in range(400)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    wanted = roots({x for link in links for x in link}, links)
    assert found == {n: r for n, r in wanted.items() if n != r}


def test_groups(make):
    base = prose(300, 31).split()
    pairs = list(ODD)
    for i in range(60):
        words = list(base)
        words[i * 5 % 290] = f"changed{i}"
        pairs.append((100 + i, " ".join(words)))
    pairs += [(300 + i, " ".join(base)) for i in range(40)] + [(400 + i, prose(100, 400 + i)) for i in range(40)]
    rows = simhash_digest(simhash_groups(make(pairs, CLASHES).repartition(4))).collect()
    prints = [plain_print(t) for _, t in pairs]
    by_row = roots(range(len(pairs)), near(prints))
    least = {}
    for n, (i, _) in enumerate(pairs):
        if i is not None:
            least[by_row[n]] = min(i, least.get(by_row[n], i))
    wanted = sorted((str(i), f"{prints[n]:016x}", str(least.get(by_row[n]))) for n, (i, _) in enumerate(pairs))
    assert sorted((str(r[0]), r[1], str(r[2])) for r in rows) == wanted


def test_empty_table(make):
    assert simhash_groups(make([])).count() == 0
