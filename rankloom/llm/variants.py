"""Spelling variants: words at one edit from each other, by an index of variable-length grams.

The dictionary holds the frequent grams. From each place of a word a gram reaches as far as what it has so far is frequent:
rare beginnings give short grams, frequent ones longer grams, up to a longest. A gram depends on its own characters only,
so one edit changes just the grams that lie over it. The most grams over one character are a word's affected grams, and two
near words share all but so many grams of each. Hence they share one of the rarest affected + 1 grams of each: only these
lists are merged. The edit lies on one side of the shared gram, so a list is split by what stands before the gram, and once
more by what stands behind it. Words that meet are verified by edit distance.

A word all of whose grams can be affected at once has no such bound. Those words meet each other once more in a dictionary
with shorter longest grams, down to grams of one length, where every word of twice that length has a bound.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Container, Iterable, Iterator
from zlib import crc32

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.text import stored

#: Runs of letters that are words, and how they are lower-cased.
LETTERS = r"[A-Za-zÀ-ÿ]+"
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_GAP = re.compile(r"[^A-Za-zÀ-ÿ]")

#: One occurrence in so many is changed by the contract's rule.
PLANTED_EVERY = 31
#: Lengths of grams; a word must have twice the shortest.
SHORTEST_GRAM, LONGEST_GRAM = 3, 5
#: A gram is frequent if more words than this hold it, and more than one in LIST_SHARE of all gram places.
LEAST_LIST, LIST_SHARE = 64, 200_000
#: Words of one list that meet each other in one place; longer lists are cut into slices.
SLICE = 2000
#: Characters of a text whose words are counted at a time; counts that a task holds.
PART, HELD = 1 << 20, 1 << 18


def _stretches(text: str) -> Iterator[str]:
    """text in stretches of some PART characters that cut no run of letters."""
    at = 0
    while at < len(text):
        stop = at + PART
        gap = _GAP.search(text, stop) if stop < len(text) else None
        stop = gap.start() if gap else len(text)
        yield text[at:stop]
        at = stop


def count_words(
    docs: DataFrame, least_length: int, least_count: int, id_col: str = "doc_id", text_col: str = "text", planted: bool = False
) -> DataFrame:
    """word, n: the runs of letters of all whole texts, A-Z lower-cased, of these lengths and counts at least.

    With planted, a character of some occurrences is deleted by a hash of id and run, as the contract of the query says (a
    null id counts as an empty one). Null and empty texts hold no words. Counts are summed in each task first, so a
    frequent word costs no more than a rare one.
    """

    # A deletion only shortens, so shorter runs need not be looked at; runs of letters match as a whole.
    runs = re.compile(f"{LETTERS[:-1]}{{{max(1, least_length)},}}")

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flushed() -> pa.RecordBatch:
            words = [w for w in held if len(w) >= least_length]
            out = pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array([held[w] for w in words], pa.int64())], ["word", "n"]
            )
            held.clear()
            return out

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                said = f"{'' if key is None else key}:".encode()
                start = crc32(said)
                for part in _stretches(text.as_py() or ""):
                    own: Counter[str] = Counter()
                    for run, times in Counter(runs.findall(part)).items():
                        own[run.lower() if run.isascii() else run.translate(_LOWER)] += times
                    for run, times in own.items():
                        if planted:
                            h = crc32(run.encode(), start)
                            if h % PLANTED_EVERY == 0:
                                cut = h % len(run)
                                run = run[:cut] + run[cut + 1 :]
                        held[run] += times
                    if len(held) >= HELD:
                        yield flushed()
        yield flushed()

    rows = docs.select(F.col(id_col).cast("string"), F.col(text_col))
    counts = rows.mapInArrow(counted, "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def frequent_grams(words: DataFrame, shortest: int, longest: int) -> dict[str, int]:
    """The grams of these lengths that more than LEAST_LIST words and a share of all places hold, and how often they occur.

    All places over the number a gram must exceed bounds how many there are: LIST_SHARE for each of the lengths at most.
    """
    word = F.col("word")

    def of(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(word) - size + 1))
        return F.transform(starts, lambda start: word.substr(start, F.lit(size)))

    grams = F.flatten(F.array(*[of(size) for size in range(shortest, longest + 1)]))
    places = words.agg(F.coalesce(F.sum(F.length("word")), F.lit(0))).first()[0]
    least = max(LEAST_LIST, places // LIST_SHARE)
    counted = words.select(F.explode(grams).alias("gram")).groupBy("gram").count()
    return {row[0]: row[1] for row in counted.filter(F.col("count") > least).collect()}


def gram_reach(word: str, frequent: Container[str], shortest: int, longest: int) -> list[int]:
    """For each place, where its gram ends: it grows while it is frequent, the word goes on, and it is not the longest."""
    ends, n = [], len(word)
    for at in range(n - shortest + 1):
        end = at + shortest
        while end < n and end - at < longest and word[at:end] in frequent:
            end += 1
        ends.append(end)
    return ends


def affected_grams(ends: list[int]) -> int:
    """The most grams that lie over one character: all that one edit can change."""
    change = [1] * len(ends) + [0] * (max(ends, default=0) - len(ends) + 1)
    for end in ends:
        change[end] -= 1
    most = over = 0
    for step in change:
        over += step
        most = max(most, over)
    return most


def rarest_grams(word: str, frequent: dict[str, int], shortest: int, longest: int) -> tuple[list[tuple[int, int]], bool]:
    """Starts and ends of the affected + 1 rarest grams, and whether the word has a bound (more grams than affected).

    Grams are ordered by how often they occur, those that are not frequent first, then by text: the same order for all
    words. Grams of equal text are taken together.
    """
    ends = gram_reach(word, frequent, shortest, longest)
    order = sorted((frequent.get(word[at:end], 0), word[at:end], at, end) for at, end in enumerate(ends))
    affected = affected_grams(ends)
    last = order[min(affected, len(order) - 1)][:2]
    return [(at, end) for count, text, at, end in order if (count, text) <= last], affected < len(order)


def marks(word: str) -> int:
    """A parity for each letter (32 low bits, by hash) and for each pair of neighbours (31 bits above).

    One edit changes 2 letters and 4 pairs at most, so the marks of near words differ in 2 low bits and 4 others at most.
    """
    out = 0
    for at, char in enumerate(word):
        out ^= 1 << (ord(char) & 31)
        if at:
            out ^= 1 << (32 + (ord(word[at - 1]) * 7 + ord(char)) % 31)
    return out


def decompose(words: DataFrame, frequent: dict[str, int], shortest: int, longest: int) -> DataFrame:
    """word, bound, marks, lists, longer: the lists a word is in, by hash, and those where words one shorter expect it.

    A list holds the words of one size that have a gram and all before it, or a gram and all behind it, in common. That two
    lists share a hash costs comparisons, not results.
    """

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, bound, lists, longer = batch.column(0).to_pylist(), [], [], []
            for word in words:
                grams, some = rarest_grams(word, frequent, shortest, longest)
                parts = {f"<{word[:end]}" for _, end in grams} | {f">{word[at:]}" for at, _ in grams}
                bound.append(some)
                lists.append([xxhash.xxh64_intdigest(f"{len(word)}{p}") - (1 << 63) for p in parts])
                longer.append([xxhash.xxh64_intdigest(f"{len(word) - 1}{p}") - (1 << 63) for p in parts])
            kind = pa.list_(pa.int64())
            own = pa.array([marks(word) for word in words], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(bound, pa.bool_()), own, pa.array(lists, kind), pa.array(longer, kind)],
                ["word", "bound", "marks", "lists", "longer"],
            )

    schema = "word string, bound boolean, marks bigint, lists array<bigint>, longer array<bigint>"
    return words.select("word").mapInArrow(split, schema)


def _merged_lists(split: DataFrame) -> DataFrame:
    """(a, b): pairs of near words that share a list, b as long as a or one longer. Each pair once.

    Lists of more than SLICE words are cut into slices, each of which meets the whole list in a place of its own.
    """
    own = split.select(F.explode("lists").alias("list"), F.col("word").alias("a"), F.col("marks").alias("ma"))
    other = own.withColumnsRenamed({"a": "b", "ma": "mb"})
    longer = split.select(F.explode("longer").alias("list"), F.col("word").alias("b"), F.col("marks").alias("mb"))
    changed = F.col("ma").bitwiseXOR(F.col("mb"))
    alike = (F.bit_count(changed.bitwiseAND(F.lit(0xFFFFFFFF))) <= 2) & (F.bit_count(changed) <= 6)
    hot = own.groupBy("list").agg(F.count("*").alias("words")).filter(F.col("words") > SLICE)
    hot = stored(hot.select("list", F.ceil(F.col("words") / SLICE).cast("int").alias("slices")))

    def met(left: DataFrame, others: DataFrame, on: list[str]) -> DataFrame:
        pairs = left.join(others.hint("merge"), on).filter(alike)
        pairs = pairs.filter((F.length("a") < F.length("b")) | (F.col("a") < F.col("b")))
        return pairs.filter(F.levenshtein("a", "b", 1) == 1).select("a", "b")

    if hot.isEmpty():
        return met(own, other, ["list"]).unionAll(met(own, longer, ["list"])).distinct()
    light = own.join(hot, "list", "left_anti")
    slice_of = F.pmod(F.xxhash64("a"), F.col("slices")).cast("int")
    sliced = own.join(hot, "list").select("list", "a", "ma", slice_of.alias("slice"))
    every = F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")
    found = None
    for others in (other, longer):
        copied = others.join(hot, "list").select("list", "b", "mb", every)
        pairs = met(light, others, ["list"]).unionAll(met(sliced, copied, ["list", "slice"]))
        found = pairs if found is None else found.unionAll(pairs)
    return found.distinct()


def near_words(words: DataFrame, shortest: int = SHORTEST_GRAM, longest: int = LONGEST_GRAM) -> DataFrame:
    """(a, b): all pairs of words at one edit, each once; words (word: distinct) have 2 * shortest characters at least."""
    left = words.select("word")
    found = None
    for most in range(longest, shortest - 1, -1):
        split = stored(decompose(left, frequent_grams(left, shortest, most), shortest, most))
        pairs = stored(_merged_lists(split))
        found = pairs if found is None else found.unionAll(pairs)
        left = split.filter("not bound").select("word")
        if left.isEmpty():
            break
    return found if most == longest else found.distinct()


def spelling_variants(words: DataFrame, factor: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of words (word, n; words are distinct).

    form is the near word of greatest n (ties: the least word), if that is factor times the word's own n or more, else
    null; root follows forms to the last. A form's n grows by the factor at each step, so there are at most some 19 steps,
    and 5 doublings reach the last.
    """
    words = stored(words)
    pairs = near_words(words)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"))
    both = both.unionAll(pairs.select("b", "a"))
    both = both.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = both.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    )
    enough = F.expr(f"-best.less DIV {int(factor)} >= n")  # whole numbers, and no product that could overflow
    judged = stored(
        words.join(best, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(enough, F.col("best.other")).alias("form"),
            F.when(enough, -F.col("best.less")).alias("form_n"),
        )
    )
    roots = stored(judged.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    for _ in range(5):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = roots.join(further, "root", "left")
        roots = stored(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on")))
        if roots.filter("on").isEmpty():
            break
        roots = roots.drop("on")
    rows = judged.join(roots.select("word", "root"), "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

