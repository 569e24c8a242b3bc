"""Maximal runs of repeated words, found with string synchronising sets.

A run is a stretch of words with smallest period q and at least max(6, 4 q) words that no neighbour extends. Periods below
BASE are read off directly, word against word. For each dyadic scale t from BASE, positions are selected by hash, alike
wherever their surroundings are alike: the least hash of a t-word context in some window of t positions. Contexts inside
highly periodic regions (runs of period up to t/4, known from smaller scales) are left out. Two selected positions with the
same context of 2t words at a distance of t to 2t-1 propose their distance as a period.

No run is missed. Let q be its period and t <= q < 2t. A window of t positions and its copy q words later select the same
place; both contexts of 2t words lie in the run for each of its first 3(q-t)+2 windows or more, as its length is 4q or
more. These windows cover 2q words or more together, so not all their contexts can be highly periodic: the run would then
have a smaller period (Fine and Wilf). Every proposal is extended by comparing words, so hashes never decide a result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The least scale; a power of two, 8 or more (a period up to BASE/4 must make a run of BASE words).
BASE = 8
#: A run has at least this many words, and at least so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Bytes of text that are worked on together; a longer text stands alone.
TOGETHER = 1 << 22
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S1, _S2 = np.uint64(29), np.uint64(32)
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    x = first * _M1
    x ^= x >> _S2
    x += second
    x *= _M2
    x ^= x >> _S1
    return x


def _longer(marks: np.ndarray, size: int) -> np.ndarray:
    """Hashes of contexts of 2 size words from those of size words."""
    return _mixed(marks[: max(0, len(marks) - size)], marks[size:])


def _window_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each window of width keys, by prefix and suffix minima of blocks."""
    n = len(keys)
    blocks = -(-n // width)
    held = np.full(blocks * width, _NEVER, np.uint64)
    held[:n] = keys
    held = held.reshape(blocks, width)
    ahead = np.minimum.accumulate(held, axis=1).reshape(-1)
    behind = np.minimum.accumulate(held[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _stretches(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches of True of at least this length."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    return starts[long], ends[long]


def least_length(period: int) -> int:
    return max(LEAST_WORDS, LEAST_PERIODS * period)


def _extended(words: np.ndarray, period: int, start: int, end: int) -> tuple[int, int]:
    """[start, end) has the period; the maximal stretch around it that has it."""
    n, step = len(words), 8
    while end < n:
        stop = min(n, end + step)
        other = np.flatnonzero(words[end:stop] != words[end - period : stop - period])
        if len(other):
            end += int(other[0])
            break
        end, step = stop, 2 * step
    step = 8
    while start > 0:
        first = max(0, start - step)
        other = np.flatnonzero(words[first:start] != words[first + period : start + period])
        if len(other):
            start = first + int(other[-1]) + 1
            break
        start, step = first, 2 * step
    return start, end


def periodic_runs(words: np.ndarray, longest: int | None = None) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of a sequence of whole numbers, by start, then period.

    longest, if given, says that no run can have more words.
    """
    n = len(words)
    most = n if longest is None else min(n, longest)
    found: dict[tuple[int, int], int] = {}
    for period in range(1, BASE):
        if most < least_length(period):
            break
        starts, ends = _stretches(words[:-period] == words[period:], least_length(period) - period)
        for start, end in zip(starts.tolist(), (ends + period).tolist()):
            found.setdefault((start, end), period)
    if most < LEAST_PERIODS * BASE:
        return _ordered(found)
    marks = words.astype(np.int64).view(np.uint64)
    marks = _mixed(marks, marks)
    size = 1
    while size < BASE:
        marks, size = _longer(marks, size), 2 * size
    low = np.uint64((1 << n.bit_length()) - 1)
    while most >= LEAST_PERIODS * size:
        # Hash above, place below: the leftmost of equal contexts is the least.
        keys = (marks & ~low) | np.arange(len(marks), dtype=np.uint64)
        for (start, end), period in found.items():
            if 4 * period <= size <= end - start:
                keys[start : end - size + 1] = _NEVER
        wider = _longer(marks, size)
        least = _window_least(keys, size)
        chosen = np.unique((least[least != _NEVER] & low).astype(np.int64))
        chosen = chosen[chosen < len(wider)]
        for period, start in sorted(_proposals(chosen, wider, size)):
            _settle(words, found, period, start, size)
        marks, size = wider, 2 * size
    return _ordered(found)


def _ordered(found: dict[tuple[int, int], int]) -> list[tuple[int, int, int]]:
    return sorted(((start, end, period) for (start, end), period in found.items()), key=lambda r: (r[0], r[2]))


def _proposals(chosen: np.ndarray, contexts: np.ndarray, size: int) -> list[tuple[int, int]]:
    """(period, place) of neighbours at a distance of size to 2 size - 1 with equal contexts, one for each stretch."""
    out: list[tuple[int, int]] = []
    own = contexts[chosen]
    step = 1
    while step < len(chosen):
        far = chosen[step:] - chosen[:-step]
        near = far < 2 * size
        if not near.any():
            break
        hit = np.flatnonzero(near & (far >= size) & (own[step:] == own[:-step]))
        periods, places = far[hit], chosen[hit]
        order = np.lexsort((places, periods))
        periods, places = periods[order], places[order]
        # The contexts of one period that follow each other within their length are one stretch.
        first = np.ones(len(hit), bool)
        first[1:] = (periods[1:] != periods[:-1]) | (places[1:] - places[:-1] > 2 * size)
        out += zip(periods[first].tolist(), places[first].tolist())
        step += 1
    return out


def _settle(words: np.ndarray, found: dict, period: int, place: int, size: int) -> None:
    """Add the run around a proposal if it is long enough; a stretch that has a smaller period is there already."""
    if not np.array_equal(words[place : place + 2 * size], words[place + period : place + period + 2 * size]):
        return
    start, end = _extended(words, period, place, place + period + 2 * size)
    if end - start >= least_length(period):
        found.setdefault((start, end), period)


def _replaced(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word stands at each place of a text of n words under the contract's rule; None: as it is."""
    if doc_id is None or not n:
        return None
    h = crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    first = g % n
    period = 1 + (n - first) // (3 + g % 8)
    places = np.arange(n)
    places[first:] = first + (places[first:] - first) % period
    return places


def _in_groups(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    start = held = 0
    for at, size in enumerate(sizes.tolist()):
        if at > start and held + size > TOGETHER:
            yield start, at
            start, held = at, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and where each text's words begin and end (one more than texts)."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    ends = split.offsets.to_numpy() - split.offsets[0].as_py()
    words = split.flatten()
    some = pc.not_equal(pc.binary_length(words), 0)  # ends of texts give empty strings
    counted = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    return words.filter(some), counted[ends]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", planted: bool = False) -> DataFrame:
    """Each row's id as doc_id, runs (array of start, length, period: word numbers, by start, then period), collapsed.

    collapsed is the text's words without those of a run after its first period, joined by single spaces. Words are
    separated by spaces and U+0009 to U+000D. A null or empty text has no run and an empty collapsed text. Equal rows give
    equal rows, an empty table gives none, other columns play no part. Everything happens within a row: nothing is
    shuffled; a very long text costs some 50 bytes a word. With planted, texts are first changed by their ids as the
    contract of the query says (a null id changes nothing).
    """

    def searched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for first, last in _in_groups(sizes):
                yield _searched(batch.column(0)[first:last], batch.column(1)[first:last], planted)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    runs = "array<struct<start:bigint,length:bigint,period:bigint>>"
    return rows.mapInArrow(searched, f"doc_id {kind}, runs {runs}, collapsed string")


def _searched(ids: pa.Array, texts: pa.Array, planted: bool) -> pa.RecordBatch:
    words, bounds = _words(texts)
    if planted:
        keys = ids.to_pylist()
        order = None
        for row, (first, last) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            places = _replaced(keys[row], last - first)
            if places is not None:
                order = np.arange(len(words)) if order is None else order
                order[first:last] = first + places
        if order is not None:
            words = words.take(pa.array(order))
    numbers = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int32)
    # One sequence of all texts; a number of its own before each text keeps runs within texts.
    rows = np.repeat(np.arange(len(texts)), np.diff(bounds))
    sequence = np.empty(len(numbers) + len(texts), np.int32)
    places = np.arange(len(numbers)) + rows + 1
    sequence[places] = numbers
    heads = bounds[:-1] + np.arange(len(texts))
    sequence[heads] = -1 - np.arange(len(texts))
    found = periodic_runs(sequence, int(np.diff(bounds).max(initial=0)))
    keep = np.ones(len(sequence), bool)
    for start, end, period in found:
        keep[start + period : end] = False
    kept = keep[places]
    ends = np.concatenate([[0], np.cumsum(kept)])[bounds]
    collapsed = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), words.filter(pa.array(kept))), pa.scalar(" ", pa.large_string()))
    table = np.array(found, np.int64).reshape(-1, 3)
    owner = np.searchsorted(heads, table[:, 0], "right") - 1
    offsets = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
    runs = pa.StructArray.from_arrays(
        [
            pa.array(table[:, 0] - heads[owner] - 1),
            pa.array(table[:, 1] - table[:, 0]),
            pa.array(table[:, 2]),
        ],
        ["start", "length", "period"],
    )
    return pa.RecordBatch.from_arrays(
        [ids, pa.ListArray.from_arrays(pa.array(offsets), runs), collapsed.cast(pa.string())],
        ["doc_id", "runs", "collapsed"],
    )


def runs_digest(found: DataFrame) -> DataFrame:
    """Number of runs, the longest run (ties: the first, then the least period), and digests of runs and collapsed text."""
    best = F.array_min(
        F.transform(
            "runs",
            lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")),
        )
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.withColumn("best", best)
    length = -F.col("best.less")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
