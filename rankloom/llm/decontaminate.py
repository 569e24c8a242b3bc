"""Benchmark decontamination by pigeonhole edit matching."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.text import whole

ERROR_RATE = 0.08
LEAST_ITEM = 24
#: Characters of test items that are searched in one pass over the documents.
BLOCK_CHARS = 2_000_000


def normal(text: str) -> str:
    """Lower-cased, with single spaces: the form in which items and documents are compared."""
    return " ".join(text.lower().split())


@dataclass(frozen=True)
class Item:
    """A test item. Its budget of errors is a share of its length; it has one piece more than errors.

    A short item is found as it is or not at all, and only where no word runs on beyond it.
    """

    item_id: int
    text: str
    errors: int
    short: bool = False

    def pieces(self) -> Iterator[tuple[int, str]]:
        n, parts = len(self.text), self.errors + 1
        for i in range(parts):
            a, b = i * n // parts, (i + 1) * n // parts
            yield a, self.text[a:b]

    @cached_property
    def forward(self) -> dict[str, int]:
        return _masks(self.text)

    @cached_property
    def backward(self) -> dict[str, int]:
        return _masks(self.text[::-1])


def _masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        out[ch] = out.get(ch, 0) | 1 << i
    return out


def _at_word_bounds(text: str, start: int, end: int) -> bool:
    """Whether neither end of a place lies within a run of letters and digits."""
    before = start > 0 and text[start - 1].isalnum() and text[start].isalnum()
    return not before and not (end < len(text) and text[end - 1].isalnum() and text[end].isalnum())


def myers(masks: dict[str, int], size: int, text: str, from_start: bool = False) -> tuple[int, int]:
    """Least edit distance of a pattern to a string of text that ends anywhere, and its end (the first of equals).

    Myers' bit-parallel columns on whole numbers of `size` bits. The string begins anywhere, or at 0 if from_start.
    """
    full, high = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score = full, 0, size
    best, enter = (size, 0), 1 if from_start else 0
    for end, ch in enumerate(text, 1):
        eq = masks.get(ch, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(horizontal | plus))
        down = plus & horizontal
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up = (up << 1 | enter) & full
        down = (down << 1) & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        if score < best[0]:
            best = (score, end)
    return best


def matches(text: str, items: list[Item], finder: ahocorasick.Automaton | None) -> Iterator[tuple[int, int, int, int]]:
    """(item, distance, start, end) of the best match of each item within its budget; text is in normal form.

    An item within its budget of errors has a piece without one, so each exact piece hit gives the places where the item
    may lie, and hits of overlapping places are verified together.
    """
    if finder is None:
        return
    places: dict[int, set[int]] = {}
    for last, (length, uses) in finder.iter(text):
        for item, offset in uses:
            if not items[item].short:
                places.setdefault(item, set()).add(last + 1 - length - offset)
            elif item not in places and _at_word_bounds(text, last + 1 - length, last + 1):
                places[item] = {last + 1 - length}
    for number, found in sorted(places.items()):
        item = items[number]
        size, slack = len(item.text), item.errors
        best: tuple[int, int, int] | None = None
        stretch: list[int] = []
        for at in [*sorted(found), None]:
            if stretch and (at is None or at - slack > stretch[-1] + size + slack):
                got = _verified(text, item, stretch)
                best = min(x for x in (best, got) if x) if best or got else None
                stretch = []
            if at is not None:
                stretch.append(at)
        if best:
            yield number, *best


def _verified(text: str, item: Item, stretch: list[int]) -> tuple[int, int, int] | None:
    size, slack = len(item.text), item.errors
    for at in stretch:
        if at >= 0 and text.startswith(item.text, at):
            return 0, at, at + size
    low = max(0, stretch[0] - slack)
    window = text[low : stretch[-1] + size + slack]
    distance, end = myers(item.forward, size, window)
    if distance > slack:
        return None
    before = window[max(0, end - size - slack) : end][::-1]
    _, length = myers(item.backward, size, before, from_start=True)
    return distance, low + end - length, low + end


def _finder(items: list[Item]) -> ahocorasick.Automaton | None:
    uses: dict[str, list[tuple[int, int]]] = {}
    for number, item in enumerate(items):
        for offset, piece in item.pieces():
            uses.setdefault(piece, []).append((number, offset))
    if not uses:
        return None
    finder = ahocorasick.Automaton()
    for piece, where in uses.items():
        finder.add_word(piece, (len(piece), where))
    finder.make_automaton()
    return finder


def _searched(rows: list[tuple[int, str, int, bool]]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = [Item(*row) for row in rows]
        finder = _finder(items)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                found = matches(normal(text.as_py()), items, finder)
                out.extend((doc, items[i].item_id, len(items[i].text), *rest) for i, *rest in found)
            columns = list(zip(*out, strict=True)) if out else [[] for _ in range(6)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([d.as_py() for d in columns[0]], batch.schema.field(0).type),
                    pa.array(columns[1], pa.int64()),
                    *[pa.array(c, pa.int32()) for c in columns[2:]],
                ],
                names=["doc_id", "item_id", "item_chars", "distance", "first", "last"],
            )

    return run


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    error_rate: float = ERROR_RATE,
    least_item: int = LEAST_ITEM,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(doc_id, item_id, item_chars, distance, first, last, exact_short): each item that a document holds within its error budget.

    The budget is the whole part of error_rate times the item's length; distances count edits between normal forms (see
    normal), and first and last (exclusive) are places in the document's. One row for each row of docs and item, the
    least distance and then the first place. Items have item_id and text. They are taken to the tasks in blocks of about
    block_chars characters, one pass over the documents for each block, so a task never holds all of a large benchmark.

    Items under least_item characters in normal form are searched without errors, at word bounds: neither end may lie
    within a run of letters and digits; exact_short marks them, as a single word of a document may be such an item. Null and empty texts and items match nothing. Items without id are
    reported with a null item_id; items that repeat an id and a text are one, before anything reaches the driver. Repeated rows and null ids of docs are reported like others; other columns aren't read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), whole(F.col(text_col)).alias("text")).filter(F.col("text") != "")
    tests = items.select(F.col("item_id").cast("long").alias("item_id"), whole(F.col("text")).alias("text")).distinct()
    total = tests.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_chars))
    of = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    schema = (
        f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id long, item_chars int, distance int, "
        "first int, last int"
    )
    out: DataFrame | None = None
    for block in range(blocks):
        normals = [(r["item_id"], normal(r["text"])) for r in tests.filter(of == block).toLocalIterator()]
        sized = ((i, t, len(t) < least_item) for i, t in normals if t)
        held = sorted({(i, t, 0 if short else int(len(t) * error_rate), short) for i, t, short in sized}, key=str)
        found = rows.mapInArrow(_searched(held), schema)
        out = found if out is None else out.unionByName(found)
    return out.withColumn("exact_short", F.col("item_chars") < least_item)
