"""Secret scans: fixed patterns, and entropy of sliding windows over candidate strings.

Everything happens inside the row with built-in functions: no shuffle, no Python. Work grows with the text.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.text import whole

# The three base patterns with the least length of what they find.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12
KINDS = ("assign", "access", "hex", "entropy")

#: Characters of candidate strings; a place in this text is a counter of the window.
ALPHABET = "0123456789abcdefABCDEFghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ+/_=-"
#: c * log2(c) is kept as a whole number of 1 / SCALE, so that sums are exact.
SCALE = 1 << 20
#: Running sums are taken in blocks, so that very many finds in one text stay cheap.
BLOCK = 256

#: Strings that look random and are no secrets. One from ^ to $ clears a whole candidate, others what they match in it.
ALLOWED = (
    r"^[A-Za-z]+$",  # a long word
    r"^[A-Za-z]+([_=/+-]+[A-Za-z]+)+[_=/+-]*$",  # names and paths made of words
    r"^[0-9_=/+-]+$",  # numbers, dates, rules
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",  # a UUID
    r"(?i)example|sample|dummy|placeholder|changeme",  # no window may reach into these words
)


@dataclass(frozen=True)
class CharClass:
    """Candidates made only of these characters are secrets if a window has this many bits a character."""

    characters: str
    bits: float


#: Tried in this order; a candidate belongs to the first class that has all its characters.
CLASSES = (
    CharClass("0-9a-fA-F", 2.9),
    CharClass("0-9A-Za-z", 3.6),
    CharClass("0-9A-Za-z+/_=-", 3.8),
)


def _prefix(lengths: Column, start: Column) -> Column:
    """start, and start plus each running sum: one entry more than lengths."""
    return F.aggregate(
        lengths, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, F.lit(-1)) + x))
    )


def _starts(steps: Column) -> Column:
    """Sums of the steps before each step, in blocks."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")),
        lambda b: F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)),
    )
    zero = F.lit(0).cast("long")
    heads = _prefix(F.transform(blocks, lambda x: F.aggregate(x, zero, lambda a, v: a + v)), zero)
    running = F.flatten(
        F.transform(blocks, lambda x, b: F.slice(_prefix(x, F.get(heads, b)), F.lit(1), F.size(x)))
    )
    return F.when(F.size(steps) > 0, running).otherwise(F.array().cast("array<bigint>"))


def _found(text: Column, pattern: str, group: int | None = None) -> Column:
    """Leftmost matches that don't overlap: start, end (exclusive) in code points, the match or its group.

    The texts between matches give the places: a match starts where all before it, matches and gaps, ends.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = found if group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.slice(F.split(text, pattern), F.lit(1), F.size(found))
    steps = F.transform(
        F.arrays_zip(gaps.alias("gap"), found.alias("hit")),
        lambda x: (F.length(x["gap"]) + F.length(x["hit"])).cast("long"),
    )
    spans = F.transform(
        F.arrays_zip(_starts(steps).alias("at"), gaps.alias("gap"), found.alias("hit"), inner.alias("inner")),
        lambda x: F.struct(
            (x["at"] + F.length(x["gap"])).alias("start"),
            (x["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("end"),
            x["inner"].alias("value"),
        ),
    )
    return F.when(F.regexp_like(text, F.lit(pattern)), spans).otherwise(
        F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    )


def _entropy_units(window: int) -> list[int]:
    return [round(c * math.log2(c) * SCALE) if c else 0 for c in range(window + 1)]


def _best_window(codes: Column, window: int) -> Column:
    """The least sum of c * log2(c) over windows of a candidate: the window of most entropy.

    Counts move with the window: the character that enters and the one that leaves change one counter each, and the
    sum changes by their terms only.
    """
    units = F.array(*[F.lit(u).cast("long") for u in _entropy_units(window)])
    none = F.lit(-1)

    def step(acc: Column, i: Column) -> Column:
        new = F.get(codes, i)
        old = F.when(i >= window, F.get(codes, i - window)).otherwise(none)
        n_new, n_old = F.get(acc["counts"], new), F.get(acc["counts"], old)
        total = F.when(new == old, acc["total"]).otherwise(
            acc["total"]
            + F.get(units, n_new + 1)
            - F.get(units, n_new)
            + F.when(old >= 0, F.get(units, n_old - 1) - F.get(units, n_old)).otherwise(F.lit(0).cast("long"))
        )
        counts = F.transform(
            acc["counts"], lambda n, k: n + (k == new).cast("int") - (k == old).cast("int")
        )
        best = F.when(i >= window - 1, F.least(acc["best"], total)).otherwise(acc["best"])
        return F.struct(counts.alias("counts"), total.alias("total"), best.alias("best"))

    empty = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"),
        F.lit(0).cast("long").alias("total"),
        F.lit((1 << 62)).cast("long").alias("best"),
    )
    return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), empty, step, lambda acc: acc["best"])


def most_units(bits: float, window: int) -> int:
    """The sum of c * log2(c) at which a window has this many bits a character."""
    return math.floor((math.log2(window) - bits) * window * SCALE)


def find_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 20,
    classes: Sequence[CharClass] = CLASSES,
    allowed: Sequence[str] = ALLOWED,
) -> DataFrame:
    """One row for each row of docs: doc_id and spans, an array of (start, kind, end) by start, then kind.

    kind is a place in KINDS. Base spans are the whole matches of the three patterns that are long enough. An entropy
    span is a run of at least window characters of the alphabet in which some window reaches the entropy of its stretch's
    character class. Stretches are what is left of a run when the matches of the allow-list are cut out, one pattern
    after the other; an allow-list pattern from ^ to $ drops a whole run or stretch. So a name or a rule beside a secret
    doesn't hide it. Characters that repeat are not on the list: they lower the entropy of their windows by themselves.

    A null text counts as empty and gives an empty array; so does an empty text. Repeated rows and null ids give a row
    each. Other columns of docs are not read, so their names don't matter. A long text costs time in proportion.
    """
    text = F.col("text")
    kind = {name: F.lit(i) for i, name in enumerate(KINDS)}

    def tagged(spans: Column, name: str) -> Column:
        return F.transform(
            spans, lambda x: F.struct(x["start"].alias("start"), kind[name].alias("kind"), x["end"].alias("end"))
        )

    whole_run = [p for p in allowed if p.startswith("^") and p.endswith("$")]

    def cleared(value: Column) -> Column:
        ok = F.lit(False)
        for pattern in whole_run:
            ok = ok | F.regexp_like(value, F.lit(pattern))
        return ok

    def cut_out(stretches: Column, pattern: str) -> Column:
        return F.flatten(F.transform(stretches, lambda s: F.split(s, pattern)))

    def random(value: Column) -> Column:
        most = F.lit(-1).cast("long")
        for c in reversed(classes):
            fits = F.regexp_like(value, F.lit(f"^[{c.characters}]+$"))
            most = F.when(fits, F.lit(most_units(c.bits, window)).cast("long")).otherwise(most)
        codes = F.transform(F.split(value, ""), lambda ch: F.instr(F.lit(ALPHABET), ch) - 1)
        return F.when((F.length(value) < window) | cleared(value), F.lit(False)).otherwise(
            _best_window(codes, window) <= most
        )

    def suspicious(x: Column) -> Column:
        stretches = F.array(x["value"])
        for pattern in allowed:
            if pattern not in whole_run:
                stretches = cut_out(stretches, pattern)
        return F.when(cleared(x["value"]), F.lit(False)).otherwise(F.exists(stretches, random))

    candidates = _found(text, r"[A-Za-z0-9+/_=-]{%d,}" % window)
    return docs.select(F.col(id_col).alias("doc_id"), whole(F.col(text_col)).alias("text")).select(
        "doc_id",
        F.sort_array(
            F.concat(
                tagged(
                    F.filter(_found(text, ASSIGN, 2), lambda x: F.length(x["value"]) >= ASSIGN_LEAST), "assign"
                ),
                tagged(_found(text, ACCESS), "access"),
                tagged(_found(text, HEX), "hex"),
                tagged(F.filter(candidates, suspicious), "entropy"),
            )
        ).alias("spans"),
    )


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ","
    )


def secrets_digest(found: DataFrame) -> DataFrame:
    """Counts of the base spans, the digest of them, and all spans as text."""
    base = F.filter("spans", lambda x: x["kind"] < 3)

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [count(k) for k in range(len(KINDS))]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )
