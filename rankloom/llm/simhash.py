"""SimHash near-duplicates by anchor-point covering."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.components import components
from rankloom.llm.text import stored, whole

SHINGLE, MOST_BITS, SEED = 4, 4, 42
#: A-Z lower-cased, and each of the six spaces that separate words as U+0020; all other bytes as they are.
PLAIN = bytes(32 if c in b" \t\n\x0b\x0c\r" else c for c in range(256)).lower()
#: Shingles whose hashes are counted at a time.
BLOCK = 1 << 16
#: Fingerprints of one anchor that one group compares; more are compared in pairs of parts.
PART = 4096


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a text: bit i is set if it is set in over half of the hashes of its word shingles.

    No words give 0. Memory is some 20 bytes for each byte of the text at most, also for texts of many short words, as
    words are kept as places in the text.
    """
    data = np.frombuffer(text.translate(PLAIN), np.uint8)
    word = data != 32
    kept = word.copy()
    kept[1:] |= word[:-1]  # the first space after a word
    joined = data[kept].tobytes().rstrip(b" ")
    if not joined:
        return 0
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = np.append(0, spaces + 1), np.append(spaces, len(joined))
    step = min(shingle, len(starts))
    n = len(starts) - step + 1
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        stop = min(n, at + BLOCK)
        hashes = np.fromiter(
            (
                digest(joined[a:b], SEED)
                for a, b in zip(starts[at:stop].tolist(), ends[at + step - 1 : stop + step - 1].tolist(), strict=True)
            ),
            np.uint64,
            stop - at,
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_buffer().to_pybytes(), shingle) for t in batch.column(1)]
            signed = np.array(prints, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed)], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the 64 bits as a long) for each row of docs; a null text counts as empty."""
    rows = docs.select(F.col(id_col).alias("doc_id"), whole(F.col(text_col)).cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints(shingle), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _moves() -> list[list[int]]:
    """For each syndrome of the Hamming code of length 31: what to flip for every code word within 2 bits of 32.

    The code is that of length 31 with one more free bit, the highest, so each word of 32 bits has a code word within 1
    bit: its covering radius. Bit i of the word stands for column i + 1.
    """
    free, out = 1 << 31, [[0, 1 << 31]]
    for s in range(1, 32):
        one = 1 << (s - 1)
        two = [(1 << (a - 1)) | (1 << ((a ^ s) - 1)) for a in range(1, 32) if a < a ^ s]
        out.append([one, one | free, *two])
    return out


def anchors(half: Column) -> Column:
    """The anchors within covering radius plus 1 of a word of 32 bits, given as a long: 2 or 17 of them."""
    syndrome = F.lit(0)
    for j in range(5):
        mask = sum(1 << i for i in range(31) if (i + 1) >> j & 1)
        syndrome = syndrome + (F.bit_count(half.bitwiseAND(F.lit(mask).cast("long"))) % 2) * (1 << j)
    table = F.array(*[F.array(*[F.lit(x).cast("long") for x in row]) for row in _moves()])
    return F.transform(F.get(table, syndrome.cast("int")), lambda move: move.bitwiseXOR(half))


def _forest(fps: np.ndarray, most_bits: int) -> Iterator[tuple[int, int]]:
    """Links that join what is within most_bits of each other, one less than members for each joined set."""
    rest = fps
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            here = queue.pop()
            near = np.bitwise_count(rest ^ here) <= most_bits
            if near.any():
                found = rest[near]
                rest = rest[~near]
                for other in found:
                    yield here, other
                queue.extend(found)


def _linked(most_bits: int):
    """Links within each cell; rows come sorted by cell, and a cell has at most two parts."""

    def links_of(cells: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, (cells[1:] != cells[:-1]).any(axis=1)])
        sizes = np.diff(np.r_[starts, len(fps)])
        pair = starts[sizes == 2]
        near = np.bitwise_count(fps[pair] ^ fps[pair + 1]) <= most_bits
        a, b = [fps[pair[near]]], [fps[pair[near] + 1]]
        for at, size in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            found = list(_forest(fps[at : at + size], most_bits))
            if found:
                a.append(np.array([x for x, _ in found], np.uint64))
                b.append(np.array([x for _, x in found], np.uint64))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"]
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, fps = np.zeros((0, 3), np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            got = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            cells = np.concatenate([cells, np.stack([x.astype(np.int64) for x in got[:3]], axis=1)])
            fps = np.concatenate([fps, got[3].view(np.uint64)])
            changes = np.flatnonzero((cells[1:] != cells[:-1]).any(axis=1))
            if len(changes):
                upto = changes[-1] + 1
                yield links_of(cells[:upto], fps[:upto])
                cells, fps = cells[upto:], fps[upto:]
        if len(fps):
            yield links_of(cells, fps)

    return run


def fingerprint_links(prints: DataFrame, most_bits: int = MOST_BITS, part: int = PART) -> DataFrame:
    """Links (a, b) between distinct fingerprints; prints has one row for each, in the column fp.

    Two fingerprints with at most 4 differing bits have a half of 32 bits in which at most 2 differ. In that half there
    is a word z within 1 bit of both, and z's anchor is within the covering radius, 1. So each fingerprint goes to every
    anchor within covering radius plus 1 of either half, 34 cells at most of 2^28, and each such pair meets in one. Since
    both sides are replicated, each has to reach only half of the half's threshold.

    What meets is compared in all 64 bits. A cell sends links that join its members (a forest), not all pairs. A cell of
    more than `part` members is compared in pairs of parts, each in a group of its own.
    """
    if most_bits > 4:
        raise ValueError("the anchors cover up to 4 differing bits")
    halves = F.array(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")), F.shiftrightunsigned("fp", 32))
    cells = prints.select(
        "fp",
        F.explode(
            F.flatten(
                F.transform(
                    halves,
                    lambda h, i: F.transform(anchors(h), lambda x: x + i.cast("long") * F.lit(1 << 32).cast("long")),
                )
            )
        ).alias("anchor"),
    )
    members = cells.groupBy("anchor").agg(F.count("*").alias("members")).filter("members > 1")
    # Spark sizes the cells as it sizes prints, 34 times too low, and would broadcast either side. Neither may go through
    # the driver, so the kind of join is stated.
    shared = cells.join(members.hint("merge"), "anchor").withColumn("parts", F.ceil(F.col("members") / part).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    spread = shared.withColumn("own", own).select(
        "anchor",
        "fp",
        F.explode(
            F.when(F.col("parts") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
                F.transform(
                    F.sequence(F.lit(0), F.col("parts") - 1),
                    lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")),
                )
            )
        ).alias("c"),
    )
    sorted_cells = (
        spread.select("anchor", "c.i", "c.j", "fp")
        .repartition("anchor", "i", "j")
        .sortWithinPartitions("anchor", "i", "j", "fp")
    )
    return sorted_cells.mapInArrow(_linked(most_bits), "a long, b long")


def simhash_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    most_bits: int = MOST_BITS,
) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) for each row of docs.

    Equal fingerprints are one class from the start, so copies are never paired. Texts without words, null ones too, have
    fingerprint 0 and are linked like any other. Null ids get the id of their component, null if it has none; repeated
    rows are linked as equal texts; an empty table gives no rows.
    """
    prints = stored(fingerprints(docs, id_col, text_col, shingle))
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    # Stored, so that Spark knows their size: by its estimate they are as few as the classes.
    links = stored(fingerprint_links(classes, most_bits).distinct())
    roots = components(links)
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = stored(rooted.join(names, "root").select("fp", "component_id"))
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id")


def simhash_digest(groups: DataFrame) -> DataFrame:
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


