"""Repeated byte strings by bucket-pointer refinement, over a sparse set of starts.

Initial buckets of short byte strings are refined by the bucket at a later offset, level by level, until the buckets hold
strings of half the length sought (windows.py). The full length is the pair of the bucket at a start and the one half a
length later. Sorting all starts of all texts isn't needed: among the starts of half-length strings inside a window of the
full length, the one with the least bucket identifier is its pointer. Equal windows have equal pointers at equal places, so
two windows can only be equal if their pointers are in one bucket. Pointers are sorted first; full-length buckets are made
for those windows only whose pointer's bucket holds different surroundings.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.text import stored, whole
from rankloom.llm.windows import bucket_ids, first_least, pair_ids, prefix_marks

LENGTH = 200
#: A task sorts this many entries at a time before it sends them on.
FLUSH = 1_000_000
#: Windows of a text whose buckets are made at a time, so that a very long text needs no more memory than its own bytes
#: and those of a chunk. A run of windows that share a pointer ends with its chunk.
CHUNK = 1 << 20
#: Text bytes for each range of identifiers that one group sorts.
RANGE_BYTES = 12 << 20

# An entry is one run of windows that share their pointer, or one window. extent: windows after the first.
_COLUMNS = ("key", "id", "doc", "of", "at", "extent", "mark")
_TYPES = ("<u8", "<u8", "<i8", "<i4", "<i4", "<i4", "u1")
_NO_DOC, _TWICE, _MIXED = 1, 2, 4
_SPANS = "kind int, doc_id long, variant int, first int, last int, key long"
#: Packs are sorted by text and name each text once, with the number of its entries.
_TEXT = ("doc", "of")
_PACKED = (*_COLUMNS, "entries")
_PACKS = "bucket int, kind int, " + ", ".join(f"{c} binary" for c in _PACKED)
#: What a pack or a span holds: windows found twice, runs to be looked at window by window, entries to be sorted.
_DECIDED, _OPEN, _SENT = 0, 1, 2
#: Entries in a pack that only passes the exchange.
_PACK = 20_000

Entries = dict[str, np.ndarray]


def _take(entries: Entries, chosen: np.ndarray) -> Entries:
    return {c: v[chosen] for c, v in entries.items()}


def _join(parts: list[Entries]) -> Entries:
    return {c: np.concatenate([p[c] for p in parts]) for c in _COLUMNS}


def _merged(e: Entries) -> Entries:
    """Decided windows; those of one text that follow each other or overlap become one entry."""
    if not len(e["at"]):
        return e
    null = e["mark"] & _NO_DOC
    order = np.lexsort((e["at"], e["of"], e["doc"], null))
    e, null = _take(e, order), null[order]
    # Windows of a text are unique or equal, so the end of all before is the largest of the running ends.
    new = np.ones(len(order), bool)
    new[1:] = (e["doc"][1:] != e["doc"][:-1]) | (e["of"][1:] != e["of"][:-1]) | (null[1:] != null[:-1])
    new[1:] |= e["at"][1:] > e["at"][:-1] + e["extent"][:-1] + 1
    starts = np.flatnonzero(new)
    last = np.maximum.reduceat(e["at"] + e["extent"], starts)
    out = _take(e, starts)
    out["extent"] = (last - out["at"]).astype(np.int32)
    out["key"], out["id"], out["mark"] = (np.zeros_like(out["key"]), np.zeros_like(out["id"]), null[starts])
    return out


def _spans(e: Entries, kind: int) -> pa.RecordBatch:
    """Rows of _SPANS."""
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(e["at"]), kind, np.int32)),
            pa.array(e["doc"], mask=(e["mark"] & _NO_DOC).astype(bool)),
            pa.array(e["of"]),
            pa.array(e["at"]),
            pa.array((e["at"] + e["extent"]).astype(np.int32)),
            pa.array(e["key"].view(np.int64)),
        ],
        names=["kind", "doc_id", "variant", "first", "last", "key"],
    )


def _squeezed(values: np.ndarray, kind: str) -> bytes:
    """All first bytes, then all second bytes and so on, compressed: small numbers cost little."""
    planes = values.astype(kind).view(np.uint8).reshape(len(values), -1).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def _expanded(blob: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _pack(e: Entries) -> list[bytes]:
    new = np.flatnonzero(np.r_[True, (e["doc"][1:] != e["doc"][:-1]) | (e["of"][1:] != e["of"][:-1])])
    sizes = np.diff(np.append(new, len(e["at"])))
    columns = [_squeezed(e[c][new] if c in _TEXT else e[c], t) for c, t in zip(_COLUMNS, _TYPES, strict=True)]
    return [*columns, _squeezed(sizes, "<i4")]


def _unpack(row: dict) -> Entries:
    e = {c: _expanded(row[c], t) for c, t in zip(_COLUMNS, _TYPES, strict=True)}
    sizes = _expanded(row["entries"], "<i4")
    return e | {c: e[c].repeat(sizes) for c in _TEXT}


def _packs(e: Entries, kind: int, buckets: int) -> pa.RecordBatch:
    """Entries as rows of packed columns: one for each bucket of keys, or chunks that go to any bucket."""
    if kind == _SENT:
        bucket = (e["key"] % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort((e["at"], e["of"], e["doc"], bucket))
        bucket, e = bucket[order], _take(e, order)
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        to = bucket[starts]
    else:
        starts = np.arange(0, len(e["at"]), _PACK)
        to = (e["doc"][starts].astype(np.uint64) % np.uint64(buckets)).astype(np.int32)
    ends = np.append(starts[1:], len(e["at"]))[: len(starts)]
    packs = [_pack({c: v[a:b] for c, v in e.items()}) for a, b in zip(starts, ends, strict=True)]
    columns = list(zip(*packs, strict=True)) if packs else [[] for _ in _PACKED]
    return pa.RecordBatch.from_arrays(
        [pa.array(to, pa.int32()), pa.array(np.full(len(to), kind, np.int32)), *[pa.array(c, pa.binary()) for c in columns]],
        names=["bucket", "kind", *_PACKED],
    )


def _sort_out(entries: Entries, last: bool, refine: bool = True) -> tuple[Entries, Entries, Entries]:
    """Entries that are decided (their identifier is found twice), open ones (their key holds several identifiers) and,
    unless last, those that other tasks have to see: one for each identifier. Where a key's open entries are looked at
    again (refine), two identifiers for each key show that it is open, so no more are sent."""
    order = np.lexsort((entries["id"], entries["key"]))
    e = _take(entries, order)
    n = len(order)
    new_key = np.ones(n, bool)
    new_key[1:] = e["key"][1:] != e["key"][:-1]
    new_id = new_key.copy()
    new_id[1:] |= e["id"][1:] != e["id"][:-1]
    group = np.cumsum(new_id) - 1
    of_key = np.cumsum(new_key) - 1
    twice = np.bincount(group)[group] > 1
    known = (e["mark"] & _TWICE) > 0
    mixed = np.bincount(of_key, new_id)[of_key] > 1
    mixed |= np.bincount(of_key, e["mark"] & _MIXED)[of_key] > 0
    decided = _take(e, twice & ~known)
    reported = (e["mark"] & _MIXED) > 0
    e["mark"] = (e["mark"] & _NO_DOC) | np.where(twice | known, _TWICE, 0).astype(np.uint8)
    e["mark"] |= np.where(mixed, _MIXED, 0).astype(np.uint8)
    if last:
        return decided, _take(e, mixed & ~reported), {}
    place = group - group[np.flatnonzero(new_key)][of_key]
    return decided, _take(e, mixed & new_id), _take(e, new_id & (place < 2) if refine else new_id)


def _flushed(parts: list[Entries], buckets: int, refine: bool) -> Iterator[pa.RecordBatch]:
    decided, still_open, send = _sort_out(_join(parts), False, refine)
    yield _packs(_merged(decided), _DECIDED, buckets)
    if refine:
        yield _packs(still_open, _OPEN, buckets)
    yield _packs(send, _SENT, buckets)


def _entries(key, ids, doc, of, at, extent) -> Entries:
    n = len(key)
    return {
        "key": key,
        "id": ids,
        "doc": np.full(n, doc or 0, np.int64),
        "of": np.full(n, of, np.int32),
        "at": at.astype(np.int32),
        "extent": extent.astype(np.int32),
        "mark": np.full(n, _NO_DOC if doc is None else 0, np.uint8),
    }


def _chunk(data: np.ndarray, start: int, size: int, length: int) -> np.ndarray:
    """The bytes of the windows that start in the chunk of this size at start."""
    return data[start : start + size + length - 1]


def _runs(data: np.ndarray, start: int, doc: int | None, of: int, length: int) -> Entries:
    """Runs of windows with one pointer: key is the pointer's bucket, id the bucket of all bytes of the run. data, at
    least one window, is a chunk that lies at start of its text."""
    half = length // 2
    ids = bucket_ids(data, (half, length))
    pointer = first_least(ids[half], length - half + 1)
    first = np.flatnonzero(np.diff(pointer, prepend=-1))
    last = np.append(first[1:], len(pointer)) - 1
    full = ids[length]
    around = pair_ids(pair_ids(full[first], full[last]), (pointer[first] - first).astype(np.uint64))
    runs = pair_ids(around, (last - first).astype(np.uint64))
    return _entries(ids[half][pointer[first]], runs, doc, of, first + start, last - first)


def _run_batches(buckets: int, length: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for doc, of, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                for start in range(0, len(data) - length + 1, CHUNK):
                    parts.append(_runs(_chunk(data, start, CHUNK, length), start, doc.as_py(), of.as_py(), length))
                    held += len(parts[-1]["key"])
                    if held >= FLUSH:
                        yield from _flushed(parts, buckets, True)
                        parts, held = [], 0
        if parts:
            yield from _flushed(parts, buckets, True)

    return run


def _window_batches(buckets: int, length: int):
    """Each window of the open runs of a text: its key is its full-length bucket within its pointer's, its id a second
    identifier made from the bytes alone, so that two strings with one key are still told apart."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for doc, of, text, opened in zip(*(batch.column(i) for i in range(4)), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                first, last, key = (c.to_numpy() for c in opened.values.flatten())
                chunk = first // CHUNK
                for c in np.unique(chunk):
                    here, start = chunk == c, int(c) * CHUNK
                    bytes_here = _chunk(data, start, CHUNK, length)
                    full = bucket_ids(bytes_here, (length,))[length]
                    marks = prefix_marks(bytes_here, length)
                    sizes = (last[here] - first[here] + 1).astype(np.int64)
                    at = np.arange(sizes.sum()) + (first[here] - start - (np.cumsum(sizes) - sizes)).repeat(sizes)
                    found = pair_ids(full[at], key[here].view(np.uint64).repeat(sizes))
                    none = np.zeros(len(at))
                    parts.append(_entries(found, marks[at], doc.as_py(), of.as_py(), at + start, none))
                    held += len(at)
                    if held >= FLUSH:
                        yield from _flushed(parts, buckets, False)
                        parts, held = [], 0
        if parts:
            yield from _flushed(parts, buckets, False)

    return run


def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What several tasks have sent for one bucket of keys, sorted together; packs come sorted by bucket and kind."""

    def opened(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        e = _join([_unpack(r) for r in rows])
        if rows[0]["kind"] != _SENT:
            yield _spans(e, rows[0]["kind"])
        else:
            decided, still_open, _ = _sort_out(e, last=True)
            yield _spans(_merged(decided), _DECIDED)
            yield _spans(still_open, _OPEN)

    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["kind"] != _SENT or (row["bucket"], row["kind"]) != (held[0]["bucket"], held[0]["kind"])):
                yield from opened(held)
                held = []
            held.append(row)
    if held:
        yield from opened(held)


def _found(packs: DataFrame) -> DataFrame:
    """Spans found by the tasks that read texts, and by those that compare what the tasks have sent."""
    return packs.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_gathered, _SPANS)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(F.col(text_col)).alias("text")).select(
        "doc_id", F.hash("text").alias("variant"), F.col("text").cast("binary").alias("text")
    )


def _with(texts: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Texts with what was found in them. Every use has the same left side, so that one shuffle of the texts does."""
    found = found.withColumnsRenamed({"doc_id": "id", "variant": "v"})
    return texts.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("variant") == F.col("v")), how).drop("id", "v")


def repeated_windows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH
) -> DataFrame:
    """doc_id, variant and spans (first, last): the starts of all strings of `length` bytes that start anywhere else too.

    variant is a hash of the text which tells rows of one doc_id apart. Spans of a text may touch or overlap. Texts are
    UTF-8 bytes; null counts as empty; texts shorter than length, and texts with nothing repeated, give no row. Every row
    of docs counts as a text of its own, so an equal text under the same or a null id is a repetition. Ids are whole
    numbers of up to 64 bits. Strings are compared by a 64-bit bucket identifier and a second, independent one of 24 bits.

    A text is read in chunks of windows, so a very long one costs its bytes and one chunk's buckets.

    Each task sorts its own entries first: of one identifier it sends one, and of one bucket two at most, so a passage in
    a third of all texts costs each receiving task a few entries for each sending task.
    """
    texts = _texts(docs, id_col, text_col)
    total = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(64, -(-total // RANGE_BYTES))
    long = texts.filter(F.octet_length("text") >= length)
    pointers = stored(_found(long.mapInArrow(_run_batches(buckets, length), _PACKS)))
    opened = (
        pointers.filter(F.col("kind") == _OPEN)
        .groupBy("doc_id", "variant")
        .agg(F.collect_list(F.struct("first", "last", "key")).alias("opened"))
    )
    again = _with(texts, opened, "inner").select("doc_id", "variant", "text", "opened")
    windows = _found(again.mapInArrow(_window_batches(buckets, length), _PACKS))
    return (
        pointers.unionByName(windows)
        .filter(F.col("kind") == _DECIDED)
        .groupBy("doc_id", "variant")
        .agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    )


def _removed(spans: pa.ListScalar, length: int) -> tuple[list[int], list[int]]:
    """Starts and ends (exclusive) of the maximal runs of bytes that the windows of spans cover."""
    first, last = (c.to_numpy().astype(np.int64) for c in spans.values.flatten())
    order = np.argsort(first, kind="stable")
    first, ends = first[order], np.maximum.accumulate(last[order] + length)
    new = np.r_[True, first[1:] > ends[:-1]]
    return first[new].tolist(), ends[np.r_[new[1:], True]].tolist()


def _cut(length: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, spans in zip(*(batch.column(i) for i in range(3)), strict=True):
                data = memoryview(text.as_buffer())
                starts, ends = _removed(spans, length) if spans.is_valid else ([], [])
                kept = b"".join(data[a:b] for a, b in zip([0, *ends], [*starts, len(data)], strict=True))
                rows.append((doc.as_py(), len(data), len(data) - len(kept), len(starts), kept))
            columns = list(zip(*rows, strict=True)) if rows else [[], [], [], [], []]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """For each row of docs: doc_id, n_bytes, n_removed, n_spans and kept, the bytes that no repeated string covers.

    See repeated_windows for what counts as repeated. kept is binary, as a cut may fall inside a character.
    """
    texts = _texts(docs, id_col, text_col)
    found = repeated_windows(docs, id_col, text_col, length)
    return _with(texts, found, "left").select("doc_id", "text", "spans").mapInArrow(
        _cut(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )


def repeats_digest(cut: DataFrame) -> DataFrame:
    return cut.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )

