"""SentencePiece encoding and decoding of whole texts with a merge-type (BPE) vocabulary.

Adjacent symbols merge in the order of an agenda: the pair whose joined piece has the highest score is merged first, the
leftmost of equals, until no adjacent pair is a piece. Characters that are no piece become byte pieces.

Texts are cut between characters that no piece holds side by side, as before a space after a letter, and the distinct
segments of an Arrow batch are encoded once. Short segments have their agendas as rows of one matrix of ranks:
each step merges the least pair of every row. Long segments and those with unknown characters have a heap each.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the model format: the mark that stands for a space, kinds of pieces, the surface of the unknown piece.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
PIECES_FIELD, TRAINER_FIELD, NORMALIZER_FIELD = 1, 2, 3
MODEL_TYPE_BPE = 2

#: Characters of a segment whose agenda is a row of a matrix; rows of a matrix.
WIDTHS, ROWS = (8, 16, 32), 1 << 14
#: Characters of a part of a long text, and of the texts that are worked on together.
PART, TOGETHER = 1 << 20, 1 << 21
#: Segments in a text that the library encodes to check them.
CHECKED = 64
_NONE = np.int64(1) << 40


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, value) of a protocol buffer message."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(message):
        key, at = number(at)
        width = {0: 0, 1: 8, 5: 4}.get(key & 7)
        if width == 0:
            value, at = number(at)
        else:
            if width is None:
                width, at = number(at)
            value, at = message[at : at + width], at + width
        yield key >> 3, value


class PieceModel:
    """A vocabulary with scores, ready to encode and decode.

    Models of another kind than BPE, with a character map, that strip spaces, or with pieces of the kinds user-defined and
    unused are refused: their rules are not those below.
    """

    def __init__(self, model: bytes):
        top: dict[int, list] = {}
        for field, value in _fields(model):
            top.setdefault(field, []).append(value)
        trainer = dict(_fields(top[TRAINER_FIELD][0]))
        rules = dict(_fields(top[NORMALIZER_FIELD][0]))
        self.dummy_prefix = bool(rules.get(3, 1))
        if trainer.get(3) != MODEL_TYPE_BPE or not trainer.get(35) or trainer.get(24):
            raise ValueError("the model must be of type BPE with byte pieces, and mark spaces before words")
        if rules.get(2) or rules.get(4, 1) or not rules.get(5, 1):
            raise ValueError("the model must not change characters or strip spaces")
        self.pieces, self.kinds, self.ids, scores = [], [], {}, {}
        self.bytes: dict[int, int] = {}
        named = {}
        for at, entry in enumerate(top[PIECES_FIELD]):
            parts = dict(_fields(entry))
            piece, kind = parts[1].decode(), parts.get(3, NORMAL)
            self.pieces.append(piece)
            self.kinds.append(kind)
            named[piece] = at
            if kind == NORMAL:
                self.ids[piece] = at
                scores[piece] = struct.unpack("<f", parts[2])[0]
            elif kind == BYTE:
                self.bytes[at] = int(piece[3:-1], 16)
            elif kind in (USER, UNUSED):
                raise ValueError("user-defined and unused pieces are not supported")
        #: Ranks of scores: 0 is the highest, equal scores have equal ranks.
        ranks = {score: rank for rank, score in enumerate(sorted(set(scores.values()), reverse=True))}
        self.order = {piece: ranks[score] for piece, score in scores.items()}
        self.byte_ids = {value: at for at, value in self.bytes.items()}
        self.bos = named[_text(trainer.get(46), "<s>")]
        self.eos = named[_text(trainer.get(47), "</s>")]
        self.unknown_surface = _text(trainer.get(44), " ⁇ ")
        #: Two neighbours that no piece holds side by side can never be merged over, so texts may be cut between them.
        self.joined = {piece[i : i + 2] for piece in self.ids for i in range(len(piece) - 1)}
        if not self.dummy_prefix or any(p[1] == MARK != p[0] or "\n" in p for p in self.joined):
            raise ValueError("the model must prefix texts with a space and have no piece across words or lines")
        #: The same by bytes: no cut inside a character, nor between characters whose outer bytes meet inside a piece.
        self.cut = np.ones((256, 256), bool)
        self.cut[:, 128:192] = False
        for a, b in self.joined:
            self.cut[a.replace(MARK, " ").encode()[-1], b.replace(MARK, " ").encode()[0]] = False
        self._pair_table()
        surfaces = [
            bytes([self.bytes[i]]) if kind == BYTE
            else b"" if kind == CONTROL
            else (self.unknown_surface if kind == UNKNOWN else piece.replace(MARK, " ")).encode()
            for i, (piece, kind) in enumerate(zip(self.pieces, self.kinds))
        ]
        self.surfaces = pa.array(surfaces, pa.large_binary())
        self.control = np.array([kind == CONTROL for kind in self.kinds])
        self.marked = np.array([kind == NORMAL and p.startswith(MARK) for p, kind in zip(self.pieces, self.kinds)])

    def _pair_table(self) -> None:
        """Which two pieces join to which piece, as sorted keys; and the id of each character (a space for the mark)."""
        pairs = {}
        for piece, joined in self.ids.items():
            for i in range(1, len(piece)):
                if piece[:i] in self.ids and piece[i:] in self.ids:
                    pairs[self.ids[piece[:i]] << 32 | self.ids[piece[i:]]] = joined
        self.pair_keys = np.array(sorted(pairs), np.int64)
        joined = np.array([pairs[k] for k in sorted(pairs)], np.int64)
        ranks = np.array([self.order.get(p, 0) for p in self.pieces], np.int64)
        #: Rank above, joined piece below: the least value of a row is its best pair.
        self.pair_values = ranks[joined] << 20 | joined
        slots = 1 << 19
        self.slots = np.full(slots, -1, np.int32)
        at = self._slot(self.pair_keys)
        self.slots[at] = np.arange(len(at), dtype=np.int32)
        lost = self.slots[at] != np.arange(len(at))
        #: Pairs that share a slot with another are looked up by search.
        self.shared = np.zeros(slots, bool)
        self.shared[at[lost]] = True
        single = [(ord(p), i) for p, i in self.ids.items() if len(p) == 1]
        self.chars = np.full(max(c for c, _ in single) + 2, -1, np.int64)
        for char, one in single:
            self.chars[char] = one
        self.chars[32] = self.ids.get(MARK, -1)
        #: Characters that stand in longer pieces without being pieces themselves: such segments go to the heap.
        odd = {c for piece in self.ids for c in piece if c not in self.ids}
        self.odd = bool(odd)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(45)).astype(np.int64)

    def _joins(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank << 20 | piece for pairs of piece ids (-1: none); _NONE where they don't join."""
        keys = left << 32 | right
        slot = self._slot(keys)
        at = self.slots[slot]
        hard = np.flatnonzero(self.shared[slot])
        if len(hard):
            at[hard] = np.minimum(np.searchsorted(self.pair_keys, keys[hard]), len(self.pair_keys) - 1)
        fits = (at >= 0) & (left >= 0) & (right >= 0)
        fits &= self.pair_keys[at] == keys
        return np.where(fits, self.pair_values[at], _NONE)

    def _matrix(self, symbols: np.ndarray) -> np.ndarray:
        """Rows of piece ids of single characters (-1 at their ends) merged; a piece stays at its first character."""
        rows, width = symbols.shape
        symbols = symbols.copy()
        after = np.tile(np.arange(1, width + 1), (rows, 1))
        before = np.tile(np.arange(-1, width - 1), (rows, 1))
        agenda = np.full((rows, width), _NONE)
        agenda[:, :-1] = self._joins(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(rows, width - 1)
        live = np.arange(rows)
        while len(live):
            # Equal ranks: the leftmost, whatever the joined pieces.
            left = (agenda[live] >> 20).argmin(axis=1)
            best = agenda[live, left]
            some = best < _NONE
            live, left, best = live[some], left[some], best[some]
            right = after[live, left]
            symbols[live, left] = best & 0xFFFFF
            symbols[live, right] = -1
            agenda[live, right] = _NONE
            stop = after[live, right]
            after[live, left] = stop
            inside = stop < width
            before[live[inside], stop[inside]] = left[inside]
            follow = np.where(inside, symbols[live, np.minimum(stop, width - 1)], -1)
            agenda[live, left] = self._joins(symbols[live, left], follow)
            first = before[live, left]
            held = first >= 0
            rows_, first = live[held], first[held]
            agenda[rows_, first] = self._joins(symbols[rows_, first], symbols[rows_, left[held]])
        return symbols

    def encode_segments(self, segments: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all segments (large strings, spaces unmarked) one after the other, and where each begins and ends."""
        n = len(segments)
        sizes = pc.utf8_length(segments).to_numpy(zero_copy_only=False).astype(np.int64)
        data = np.frombuffer(segments.buffers()[2], np.uint8) if n else np.zeros(0, np.uint8)
        ends = np.frombuffer(segments.buffers()[1], np.int64)[segments.offset : segments.offset + n + 1]
        points = np.frombuffer(data[ends[0] : ends[-1]].tobytes().decode().encode("utf-32-le"), "<u4").astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        known = self.chars[np.minimum(points, len(self.chars) - 1)]
        strange = np.concatenate([[0], np.cumsum(known < 0)])
        slow = (strange[starts[1:]] > strange[starts[:-1]]) | (sizes > WIDTHS[-1]) | self.odd
        parts: list[np.ndarray | None] = [None] * n
        counts = np.zeros(n, np.int64)
        flat = []
        least = 0
        for width in WIDTHS:
            chosen = np.flatnonzero(~slow & (sizes > least) & (sizes <= width))
            least = width
            for at in range(0, len(chosen), ROWS):
                some = chosen[at : at + ROWS]
                places = starts[some][:, None] + np.arange(width)
                inside = np.arange(width) < sizes[some][:, None]
                merged = self._matrix(np.where(inside, known[np.minimum(places, len(known) - 1)], -1))
                alive = merged >= 0
                counts[some] = alive.sum(axis=1)
                flat.append((some, merged[alive]))
        for one in np.flatnonzero(slow).tolist():
            ids = self._segment(segments[one].as_py().replace(" ", MARK))
            counts[one] = len(ids)
            parts[one] = np.array(ids, np.int64)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(bounds[-1], "<u4")
        for some, ids in flat:
            out[_spread(bounds[some], counts[some])] = ids
        for one in np.flatnonzero(slow).tolist():
            out[bounds[one] : bounds[one + 1]] = parts[one]
        return out, bounds

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], pa.Array, np.ndarray, np.ndarray]:
        """The ids of each text without begin and end; the distinct segments, their ids and bounds."""
        marked = [(" " + t.replace(MARK, " ")).encode() if t else b"" for t in texts]
        data = np.frombuffer(b"".join(marked), np.uint8)
        text_ends = np.concatenate([[0], np.cumsum([len(m) for m in marked])]).astype(np.int64)
        first = np.zeros(len(data) + 1, bool)
        first[1:-1] = self.cut[data[:-1], data[1:]]
        first[text_ends] = True
        cuts = np.flatnonzero(first).astype(np.int64)
        buffers = [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(data.tobytes())]
        segments = pa.Array.from_buffers(pa.large_string(), max(0, len(cuts) - 1), buffers).dictionary_encode()
        which = segments.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        held, bounds = self.encode_segments(segments.dictionary)
        counts = (bounds[1:] - bounds[:-1])[which]
        ids = held[_spread(bounds[which], counts)]
        done = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(cuts, text_ends)]
        return [ids[a:b] for a, b in zip(done[:-1], done[1:])], segments.dictionary, held, bounds

    def _segment(self, text: str) -> list[int]:
        joined, ids, start = self.joined, [], 0
        for at in range(1, len(text)):
            if text[at - 1 : at + 1] not in joined:
                ids += self._merged(text[start:at])
                start = at
        ids += self._merged(text[start:])
        return ids

    def _merged(self, text: str) -> list[int]:
        """The agenda over one stretch: numbers of rank, left end and size of a pair, the least first.

        A symbol is known by its first character; end[i] is 0 once it is merged away. A pair is stale if its size is no
        longer that of the two symbols now at its place: symbols only grow.
        """
        n, order = len(text), self.order
        bits = n.bit_length()
        low = (1 << bits) - 1
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            rank = order.get(text[i : i + 2])
            if rank is not None:
                agenda.append((rank << bits | i) << bits | 2)
        heapq.heapify(agenda)
        while agenda:
            best = heapq.heappop(agenda)
            left = best >> bits & low
            stop = left + (best & low)
            right = end[left]
            if not right or right >= n or end[right] != stop:
                continue
            end[left], end[right] = stop, 0
            if stop < n:
                before[stop] = left
                rank = order.get(text[left : end[stop]])
                if rank is not None:
                    heapq.heappush(agenda, (rank << bits | left) << bits | (end[stop] - left))
            first = before[left]
            if first >= 0:
                rank = order.get(text[first:stop])
                if rank is not None:
                    heapq.heappush(agenda, (rank << bits | first) << bits | (stop - first))
        ids, at = [], 0
        while at < n:
            stop = end[at]
            one = self.ids.get(text[at:stop])
            if one is None:
                ids += [self.byte_ids[b] for b in text[at:stop].encode()]
            else:
                ids.append(one)
            at = stop
        return ids

    def decode_all(self, held: list[np.ndarray]) -> list[str]:
        """The texts of lists of ids."""
        ends = np.concatenate([[0], np.cumsum([len(ids) for ids in held])]).astype(np.int64)
        ids = np.concatenate([*held, np.zeros(0, "<u4")]).astype(np.int64)
        lists = pa.LargeListArray.from_arrays(pa.array(ends), self.surfaces.take(pa.array(ids)))
        out = []
        for at, said in enumerate(pc.binary_join(lists, pa.scalar(b"", pa.large_binary())).to_pylist()):
            own = held[at]
            plain = np.flatnonzero(~self.control[own])
            if len(plain) and len(plain) != plain[-1] - plain[0] + 1:
                out.append(self.decode(own.tolist()))  # begin or end marks inside may cut a character
                continue
            try:
                text = said.decode()
            except UnicodeDecodeError:
                text = self.decode(own.tolist())
            else:
                text = text[1:] if len(plain) and self.marked[own[plain[0]]] else text
                text = text.replace(MARK, " ")
            out.append(text)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: bytes that are no character become U+FFFD each, one leading mark of a space is dropped."""
        out: list[str] = []
        run = bytearray()
        first = True
        for one in ids:
            kind = self.kinds[one]
            if kind == BYTE:
                run.append(self.bytes[one])
                continue
            if run:
                out.append(_characters(bytes(run)))
                run.clear()
                first = False
            if kind == UNKNOWN:
                out.append(self.unknown_surface)
                first = False
            elif kind != CONTROL:
                piece = self.pieces[one]
                if first and piece.startswith(MARK):
                    piece = piece[1:]
                first = False
                out.append(piece)
        if run:
            out.append(_characters(bytes(run)))
        return "".join(out).replace(MARK, " ")


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start, so many as counted, one list after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _text(value: bytes | None, default: str) -> str:
    return value.decode() if value else default


def _characters(run: bytes) -> str:
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(run):
            for size in range(1, 5):
                try:
                    out.append(run[at : at + size].decode())
                    break
                except UnicodeDecodeError:
                    size = 1
            else:
                out.append("�")
            at += len(out[-1].encode()) if out[-1] != "�" or run[at : at + 3] == b"\xef\xbf\xbd" else 1
        return "".join(out)


@lru_cache(maxsize=2)
def _loaded(model: bytes) -> tuple[PieceModel, sentencepiece.SentencePieceProcessor]:
    """The model and the library's, once for each worker process."""
    return PieceModel(model), sentencepiece.SentencePieceProcessor(model_proto=model)


_CUT = re.compile(f"(?<=[^ {MARK}]) (?=[^ {MARK}])")


def _parts(text: str) -> list[str]:
    """text in parts of some PART characters, cut at single spaces (dropped): a part's own prefix stands for the space."""
    if len(text) <= 2 * PART:
        return [text]
    parts, at = [], 0
    while at < len(text):
        hit = _CUT.search(text, at + PART)
        parts.append(text[at : hit.start() if hit else len(text)])
        at = hit.end() if hit else len(text)
    return parts


def _confirmed(library, segments: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> bool:
    """Whether the library gives these ids for all segments. Words stand behind each other, CHECKED in a text.

    Segments that don't begin with a space, or hold nothing else, are encoded between line ends.
    """
    if not len(segments):
        return True
    word = pc.and_(pc.starts_with(segments, " "), pc.not_equal(pc.utf8_ltrim(segments, " "), ""))
    words = segments.filter(word)
    own = np.flatnonzero(word.to_numpy(zero_copy_only=False))
    counts = bounds[own + 1] - bounds[own]
    mine = ids[_spread(bounds[own], counts)]
    ends = np.concatenate([[0], np.cumsum(counts)])
    places = np.frombuffer(words.buffers()[1], np.int64)[: len(words) + 1] if len(words) else np.zeros(1, np.int64)
    data = words.buffers()[2] if len(words) else b""
    steps = list(range(0, len(words), CHECKED))
    stops = [min(at + CHECKED, len(words)) for at in steps]
    said = [data[places[a] + 1 : places[b]].to_pybytes().decode() for a, b in zip(steps, stops)]
    wanted = [mine[ends[a] : ends[b]] for a, b in zip(steps, stops)]
    head = library.encode("\n")
    for at in np.flatnonzero(~word.to_numpy(zero_copy_only=False)).tolist():
        segment = segments[at].as_py()
        said.append("\n" + segment + "\n")
        wanted.append(np.concatenate([head, ids[bounds[at] : bounds[at + 1]], head[-1:]]))
    theirs = library.encode(said, num_threads=1)
    return all(len(a) == len(b) and np.array_equal(a, b) for a, b in zip(theirs, wanted))


def _in_groups(sizes: list[int]) -> Iterator[slice]:
    """Stretches of rows of some TOGETHER characters in all; a larger row stands alone."""
    start = held = 0
    for at, size in enumerate(sizes):
        if at > start and held + size > TOGETHER:
            yield slice(start, at)
            start, held = at, 0
        held += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def _encoder(model: bytes, whole: bool):
    def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, library = _loaded(model)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for rows in _in_groups(sizes):
                ids, texts = (c[rows.start : rows.stop] for c in batch.columns)
                parts = [_parts(text or "") for text in texts.to_pylist()]
                found, segments, held, bounds = own.encode([part for one in parts for part in one])
                same = not whole and _confirmed(library, segments, held, bounds)
                out, agrees, at = [], [], 0
                for one in parts:
                    mine = np.concatenate([[own.bos], *found[at : at + len(one)], [own.eos]]).astype("<u4")
                    at += len(one)
                    out.append(mine.tobytes())
                    agrees.append(same or mine[1:-1].tolist() == [i for p in library.encode(one, num_threads=1) for i in p])
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(out, pa.binary()), pa.array(agrees, pa.bool_())], ["doc_id", "ids", "agrees"]
                )

    return encoded


def _decoder(model: bytes):
    def decoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, library = _loaded(model)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for rows in _in_groups(sizes):
                names, held, same = (c[rows.start : rows.stop] for c in batch.columns)
                ids = [np.frombuffer(one or b"", "<u4") for one in held.to_pylist()]
                texts = own.decode_all(ids)
                theirs = library.decode([one.tolist() for one in ids], num_threads=1)
                agrees = [bool(s) and mine == other for s, mine, other in zip(same.to_pylist(), texts, theirs)]
                yield pa.RecordBatch.from_arrays(
                    [names, held, pa.array(agrees, pa.bool_()), pa.array(texts, pa.string())],
                    ["doc_id", "ids", "agrees", "decoded"],
                )

    return decoded


def _model_bytes(model_path: str) -> bytes:
    with open(model_path, "rb") as file:
        model = file.read()
    PieceModel(model)
    return model


def _rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary, agrees boolean"


def encode_pieces(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", whole: bool = False
) -> DataFrame:
    """Every row's id as doc_id, ids (binary: little-endian unsigned 32-bit numbers, begin and end included), agrees.

    agrees says whether the library gives the same ids. Batch by batch it encodes every distinct segment; if one differs,
    it encodes every text of the batch. With whole it encodes every text at once, which takes several times as long.

    A null or empty text has begin and end only. Very long texts are encoded in parts of some 2^20 characters, cut at
    single spaces, where nothing merges; a segment of more than 32 characters costs some 100 bytes a character. Equal rows
    give equal rows, an empty table gives none, and other columns of docs play no part, whatever their names. The model
    file is read on the driver; its bytes (some hundred KB, a vocabulary's size) travel with the tasks.
    """
    rows, schema = _rows(docs, id_col, text_col)
    return rows.mapInArrow(_encoder(_model_bytes(model_path), whole), schema)


def decode_pieces(encoded: DataFrame, model_path: str) -> DataFrame:
    """The rows of encode_pieces with decoded, the text of ids; agrees also says whether the library decodes alike.

    Ids of begin and end have no text. Null ids count as none. The decoded text is that which was encoded, with the mark
    U+2581 as a space.
    """
    kind = encoded.schema["doc_id"].dataType.simpleString()
    rows = encoded.select("doc_id", "ids", "agrees")
    schema = f"doc_id {kind}, ids binary, agrees boolean, decoded string"
    return rows.mapInArrow(_decoder(_model_bytes(model_path)), schema)


def encode_and_decode(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """decode_pieces of encode_pieces, both in one worker: ids go from one to the other as Arrow batches."""
    rows, schema = _rows(docs, id_col, text_col)
    model = _model_bytes(model_path)
    encoder, decoder = _encoder(model, False), _decoder(model)
    return rows.mapInArrow(lambda batches: decoder(encoder(batches)), f"{schema}, decoded string")


def pieces_digest(decoded: DataFrame) -> DataFrame:
    """Counts and digests of ids and of decoded texts."""
    return decoded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        "agrees",
    )
