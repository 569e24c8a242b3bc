"""Encoding and decoding against the library, and against a plain search for the best pair."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.llm.pieces import PieceModel, _confirmed, _parts, decode_pieces, encode_and_decode, encode_pieces, pieces_digest
from tests.llm.conftest import CLASHES, ODD, prose

PATH = public_tokenizers.path("piece_bpe_32k.model")
with open(PATH, "rb") as file:
    MODEL = file.read()
OWN = PieceModel(MODEL)
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
ODD_TEXTS = st.text("ab cdetheing\n\t  éè漢字🙂▁<s></s>\x00�⁇12__--==\r\xa0　", max_size=60)


def plain_encode(text):
    """Merge the best pair of the whole text, one at a time."""
    if not text:
        return []
    symbols = list(("▁" + text).replace(" ", "▁"))
    while True:
        pairs = [(OWN.order[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in OWN.order]
        if not pairs:
            break
        _, i = min(pairs)
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
    return [x for s in symbols for x in ([OWN.ids[s]] if s in OWN.ids else [OWN.byte_ids[b] for b in s.encode()])]


@settings(max_examples=400, deadline=None)
@given(st.one_of(ODD_TEXTS, st.text(max_size=60)))
def test_encoding_is_that_of_the_library_and_of_a_plain_search(text):
    (ids,), segments, held, bounds = OWN.encode([text])
    assert ids.tolist() == LIBRARY.encode(text) == plain_encode(text)
    assert OWN.decode_all([ids])[0] == OWN.decode(ids) == LIBRARY.decode(ids.tolist()) == text.replace("▁", " ")
    assert _confirmed(LIBRARY, segments, held, bounds)
    if len(held):
        held[-1] += 1
        assert not _confirmed(LIBRARY, segments, held, bounds)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abtheing ▁\n", max_size=70), max_size=5))
def test_matrix_and_heap_agree_on_many_texts(texts):
    assert [i.tolist() for i in OWN.encode(texts)[0]] == [LIBRARY.encode(t) for t in texts]
    for text in texts:
        assert OWN._segment("▁" + text.replace(" ", "▁")) == (LIBRARY.encode(text) if text else [OWN.ids["▁"]])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31_999)), max_size=14))
def test_decoding_any_ids_is_that_of_the_library(ids):
    assert OWN.decode(ids) == OWN.decode_all([np.array(ids, "<u4")])[0] == LIBRARY.decode(ids)


def test_long_texts_in_parts(monkeypatch):
    monkeypatch.setattr("rankloom.llm.pieces.PART", 50)
    text = "a b  c ▁ d\n e " * 40 + "x" * 900 + prose(300)
    parts = _parts(text)
    assert len(parts) > 20 and sum(map(len, parts)) + len(parts) - 1 == len(text)
    assert np.concatenate(OWN.encode(parts)[0]).tolist() == LIBRARY.encode(text)


def test_rows_of_any_kind(spark, make):
    rows = [*ODD, (9, "<s> </s> <unk>"), (10, "▁▁a "), (11, " "), (12, "�\x00")]
    encoded = encode_pieces(make(rows, CLASHES), PATH)
    whole = encode_pieces(make(rows, CLASHES), PATH, whole=True)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, encoded.collect()))
    together = encode_and_decode(make(rows, CLASHES), PATH)
    assert sorted(map(repr, together.collect())) == sorted(map(repr, decode_pieces(encoded, PATH).collect()))
    out = pieces_digest(decode_pieces(encoded, PATH))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees"]

    def plain(key, text):
        ids = LIBRARY.encode(text or "", add_bos=True, add_eos=True)
        said = LIBRARY.decode(ids).encode()
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        return key, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(said).hexdigest(), True

    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(repr(plain(k, t)) for k, t in rows)


def test_empty_table_and_other_id_types(spark, make):
    assert pieces_digest(decode_pieces(encode_pieces(make([]), PATH), PATH)).count() == 0
    named = spark.createDataFrame([("a", "some text")], "name string, body string")
    out = decode_pieces(encode_pieces(named, PATH, "name", "body"), PATH).first()
    assert (out.doc_id, out.decoded, out.agrees) == ("a", "some text", True)


def test_other_models_are_refused():
    with pytest.raises(ValueError, match="BPE"):
        PieceModel(bytes([0x12, 2, 0x18, 1, 0x1A, 0]))


def test_given_documents(spark):
    from rankloom.llm.queries import op13_sentencepiece

    out = op13_sentencepiece(spark, "/root/testdata/sf0.001")
    assert out.filter("not agrees").count() == 0 and out.count() == 200
