from __future__ import annotations

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberline.llm import pieces, queries

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=queries.MODEL)
ODD = ["", " ", "  ", "a  b", "   x   y  ", "\n\t\té", "☃☃ 漢字かな", "x" * 300, "▁▁a", "<s> <0x0A>", "a\0b", " " * 40, "hello" + " " * 17 + "world", "12345 67.89", "aaaa aaaaaaa", "日本語" * 50, "\r\n\r\n"]


def encoded(texts):
    ids, n = pieces.encoder(queries.MODEL).encode(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts_encode_as_in_the_library(text):
    assert encoded([text]) == [LIBRARY.encode(text)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abeinrst  ▁.,\n\té漢☃1"), max_size=40), min_size=1, max_size=5))
def test_any_texts_encode_as_in_the_library(texts):
    assert encoded(texts) == LIBRARY.encode(texts)


def test_documents_encode_as_in_the_library_and_decode(spark, documents):
    got = {r["doc_id"]: r for r in pieces.encode_and_decode(documents, queries.MODEL).collect()}
    for r in documents.collect():
        assert got[r["doc_id"]]["ids"] == LIBRARY.encode(r["text"])
        assert got[r["doc_id"]]["decoded"] == r["text"] and got[r["doc_id"]]["round_trip"]


def test_decode_of_stored_ids(spark, documents):
    stored = pieces.encode(documents, queries.MODEL, [F.col("doc_id"), F.col("text").alias("_t")])
    back = pieces.decode(stored, queries.MODEL, [F.col("doc_id"), F.col("_t")])
    assert back.where("decoded != _t").count() == 0 and back.count() == documents.count()


def test_odd_rows(odd):
    got = [r for r in pieces.encode_and_decode(odd, queries.MODEL).collect()]
    assert len(got) == 10 and all(r["round_trip"] for r in got)
    assert [r["ids"] for r in got if r["doc_id"] in (1, 2)] == [[], []]
    assert pieces.encode_and_decode(odd.where(F.lit(False)), queries.MODEL).count() == 0
    assert queries.tokens(odd).columns == ["doc_id", "n_ids", "ids_hash", "decoded_sha256", "round_trip"]


def test_occurrences_are_all_places():
    v = pieces.encoder(queries.MODEL).v
    data = "▁banana\0▁internationalization\0".encode()
    x = np.frombuffer(data, np.uint8)
    at = np.flatnonzero((x & 0xC0) != 0x80)
    src, which = pieces.occurrences(data, at, v)
    got = {(int(at[s]), v.shapes[5][w]) for s, w in zip(src, which, strict=True)}
    want = {(int(a), p) for p in v.shapes[5] for a in at if data.startswith(p, a)}
    assert got == want


LONG_WORDS = [p.lstrip("▁") for p in pieces.encoder(queries.MODEL).v.ids if len(p.encode()) > 16 and p.strip("▁")]


def test_words_that_share_16_bytes_encode_as_in_the_library():
    for p in LONG_WORDS:
        for other in (p[:-1], p[:-1] + "x", p[:-2] + p[-1]):
            words = [p, other, p + ",", other + ".", p + "s"]
            pieces.encoder(queries.MODEL).forget()
            assert encoded(words) == LIBRARY.encode(words)
    pieces.encoder(queries.MODEL).forget()
    assert encoded(LONG_WORDS) == LIBRARY.encode(LONG_WORDS)


def test_places_between_two_true_ones_are_no_occurrences():
    v = pieces.encoder(queries.MODEL).v
    data = "▁representations\0▁representation\0▁representations,\0".encode()
    at = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    src, which = pieces.occurrences(data, at, v)
    assert all(data.startswith(v.shapes[5][w], int(at[s])) for s, w in zip(src, which, strict=True))


def test_text_without_blanks_encodes_as_in_the_library():
    chinese = "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。" * 40
    thai = "มนุษย์ทั้งหลายเกิดมามีอิสระและเสมอภาคกันในเกียรติศักดิ์และสิทธิ" * 30
    japanese = "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。" * 40
    mixed = "".join(LONG_WORDS) + chinese[:50] + "internationalization" * 20 + "ab" * 700 + "=" * 900 + "0123456789abcdef" * 60
    texts = [chinese, thai, japanese, mixed, f"a {mixed} b", chinese.replace("。", " ")]
    pieces.encoder(queries.MODEL).forget()
    assert encoded(texts) == LIBRARY.encode(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aeint.=0人的在ไà"), min_size=40, max_size=200), min_size=1, max_size=4))
def test_long_words_encode_as_in_the_library(texts):
    assert encoded(texts) == LIBRARY.encode(texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(LONG_WORDS[:40] + ["s", "x", " ", "e", "ing"]), max_size=6).map("".join), min_size=1, max_size=6))
def test_texts_of_long_pieces_encode_as_in_the_library(texts):
    assert encoded(texts) == LIBRARY.encode(texts)
