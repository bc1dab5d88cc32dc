from __future__ import annotations

import hashlib

import numpy as np
import pytest
import tokenizers
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from emberline.llm import bpe
from emberline.llm.queries import BYTE_BPE, WORD_BPE, op11_bpe

ODD = ["<|endoftext|>", "a<|endoftext|> <|startoftext|>B", "ΑΣ Σ ς", "é É ﬁ İ", "x\x1cy \x85\xa0　", "Ᲊ Ɤ ՘ \U00016ea0", "the" * 2000, "漢字" * 3000, "!" * 4000, " " * 90 + "x", "\r\n \t", "don't IT'S 'll", "1234 ½ ² ١", "👩‍👩‍👧 ☃", "\x00\x01"]


@pytest.fixture(scope="module")
def library():
    def load(path):
        t = tokenizers.Tokenizer.from_file(path)
        t.encode_special_tokens = path == BYTE_BPE
        return t

    return {p: (bpe.tokenizer(p, p == WORD_BPE), load(p)) for p in (WORD_BPE, BYTE_BPE)}


def assert_same(pair, texts):
    own, lib = pair
    ids, n = own.encode(texts)
    ends = np.concatenate(([0], np.cumsum(n)))
    for i, e in enumerate(lib.encode_batch(texts, add_special_tokens=False)):
        assert ids[ends[i] : ends[i + 1]].tolist() == e.ids, texts[i]


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_odd_texts(library, path):
    assert_same(library[path], ODD)


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_all_characters_of_the_plain_way(library, path):
    settled = [c for c in map(chr, [*range(0x3100), *range(0x4E00, 0xAC00), *range(0xAC00, 0xD7B0, 7)]) if not bpe.UNSETTLED.match(c)]
    assert_same(library[path], ["".join(f"x{c}y {c}{c} " for c in settled[i : i + 400]) for i in range(0, len(settled), 400)])


@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text(st.sampled_from("aabbcthein  'sLL12.,!?éÉßΣñ漢字カ한☃́\n▁😀"), max_size=50))
def test_any_text(library, text):
    for pair in library.values():
        assert_same(pair, [text])


def test_words_that_are_forgotten_are_encoded_again(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    own = bpe.Tokenizer(WORD_BPE)
    texts = [f"common words {i} w{i * 7919 % 1000} and more{i}" for i in range(300)]
    for i in range(0, 300, 10):
        assert_same((own, library[WORD_BPE][1]), texts[i : i + 10])
    assert len(own.words) < 200


def test_backtracking_needs_to_take_back():
    core = bpe.Backtracker({"a": 0, "b": 1, "c": 2, "bc": 3, "ab": 4, "abc": 5}, [("b", "c"), ("a", "b")])
    assert core.encode("abc") == [0, 3]  # "ab" is longer than "a", but "bc" is merged first
    assert core.encode("ab") == [4]
    assert core.encode("") == []


def test_a_vocabulary_whose_merges_come_before_their_parts_is_refused():
    with pytest.raises(ValueError, match="before its parts"):
        bpe.Backtracker({"a": 0, "b": 1, "ab": 2, "aba": 3}, [("ab", "a"), ("a", "b")])


def want(text):
    t = tokenizers.Tokenizer.from_file(WORD_BPE)
    ids = t.encode(text or "", add_special_tokens=False).ids
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.decode(ids, skip_special_tokens=False).encode())


def test_query_against_the_library(spark, documents):
    got = {r["doc_id"]: tuple(r)[1:] for r in op11_bpe(spark, "/root/testdata/sf0.001").collect()}
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert got == {k: want(t) for k, t in texts.items()}


def test_odd_rows(odd):
    rows = bpe.digests(bpe.encode_and_decode(odd, WORD_BPE)).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, rows), key=key) == sorted(((r["doc_id"], *want(r["text"])) for r in odd.collect()), key=key)
    assert bpe.digests(bpe.encode_and_decode(odd.limit(0), WORD_BPE)).collect() == []


def test_decoding_stored_ids(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, "Hello wörld's"), (2, ""), (3, None)], "doc_id long, text string")
    ids = bpe.encode(rows, WORD_BPE, [F.col("doc_id")])
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode(ids, WORD_BPE, [F.col("doc_id")]).collect()}
    t = tokenizers.Tokenizer.from_file(WORD_BPE)
    assert got == {1: t.decode(t.encode("Hello wörld's", add_special_tokens=False).ids), 2: "", 3: ""}
