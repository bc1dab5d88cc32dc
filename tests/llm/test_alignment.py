from __future__ import annotations

import hashlib
from collections import Counter
from itertools import accumulate

import pytest
import sentencepiece
import tokenizers

from emberline.llm import alignment, bpe
from emberline.llm.queries import BYTE_BPE, MODEL, op13_alignment

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(rows):
    """By the libraries, one token after the other."""
    t, sp = tokenizers.Tokenizer.from_file(BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    t.encode_special_tokens = True
    letters = {v: ord(k) for k, v in bpe.byte_letters().items()}
    a_bytes = lambda i: bytes(letters[c] for c in t.id_to_token(i))
    b_bytes = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    found = []
    for doc_id, text in rows:
        a, b = (t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        if {b"".join(map(a_bytes, a)), b"".join(map(b_bytes, b))} != {(" " + text).encode() if text else b""}:
            a, b = [], []
        ends = [list(accumulate(len(of(i)) for i in ids)) for ids, of in ((a, a_bytes), (b, b_bytes))]
        shared = sorted(set(ends[0]) & set(ends[1]))
        sides = [[[x for x, e in zip(ids, at, strict=True) if low < e <= high] for low, high in zip([0, *shared], shared, strict=False)] for ids, at in zip((a, b), ends, strict=True)]
        groups = list(zip(*sides, strict=True))
        found.append((doc_id, a, b, groups, Counter((x, y) for left, right in groups for x in left for y in right)))
    counts = Counter(p for *_, links in found for p in links)
    most = {}
    for (x, _), n in counts.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for doc_id, a, b, groups, links in found:
        spelled = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(n for p, n in links.items() if counts[p] == most[p[0]])
        sha = hashlib.sha256(spelled.encode()).hexdigest() if groups else ""
        out.append((doc_id, len(a), len(b), len(groups), sum(links.values()), best, sum(n * counts[p] for p, n in links.items()), sha))
    return sorted(out, key=str)


def plain(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=str)


ODD = ["two  blanks\nand\tmore ", "▁ is no blank", "é" * 40, "don't <|endoftext|> </s>", "漢字かな ☃☃ 👩‍👩‍👧", " leading", "x\x00y", "a" * 300, "0x41 <0x41>", " wide "]


@pytest.mark.parametrize("hot", [1 << 18, 40, 0])
def test_small_rows_whatever_is_broadcast(docs, hot):
    rows = docs(*[(i, t) for i, t in enumerate(ODD)], (100, None), (101, ""), (None, "two  blanks"), (5, "two  blanks"), (5, "two  blanks"), (7, "the cat and the dog and the cat. " * 30))
    got = alignment.correspondence(rows, BYTE_BPE, MODEL, hot=hot)
    assert got.columns == COLUMNS
    assert plain(got) == brute([(r["doc_id"], r["text"]) for r in rows.collect()])


def test_query_against_brute_force(spark, documents, tmp_path):
    """Short texts of the table, as the brute force is slow."""
    rows = documents.where("length(text) < 800")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    assert plain(op13_alignment(spark, str(tmp_path))) == brute([(r["doc_id"], r["text"]) for r in rows.collect()])


def test_query_on_a_whole_table_counts_as_the_libraries_do(spark, documents):
    t, sp = tokenizers.Tokenizer.from_file(BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    t.encode_special_tokens = True
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    for r in op13_alignment(spark, "/root/testdata/sf0.001").collect():
        text = texts[r["doc_id"]]
        assert (r["n_a"], r["n_b"]) == ((len(t.encode(" " + text, add_special_tokens=False).ids), len(sp.encode(text))) if text else (0, 0))


def test_windows_are_cut_at_blanks_and_remembered():
    a = alignment.Aligner(BYTE_BPE, MODEL)
    a.align(["one two three one two three"])
    assert 0 < len(a.windows) <= 4  # a last window ends with the text
    before = len(a.windows)
    a.align(["three two one two three"])
    assert len(a.windows) <= before + 2


def test_forgotten_windows(monkeypatch):
    texts = [f"some words {i} and w{i * 37 % 101}" for i in range(60)]
    whole = alignment.Aligner(BYTE_BPE, MODEL).align(texts)
    monkeypatch.setattr(alignment, "WINDOWS", 5)
    a = alignment.Aligner(BYTE_BPE, MODEL)
    parts = [a.align([t]) for t in texts]
    assert [p["groups_sha256"][0] for p in parts] == whole["groups_sha256"]
    assert [int(p["n_links"][0]) for p in parts] == whole["n_links"].tolist()


def test_least_hot_count(spark):
    counts = spark.createDataFrame([(1, n) for n in [1] * 50 + [2] * 20 + [9] * 5 + [100] * 3], "a int, count long")
    assert alignment.hot_from(counts, 0) > 100
    assert alignment.hot_from(counts, 3) == 100
    assert alignment.hot_from(counts, 8) == 9
    assert alignment.hot_from(counts, 1000) == 1


def test_empty_table(docs):
    assert alignment.correspondence(docs((1, "x")).limit(0), BYTE_BPE, MODEL).collect() == []


def test_aligning_is_without_the_cycle_collector():
    import gc

    seen = []
    gc.callbacks.append(lambda phase, info: seen.append(phase))
    try:
        texts = [" ".join(f"w{i}x{j}y" for j in range(200)) for i in range(200)]
        found = alignment.Aligner(BYTE_BPE, MODEL)
        seen.clear()
        found.align(texts)
        assert seen.count("start") <= 1 and gc.isenabled()  # one may follow at the end
    finally:
        gc.callbacks.pop()


def test_new_windows_are_aligned_together(monkeypatch):
    """All windows of a batch in one call, one after the other alike; repeated ids within a window count their links."""
    texts = [*ODD, "", " ".join(f"w{i}é{i * 37 % 101}" for i in range(300)), "ab" * 200 + " x" * 50]
    calls = []
    learn = alignment.Windows.learn
    monkeypatch.setattr(alignment.Windows, "learn", lambda w: (calls.append(len(w.new)), learn(w))[1])
    whole = alignment.Aligner(BYTE_BPE, MODEL).align(texts)
    assert len(calls) == 1 and calls[0] > 200
    a = alignment.Aligner(BYTE_BPE, MODEL)
    parts = [a.align([t]) for t in texts]
    for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_pairs"):
        assert [p[c][0] for p in parts] == list(whole[c])
    for c in ("pair", "links"):
        assert [x for p in parts for x in p[c].tolist()] == whole[c].tolist()
    assert int(whole["links"].max()) > 1 and int(whole["links"].sum()) == int(whole["n_links"].sum())
