from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.llm import audio


def test_law_tables():
    mu, a = audio.mulaw_table(), audio.alaw_table()
    assert (mu[0xFF], mu[0x7F], mu[0x00], mu[0x80]) == (0, 0, -32124, 32124)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    assert len(set(mu.tolist())) == 255 and len(set(a.tolist())) == 256


def slow_adpcm(block: bytes) -> list[int]:
    sample, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [sample]
    for byte in block[4:]:
        for n in (byte & 15, byte >> 4):
            step = int(audio.STEPS[index])
            d = step >> 3
            d += step if n & 4 else 0
            d += step >> 1 if n & 2 else 0
            d += step >> 2 if n & 1 else 0
            sample = max(-32768, min(32767, sample - d if n & 8 else sample + d))
            index = max(0, min(88, index + int(audio.TURNS[n & 7])))
            out.append(sample)
    return out


def test_blocks_decode_as_one_by_one():
    data = np.random.default_rng(1).integers(0, 256, (50, 64), dtype=np.uint8)
    got = audio.decode_blocks(data, at_once=7)
    assert got.tolist() == [slow_adpcm(b.tobytes()) for b in data]


def test_resampling():
    x = np.array([0, 10, -10, 5], np.int16)
    assert audio.resample(x).tolist() == [0, 5, 10, 0, -10, -3, 5, 5]
    assert audio.resample(x, 8000, 8000).tolist() == x.tolist()
    assert len(audio.resample(x, 8000, 12000)) == 6


@pytest.mark.parametrize("tag", [audio.MULAW, audio.ALAW, audio.IMA])
def test_files_keep_their_payload(tag):
    payload = bytes(range(64)) * 2
    assert audio.unwav(audio.wav(payload, tag)) == (tag, payload)
    assert audio.decode([audio.wav(payload, tag)])[0][2].dtype == np.int16


def test_documents_come_back(spark, documents):
    got = {r["doc_id"]: r for r in audio.media_features(documents).collect()}
    kinds = set()
    for r in documents.collect():
        text = r["text"].encode()
        payload = text + bytes(-len(text) % 64 or (0 if text else 64))
        g = got[r["doc_id"]]
        assert (g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"]) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        kinds.add(g["feature"].split(":")[0])
    assert kinds == {"mulaw", "alaw", "ima"}


def test_odd_rows(odd):
    got = audio.media_features(odd).collect()
    assert len(got) == 10
    empty = {tuple(r)[1:] for r in got if r["doc_id"] in (1, 2)}
    assert len(empty) == 1 and next(iter(empty))[:2] == (0, 64)
    assert len({tuple(r)[1:] for r in got if r["doc_id"] == 5}) == 1
    assert audio.media_features(odd.where(F.lit(False))).count() == 0


def slow_media(text: str) -> tuple[bytes, str]:
    """The WAV file and the feature of a text, by plain loops."""
    raw = text.encode()
    payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
    kind = zlib.crc32(raw) % 3  # mu-law, A-law, ADPCM
    tag, align = (7, 6, 0x11)[kind], (1, 1, 64)[kind]
    n = len(payload) // 64 * 121 if kind == 2 else len(payload)
    fmt = b"".join(x.to_bytes(k, "little") for x, k in ((tag, 2), (1, 2), (8000, 4), (8000 * 64 // 121 if kind == 2 else 8000, 4), (align, 2), (4 if kind == 2 else 8, 2)))
    fmt += (2).to_bytes(2, "little") + (121).to_bytes(2, "little") if kind == 2 else (0).to_bytes(2, "little")
    chunks = b"".join(name + len(body).to_bytes(4, "little") + body for name, body in ((b"fmt ", fmt), (b"fact", n.to_bytes(4, "little")), (b"data", payload)))
    media = b"RIFF" + (4 + len(chunks)).to_bytes(4, "little") + b"WAVE" + chunks
    if kind == 2:
        x = [v for i in range(0, len(payload), 64) for v in slow_adpcm(payload[i : i + 64])]
    elif kind == 1:
        x = []
        for c in payload:
            c ^= 0x55
            part, low = (c & 0x70) >> 4, (c & 15) << 4
            size = low + 8 if part == 0 else (low + 0x108) << (part - 1)
            x.append(size if c & 0x80 else -size)
    else:
        x = []
        for c in payload:
            c ^= 0xFF
            size = ((((c & 15) << 3) + 0x84) << ((c & 0x70) >> 4)) - 0x84
            x.append(-size if c & 0x80 else size)
    y = [v for i, a in enumerate(x) for v in (a, (a + x[min(i + 1, len(x) - 1)]) >> 1)]
    sign = sum((a < 0) != (b < 0) for a, b in zip(y, y[1:], strict=False))
    pcm = b"".join(v.to_bytes(2, "little", signed=True) for v in y)
    return media, f"{('mulaw', 'alaw', 'ima')[kind]}:{len(y)}:{max(map(abs, y))}:{math.isqrt(sum(v * v for v in y) // len(y))}:{sign}:{zlib.crc32(pcm):08x}"


def test_media_and_features_against_plain_loops(spark, documents):
    got = {r["doc_id"]: r for r in audio.media_features(documents).collect()}
    for r in documents.where("length(text) < 6000").limit(60).collect():
        media, feature = slow_media(r["text"])
        g = got[r["doc_id"]]
        assert (g["media_bytes"], g["media_sha256"], g["feature"]) == (len(media), hashlib.sha256(media).hexdigest(), feature)


def test_media_and_pcm_are_stored(spark, docs, tmp_path):
    rows = docs((1, "abc"), (2, None), (3, "x" * 1000))
    stored = audio.write_media(rows, str(tmp_path / "media"), codec=F.lit(audio.MULAW))
    assert spark.read.parquet(str(tmp_path / "media")).columns == ["doc_id", "n_bytes", "media", "pcm"]
    got = {r["doc_id"]: r for r in stored.collect()}
    assert len(got[1]["pcm"]) == 2 * 2 * 64 and audio.unwav(bytes(got[1]["media"]))[1] == b"abc".ljust(64, b"\0")
    assert {r["doc_id"]: r["feature"][:10] for r in audio.read(stored).collect()} == {1: "mulaw:128:", 2: "mulaw:128:", 3: "mulaw:2048"}


def test_text_ids(spark):
    rows = spark.createDataFrame([("a", "x"), (None, "x")], "doc_id string, text string")
    assert {r["doc_id"] for r in audio.media_features(rows).collect()} == {"a", None}


@pytest.mark.parametrize("n", [0, 1, 2, 7, 256])
def test_stored_pcm_is_without_loss(n):
    x = np.random.default_rng(n).integers(-32768, 32768, n).astype(np.int16)
    assert len(audio.lifted(x)) == 2 * n and audio.unlifted(audio.lifted(x)).tolist() == x.tolist()


def test_the_query_stores_pcm_and_takes_features_from_it(spark, documents, monkeypatch):
    tables = []
    write = audio.write_media
    monkeypatch.setattr(audio, "write_media", lambda *a, **k: tables.append(write(*a, **k)) or tables[-1])
    got = {r["doc_id"]: r["feature"] for r in audio.media_features(documents.limit(50)).collect()}
    rows = tables[0].collect()
    assert len(rows) == 50
    for r in rows:
        (tag, _, x), y = audio.decode([bytes(r["media"])])[0], audio.unlifted(bytes(r["pcm"]))
        assert y.tolist() == x.tolist() and got[r["doc_id"]] == audio.feature(tag, y)
    other = tables[0].withColumn("pcm", F.lit(audio.lifted(np.array([5, -5], np.int16))))
    assert {r["feature"].split(":", 1)[1] for r in audio.read(other).collect()} == {f"2:5:5:1:{zlib.crc32(np.array([5, -5], '<i2')):08x}"}
