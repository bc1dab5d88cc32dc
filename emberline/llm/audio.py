"""Telephony audio as media columns: mu-law, A-law and IMA ADPCM in WAV, and resampled PCM.

A payload is stored as the samples of a telephone format, so that each byte is one
8-bit sample (mu-law, A-law) or one byte of a 64-byte ADPCM block. Reading back
expands the two laws by lookup tables and decodes the blocks of many rows at once: each
of a block's 120 steps is a numpy step over all blocks.
"""

from __future__ import annotations

import hashlib
import math
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import as_bytes, ensure_checkpoint_dir, map_columns, parts

BLOCK = 64
RATE, TARGET_RATE = 8000, 16000
#: WAVE format tags (fixed values).
MULAW, ALAW, IMA = 7, 6, 0x11
NAMES = {MULAW: "mulaw", ALAW: "alaw", IMA: "ima"}
#: Payload bytes that a task decodes at once.
AT_ONCE = 1 << 22
#: How the media table is written: pages that are long enough for a text's words to recur in them.
COMPRESSED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "12", "parquet.page.size": str(16 << 20), "parquet.enable.dictionary": "false"}
# Fixed values of IMA ADPCM: step sizes and index changes.
STEPS = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767])
TURNS = np.array([-1, -1, -1, -1, 2, 4, 6, 8])


def mulaw_table() -> np.ndarray:
    """PCM of each of the 256 codes of ITU-T G.711 mu-law."""
    code = ~np.arange(256) & 0xFF
    size = ((((code & 15) << 3) + 0x84) << ((code & 0x70) >> 4)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """PCM of each of the 256 codes of ITU-T G.711 A-law."""
    code = np.arange(256) ^ 0x55
    part, low = (code & 0x70) >> 4, (code & 15) << 4
    size = np.where(part == 0, low + 8, (low + 0x108) << np.maximum(part - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


def _adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """By index * 16 + nibble: the change of the sample, and the next index times 16."""
    step, nibble = np.repeat(STEPS, 16), np.tile(np.arange(16), len(STEPS))
    size = (step >> 3) + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
    following = np.clip(np.repeat(np.arange(len(STEPS)), 16) + TURNS[nibble & 7], 0, len(STEPS) - 1)
    return np.where(nibble & 8, -size, size).astype(np.int32), (following * 16).astype(np.int32)


TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}
CHANGE, FOLLOWING = _adpcm_tables()
SAMPLES = 1 + 2 * (BLOCK - 4)


def decode_blocks(data: np.ndarray, at_once: int = 4096) -> np.ndarray:
    """PCM (blocks, 121) of 64-byte IMA ADPCM blocks (blocks, 64): two bytes of first sample, its step index, one unused byte, 120 nibbles, the low one first."""
    out = np.empty((len(data), SAMPLES), np.int16)
    for i in range(0, len(data), at_once):
        some = data[i : i + at_once]
        sample = some[:, :2].copy().view("<i2").ravel().astype(np.int32)
        index = np.minimum(some[:, 2], len(STEPS) - 1).astype(np.int32) * 16
        codes = np.ascontiguousarray(some[:, 4:].T)
        pcm = np.empty((SAMPLES, len(some)), np.int16)
        pcm[0] = sample
        for k in range(2 * (BLOCK - 4)):
            at = index + ((codes[k >> 1] >> 4) if k & 1 else (codes[k >> 1] & 15))
            sample = np.clip(sample + CHANGE[at], -32768, 32767)
            index = FOLLOWING[at]
            pcm[k + 1] = sample
        out[i : i + at_once] = pcm.T
    return out


def resample(x: np.ndarray, rate: int = RATE, to: int = TARGET_RATE) -> np.ndarray:
    """Linear interpolation in whole numbers; the last sample is held."""
    if to == 2 * rate:
        out = np.empty(2 * len(x), np.int16)
        out[::2] = x
        wide = x.astype(np.int32)
        out[1:-1:2] = (wide[:-1] + wide[1:]) >> 1
        out[-1:] = x[-1:]
        return out
    at = np.arange(len(x) * to // rate, dtype=np.int64) * rate
    i, part = at // to, at % to
    y = x.astype(np.int64)
    return ((y[i] * (to - part) + y[np.minimum(i + 1, len(x) - 1)] * part) // to).astype(np.int16)


def lifted(x: np.ndarray) -> bytes:
    """PCM as it is stored, as long as before and without loss: the even samples, then the odd ones less the mean of their neighbours (modulo 2^16), 16-bit little-endian. It compresses to 0.5 bytes a byte of text, samples in order to 0.7."""
    even, odd = x[::2].astype(np.int32), x[1::2].astype(np.int32)
    return np.concatenate((even, odd - means(even, len(odd)))).astype("<i2").tobytes()


def unlifted(data: bytes) -> np.ndarray:
    """PCM from its stored form."""
    y = np.frombuffer(data, "<i2")
    n = (len(y) + 1) // 2
    out, even = np.empty(len(y), np.int16), y[:n].astype(np.int32)
    out[::2], out[1::2] = even, (y[n:] + means(even, len(y) - n)).astype(np.int16)
    return out


def means(even: np.ndarray, n: int) -> np.ndarray:
    """For each of n odd samples the mean of its neighbours, rounded down; the last one may have but one."""
    after = np.append(even[1:], even[-1:])
    return (even[:n] + after[:n]) >> 1


def wav(payload: bytes, tag: int) -> bytes:
    """A WAV file of one channel at 8000 samples a second whose data chunk is the payload."""
    if tag == IMA:
        fmt = struct.pack("<HHIIHHHH", tag, 1, RATE, RATE * BLOCK // SAMPLES, BLOCK, 4, 2, SAMPLES)
    else:
        fmt = struct.pack("<HHIIHHH", tag, 1, RATE, RATE, 1, 8, 0)
    samples = len(payload) // BLOCK * SAMPLES if tag == IMA else len(payload)
    fact = struct.pack("<4sII", b"fact", 4, samples)  # formats other than PCM tell their samples
    size = 4 + 8 + len(fmt) + len(fact) + 8 + len(payload)
    return b"".join((struct.pack("<4sI4s4sI", b"RIFF", size, b"WAVE", b"fmt ", len(fmt)), fmt, fact, struct.pack("<4sI", b"data", len(payload)), payload))


def unwav(media: bytes) -> tuple[int, bytes]:
    """Format tag and data chunk; other chunks are skipped."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, tag = 12, None
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            tag = struct.unpack_from("<H", media, at + 8)[0]
        elif name == b"data":
            return tag, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def payload_of(text: bytes | None) -> bytes:
    """The text and zeros up to a positive multiple of 64 bytes."""
    text = text or b""
    return text.ljust(max(1, -(-len(text) // BLOCK)) * BLOCK, b"\0")


def feature(tag: int, x: np.ndarray) -> str:
    """Format, samples, peak, root mean square, changes of sign, and checksum of resampled PCM."""
    wide = x.astype(np.int64)
    sign = x < 0
    return f"{NAMES[tag]}:{len(x)}:{int(np.abs(wide).max(initial=0))}:{math.isqrt(int(wide @ wide) // max(1, len(x)))}:{np.count_nonzero(sign[1:] != sign[:-1])}:{zlib.crc32(x.astype('<i2')):08x}"


def decode(media: list[bytes]) -> list[tuple[int, bytes, np.ndarray]]:
    """Format tag, payload and resampled PCM of each file; the ADPCM blocks of all are decoded together."""
    read = [unwav(x) for x in media]
    ima = [np.frombuffer(p, np.uint8).reshape(-1, BLOCK) for tag, p in read if tag == IMA]
    pcm = decode_blocks(np.concatenate(ima)) if ima else None
    out, at = [], 0
    for tag, payload in read:
        if tag == IMA:
            n = len(payload) // BLOCK
            x, at = pcm[at : at + n].ravel(), at + n
        else:
            x = TABLES[tag][np.frombuffer(payload, np.uint8)]
        out.append((tag, payload, resample(x)))
    return out


def store(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", codec: Column | None = None, with_pcm: bool = False) -> DataFrame:
    """doc_id, n_bytes and media: a WAV file of each text; with_pcm also pcm, at 16,000 samples a second, as lifted() gives it. codec gives a format tag by row; by default crc32 of the text picks one of the three."""
    tags = F.array(*[F.lit(x) for x in (MULAW, ALAW, IMA)])
    raw = F.coalesce(F.col(text), F.lit(""))
    codec = codec if codec is not None else F.element_at(tags, (F.crc32(raw.cast("binary")) % 3 + 1).cast("int"))
    kind = docs.select(doc_id).schema[0].dataType.simpleString()

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, tag = as_bytes(batch.column(1)), batch.column(2).to_pylist()
        for a, b in parts(texts, AT_ONCE // 4 if with_pcm else AT_ONCE):
            media = [wav(payload_of(t), g) for t, g in zip(texts[a:b], tag[a:b], strict=True)]
            more = [pa.array([lifted(x) for _, _, x in decode(media)], pa.binary())] if with_pcm else []
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([len(t) for t in texts[a:b]], pa.int64()), pa.array(media, pa.binary()), *more], names=["doc_id", "n_bytes", "media", *["pcm"] * with_pcm])

    return map_columns(docs, [F.col(doc_id).alias("doc_id"), raw.alias("text"), codec.cast("int").alias("tag")], f"doc_id {kind}, n_bytes long, media binary" + ", pcm binary" * with_pcm, step)


def write_media(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", codec: Column | None = None, with_pcm: bool = True) -> DataFrame:
    """The media table of docs, written as Parquet at path and read from there. PCM takes 4 to 7.6 bytes for each byte of payload, about 0.5 when compressed; the media take 0.35."""
    store(docs, doc_id, text, codec, with_pcm).write.options(**COMPRESSED).parquet(path)
    return docs.sparkSession.read.parquet(path)


def read(stored: DataFrame) -> DataFrame:
    """What the stored files hold: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the last 64 bytes), media_bytes, media_sha256, feature.

    The feature is that of the stored PCM; of a table without it, of the PCM that the files decode to.
    """
    pcm = "pcm" in stored.columns
    kind = stored.select("doc_id").schema[0].dataType.simpleString()
    kinds = {"doc_id": kind, "n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        media = batch.column(2).to_pylist()
        for a, b in parts(media, AT_ONCE // 4 if pcm else AT_ONCE):
            got = [(*unwav(m), unlifted(x)) for m, x in zip(media[a:b], batch.column(3)[a:b].to_pylist(), strict=True)] if pcm else decode(media[a:b])
            columns = [
                batch.column(0)[a:b],
                batch.column(1)[a:b],
                pa.array([len(p) for _, p, _ in got], pa.int64()),
                pa.array([hashlib.sha256(p).hexdigest() for _, p, _ in got], pa.string()),
                pa.array([zlib.crc32(p[-BLOCK:]) for _, p, _ in got], pa.int64()),
                pa.array([len(m) for m in media[a:b]], pa.int64()),
                pa.array([hashlib.sha256(m).hexdigest() for m in media[a:b]], pa.string()),
                pa.array([feature(tag, x) for tag, _, x in got], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=list(kinds))

    return map_columns(stored, [F.col(c) for c in ("doc_id", "n_bytes", "media", *["pcm"] * pcm)], ", ".join(f"{k} {v}" for k, v in kinds.items()), step)


def media_features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_pcm: bool = True) -> DataFrame:
    """Each text stored as telephony audio and as the resampled PCM it decodes to, in a Parquet table in the shared checkpoint folder, and read back from there; see read().

    A null text is empty: 64 zero bytes. Equal texts give equal values. Ids may be numbers or texts. Rows may repeat; other
    columns are neither read nor returned. An empty table gives no rows. with_pcm: whether the table holds the resampled PCM too.
    """
    folder = f"{ensure_checkpoint_dir(docs.sparkSession)}/media-{uuid.uuid4().hex}"
    return read(write_media(docs, folder, doc_id, text, with_pcm=with_pcm))
