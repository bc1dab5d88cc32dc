"""Hashes of word shingles, and the fingerprints that they make."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash

SEED = 42
#: Shingle hashes whose bits are unpacked at once (64 bytes each, and 512 while they are added up).
BLOCK = 1 << 15


def hashes(text: bytes | None, width: int) -> np.ndarray:
    """XXH64 of each shingle of the lower-cased words."""
    words = (text or b"").lower().split()
    n = len(words)
    if n <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if n else [], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    of = xxhash.xxh64_intdigest
    return np.fromiter((of(joined[a:b], SEED) for a, b in zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, n - width + 1)


def bit_counts(h: np.ndarray) -> np.ndarray:
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), BLOCK):
        total += np.unpackbits(h[i : i + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def fingerprints(texts: Iterable[np.ndarray], many: int) -> np.ndarray:
    """A 64-bit fingerprint of each of many texts, given by their shingles' hashes, as signed integers."""
    counts, sizes = np.zeros((many, 64), np.int64), np.zeros(many, np.int64)
    held: list[np.ndarray] = []
    first = waiting = 0

    def flush(upto: int) -> None:
        nonlocal held, first, waiting
        n = sizes[first:upto]
        some = np.flatnonzero(n)
        if len(some):
            bits = np.unpackbits(np.concatenate(held).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts[first + some] = np.add.reduceat(bits, np.cumsum(n[some]) - n[some], axis=0, dtype=np.int64)
        held, first, waiting = [], upto, 0

    for i, h in enumerate(texts):
        if waiting + len(h) > BLOCK:
            flush(i)
        sizes[i] = len(h)
        if len(h) > BLOCK:
            counts[i], first = bit_counts(h), i + 1
        else:
            held.append(h)
            waiting += len(h)
    flush(many)
    return np.packbits(counts * 2 > sizes[:, None], axis=1, bitorder="little").view(np.int64).ravel()
