"""Recurrences over many series at once, in numpy.

Series lie one behind the other in flat arrays. They are cut into chunks, and the chunks are the columns of a matrix: a
step of the recurrence is one numpy operation over all chunks. A chunk's steps are maps of the value that comes
into it, composed as they go; then the chunks of each series, far fewer than its rows, hand their values on.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Rows of a chunk at most.
CHUNK = 256
#: Stands for no bound; zero times it is zero.
FAR = 1e300


class Series:
    """Where series begin in flat arrays, and their chunks."""

    def __init__(self, starts: np.ndarray, n: int) -> None:
        self.starts, self.n = np.asarray(starts, np.int64), n
        self.sizes = np.diff(np.append(self.starts, n))
        self.owner = np.repeat(np.arange(len(self.starts)), self.sizes)
        self.place = np.arange(n) - self.starts[self.owner]
        longest = int(self.sizes.max(initial=1))
        self.chunk = max(1, min(CHUNK, int(4 * np.sqrt(longest)), longest))
        many = -(-self.sizes // self.chunk)
        self.of = np.repeat(np.arange(len(self.starts)), many)  # each chunk's series
        self.rank = np.arange(len(self.of)) - np.repeat(np.cumsum(many) - many, many)
        first = self.starts[self.of] + self.rank * self.chunk
        self.rows = first[None, :] + np.arange(self.chunk)[:, None]
        self.inside = self.rows < (self.starts + self.sizes)[self.of][None, :]
        self.by_rank = [np.flatnonzero(self.rank == r) for r in range(int(many.max(initial=0)))] if len(many) < len(self.of) else [np.arange(len(self.of))]
        self.flat = self.rows[self.inside]

    def columns(self, x: np.ndarray, empty: float) -> np.ndarray:
        """x as a matrix of chunks, `empty` behind the ends."""
        return np.where(self.inside, x[np.minimum(self.rows, max(self.n - 1, 0))], empty) if self.n else np.zeros(self.rows.shape)

    def back(self, m: np.ndarray) -> np.ndarray:
        out = np.empty(self.n)
        out[self.flat] = m[self.inside]
        return out

    def hand_on(self, start: np.ndarray, through: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """What comes into each chunk. start: what comes into each series; through(chunks, values): what comes out of chunks."""
        into = np.asarray(start, float)[self.of].copy()
        for now, following in zip(self.by_rank, self.by_rank[1:], strict=False):
            more = np.isin(now + 1, following, assume_unique=True)
            into[now[more] + 1] = through(now[more], into[now[more]])
        return into

    def lag(self, x: np.ndarray, k: int) -> np.ndarray:
        """The value k rows before in the same series, missing at its first k rows."""
        out = np.full(self.n, np.nan)
        out[k:] = x[: self.n - k]
        out[self.place < k] = np.nan
        return out

    def at_starts(self, x: np.ndarray) -> np.ndarray:
        return x[self.starts]

    def first_valid(self, x: np.ndarray) -> np.ndarray:
        """Place of each series' first value that isn't missing, its size if there is none."""
        if not self.n:
            return np.zeros(0, np.int64)
        return np.minimum.reduceat(np.where(np.isnan(x), self.sizes[self.owner], self.place), self.starts)

    def last_place(self, ok: np.ndarray) -> np.ndarray:
        """The flat place of the last row up to each one for which ok holds, in its series; -1 without any."""
        at = np.maximum.accumulate(np.where(ok, np.arange(self.n), -1))
        return np.where(at >= self.starts[self.owner], at, -1)

    def rolling(self, x: np.ndarray, period: int, of: Callable[..., np.ndarray], empty: float = np.nan) -> np.ndarray:
        """of (of an array along an axis) over the last `period` values, `empty` before a series has as many."""
        out = np.full(self.n, empty)
        step = 1 << 15
        for i in range(0, self.n - period + 1, step):
            windows = np.lib.stride_tricks.sliding_window_view(x[i : min(i + step + period - 1, self.n)], period)
            out[i + period - 1 : i + period - 1 + len(windows)] = of(windows, axis=1)
        out[self.place < period - 1] = empty
        return out

    def extreme(self, x: np.ndarray, period: int, of: np.ufunc) -> np.ndarray:
        """Rolling minimum or maximum (a ufunc): of the end of one block of `period` rows and the beginning of the next."""
        out = np.full(self.n, np.nan)
        if self.n >= period:
            m = -(-self.n // period)
            blocks = np.full(m * period, np.nan)
            blocks[: self.n] = x
            blocks = blocks.reshape(m, period)
            ahead = of.accumulate(blocks, axis=1).ravel()[: self.n]
            behind = of.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()[: self.n]
            out[period - 1 :] = of(behind[: self.n - period + 1], ahead[period - 1 :])
        out[self.place < period - 1] = np.nan
        return out


def affine(s: Series, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """y = a * (y before) + b; 0 comes into each series."""
    a, b = s.columns(a, 1.0), s.columns(b, 0.0)
    for t in range(1, len(a)):
        b[t] += a[t] * b[t - 1]
        a[t] *= a[t - 1]
    last = lambda k, y: a[-1, k] * y + b[-1, k]
    return s.back(a * s.hand_on(np.zeros(len(s.starts)), last) + b)


def clamped(s: Series, a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray, *starts: np.ndarray) -> list[np.ndarray]:
    """y = a * (y before) + b within low and high, for each choice of what comes into the series. a isn't negative."""
    a, b, low, high = s.columns(a, 1.0), s.columns(b, 0.0), s.columns(low, -FAR), s.columns(high, FAR)
    for t in range(1, len(a)):
        lo, hi = low[t].copy(), high[t].copy()
        low[t] = np.minimum(np.maximum(a[t] * low[t - 1] + b[t], lo), hi)
        high[t] = np.minimum(np.maximum(a[t] * high[t - 1] + b[t], lo), hi)
        b[t] += a[t] * b[t - 1]
        a[t] *= a[t - 1]

    def last(k: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.minimum(np.maximum(a[-1, k] * y + b[-1, k], low[-1, k]), high[-1, k])

    return [s.back(np.minimum(np.maximum(a * s.hand_on(x, last) + b, low), high)) for x in starts]


def followed(s: Series, x: np.ndarray, step: np.ndarray, least: np.ndarray, most: np.ndarray, *starts: np.ndarray) -> list[np.ndarray]:
    """y moves towards x by at most step, for each choice of what comes into the series; all values that come in lie within least and most.

    Each chunk is run from both ends; where these runs meet, what goes out doesn't depend on what came in. Only the others are run to find it.
    """
    x, step = s.columns(x, 0.0), s.columns(step, 0.0)

    def run(y: np.ndarray, k: np.ndarray | slice, keep: bool) -> np.ndarray:
        v, w = x[:, k], step[:, k]
        out = np.empty_like(v) if keep else y
        for t in range(len(v)):
            y = y + np.minimum(np.maximum(v[t] - y, -w[t]), w[t])
            if keep:
                out[t] = y
        return out if keep else y

    every = slice(None)
    low, high = run(least[s.of], every, False), run(most[s.of], every, False)

    def last(k: np.ndarray, y: np.ndarray) -> np.ndarray:
        out, apart = low[k], low[k] != high[k]
        if apart.any():
            out[apart] = run(y[apart], k[apart], False)
        return out

    return [s.back(run(s.hand_on(y, last), every, True)) for y in starts]
