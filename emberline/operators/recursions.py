"""Recursive filters over blocks of series.

Each block starts a halo of rows early, from an arbitrary state. Linear filters forget
it: the halo is so long that less of it is left than a double can hold (missing closes count as rows). Filters that hold a
level (range filter, worm), the trend and the day's sums forget it only where prices let them: the levels once two runs,
from below and from above, have met. A block that hasn't forgotten is handed the exact state by the block before: blocks give what they make of any
state that comes in as a small map (see handover.py), a table with a row for each block composes these, and such blocks alone are computed again from their exact states. A task computes its
blocks together, see scans.py.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.operators import handover
from emberline.operators.panel import DAY, blocked
from emberline.operators.scans import FAR, Series, affine, clamped, followed
from emberline.params import DEFAULT, Params
from emberline.storage import materialize, small

#: Rows of a block and of its halo at least; rows that a task computes together, and that it sends at once.
BLOCK, HALO, AT_ONCE, OUT = 1 << 16, 1 << 13, 1 << 18, 1 << 15
NAN = float("nan")
#: States that are handed from block to block, and indicators that need none of them.
STATES = ("filter_1", "filter_2", "trend", "worm", "day_volume", "day_worth")
FORGETTING = ("ema", "ema_trailing", "rma", "rma_long", "ppo", "sig", "rsi", "kalman", "srsi", "tr", "atr_s", "atr_l", "range_1", "range_2", "std", "close")
KEEP = ["symbol", "t", "rn", "open", "high", "low", "close", "volume"]


def by_period(period: float) -> float:
    return 2.0 / (period + 1.0) if period > 1.0 else period


def margin_of(p: Params) -> int:
    """Rows by which rolling windows of the levels, and what halves a value each row, reach back."""
    return p.mmh_period + p.mmh_std + 128


def halo_of(p: Params) -> int:
    """Rows after which the slowest filter has less than 1e-16 of its first state, and no rolling window reaches back farther."""
    slowest = max(p.rma_short, p.rma_long, p.rsi_len, p.atr_short, p.atr_long, max(p.ppo_slow, p.ppo_signal, p.srsi_ema, 2 * p.cloud[0], 2 * p.cloud[2]) / 2 + 1)
    return max(HALO, int(np.ceil(37 * slowest)) + margin_of(p))


def ema(s: Series, x: np.ndarray, alpha: float) -> np.ndarray:
    """Seeded by the first value; a missing value holds."""
    ok = ~np.isnan(x)
    first = s.place == s.first_valid(x)[s.owner]
    y = affine(s, np.where(first, 0.0, np.where(ok, 1.0 - alpha, 1.0)), np.where(first, x, np.where(ok, alpha * x, 0.0)))
    y[s.place < s.first_valid(x)[s.owner]] = NAN
    return y


def rma(s: Series, x: np.ndarray, period: int, begins: np.ndarray) -> np.ndarray:
    """Wilder's average, seeded by the mean of the first `period` values, which all of these get. Shorter series, and those that don't begin here, are seeded by the first value."""
    first, ok, alpha = s.first_valid(x), ~np.isnan(x), 1.0 / period
    seeded = begins & (first + period <= s.sizes)
    place = s.place - first[s.owner]  # from the first value on
    warm = seeded[s.owner] & (place >= 0) & (place < period)
    n = np.add.reduceat(np.where(warm & ok, 1.0, 0.0), s.starts) if s.n else np.zeros(0)
    seed = (np.add.reduceat(np.where(warm & ok, x, 0.0), s.starts) if s.n else np.zeros(0)) / np.maximum(n, 1.0)
    seed = seed[s.owner]
    start = place == np.where(seeded, period - 1, 0)[s.owner]
    y = affine(s, np.where(start, 0.0, np.where(ok, 1.0 - alpha, 1.0)), np.where(start, np.where(seeded[s.owner], seed, x), np.where(ok, alpha * x, 0.0)))
    y = np.where(warm, seed, y)
    y[place < 0] = NAN
    return y


def rsi(s: Series, close: np.ndarray, period: int, begins: np.ndarray) -> np.ndarray:
    """50 until `period` rows follow the first known close. The average starts there, with a change that is also in its seed.

    A missing close leaves the averages as they are; the next known one counts its change since the last known one.
    """
    ok = ~np.isnan(close)
    first = s.first_valid(close)
    place = s.place - first[s.owner]
    held = s.last_place(ok)
    before = np.concatenate(([-1], held[:-1]))
    known = (s.place > 0) & ok & (before >= s.starts[s.owner])
    change = np.where(known, close - close[np.maximum(before, 0)], 0.0)
    start = place == np.where(begins, period - 1, 0)[s.owner]
    keep = np.where(start, 0.0, np.where(ok, (period - 1.0) / period, 1.0))
    out = []
    for part in (np.maximum(change, 0.0), np.maximum(-change, 0.0)):
        total = np.add.reduceat(np.where((place >= 1) & (place <= period), part, 0.0), s.starts) if s.n else np.zeros(0)
        seed = np.where(begins, total / period, 0.0)[s.owner]
        out.append(affine(s, keep, np.where(start, seed, np.where(ok, part / period, 0.0))))
    g, lo = out
    value = np.where(lo == 0, np.where(g > 0, 100.0, 50.0), 100.0 - 100.0 / (1.0 + g / np.where(lo == 0, 1.0, lo)))
    short = np.where(begins[s.owner], (place < period) | (s.sizes <= period)[s.owner], place < 1)
    return np.where(short, 50.0, value)


def kalman(s: Series, x: np.ndarray, length: int, r: float, q: float) -> np.ndarray:
    """The gain depends on the number of values so far only."""
    length = max(length, 1)
    noise, drift = r * length, q / length
    ok = ~np.isnan(x)
    count = affine(s, np.where(s.place == 0, 0.0, 1.0), ok.astype(float)).astype(np.int64)
    e, gains = 1.0, [0.0]
    for _ in range(min(int(count.max(initial=0)), 4096)):
        gains.append(e / (e + noise))
        e = (1.0 - gains[-1]) * e + drift
    k = np.array(gains)[np.minimum(count, len(gains) - 1)]
    first = ok & (count == 1)
    y = affine(s, np.where(first, 0.0, np.where(ok, 1.0 - k, 1.0)), np.where(first, x, np.where(ok, k * x, 0.0)))
    y[count == 0] = NAN
    return y


def smooth_range(s: Series, close: np.ndarray, period: int, factor: float) -> np.ndarray:
    d = np.where(s.place == 0, 0.0, np.abs(close - s.lag(close, 1)))
    return ema(s, ema(s, d, by_period(period)), by_period(2 * period - 1)) * factor


#: Rows at which states are handed on, and the values there.
Given = tuple[np.ndarray, np.ndarray]


def range_filter(s: Series, x: np.ndarray, r: np.ndarray, begins: np.ndarray, *starts: np.ndarray, given: Given | None = None) -> list[np.ndarray]:
    """Holds its level while the price is within r of it, else follows at that distance. A series that begins here starts at its first price, others at each of the starts; at given rows it has the given values."""
    ok = ~(np.isnan(x) | np.isnan(r)) & ~((s.place == 0) & begins[s.owner])
    first = np.nan_to_num(s.at_starts(x))
    one, zero, low, high = np.ones(s.n), np.zeros(s.n), np.where(ok, x - r, -FAR), np.where(ok, x + r, FAR)
    if given:
        one[given[0]], zero[given[0]], low[given[0]], high[given[0]] = 0.0, given[1], -FAR, FAR
    return clamped(s, one, zero, low, high, *[np.where(begins, first, y) for y in starts])


def worm(s: Series, x: np.ndarray, sd: np.ndarray, begins: np.ndarray, *starts: np.ndarray, given: Given | None = None) -> list[np.ndarray]:
    """Follows the price by at most sd a step; starts and given as in range_filter."""
    into = [np.where(begins, s.at_starts(x), y) for y in starts]
    if given:
        x, sd = x.copy(), sd.copy()
        x[given[0]], sd[given[0]] = given[1], FAR
    least, most = np.minimum.reduceat(x, s.starts), np.maximum.reduceat(x, s.starts)
    for y in into:
        least, most = np.minimum(least, y), np.maximum(most, y)
    return followed(s, x, sd, least, most, *into)


def held_value(s: Series, t: np.ndarray) -> np.ndarray:
    """t - 0.5 + half the value before, within 0.9999; a missing t is missing, and counts as 0 for the next."""
    ok = ~np.isnan(t)
    (y,) = clamped(s, np.where(ok, 0.5, 0.0), np.where(ok, t - 0.5, 0.0), np.where(ok, -0.9999, -FAR), np.where(ok, 0.9999, FAR), np.zeros(len(s.starts)))
    return np.where(ok, y, NAN)


def half_sum(s: Series, x: np.ndarray) -> np.ndarray:
    """x + half the value before; missing values as in held_value."""
    ok = ~np.isnan(x)
    return np.where(ok, affine(s, np.where(ok, 0.5, 0.0), np.where(ok, x, 0.0)), NAN)


class Blocks:
    """Indicators of blocks that lie one behind the other, each computed once. begins: whether a block starts its series."""

    def __init__(self, columns: dict[str, np.ndarray], starts: np.ndarray, params: Params, margin: int = 0, halo: int = 0) -> None:
        self.p, self.s = params, Series(starts, len(columns["t"]))
        self.o, self.h, self.l, self.c, self.v = (columns[k] for k in ("open", "high", "low", "close", "volume"))
        self.t, self.halo = columns["t"], columns["halo"]
        self.begins = columns["rn"][self.s.starts] == 1
        local = np.fmin.reduceat(self.l, self.s.starts) * 0.5, np.fmax.reduceat(self.h, self.s.starts) * 2.0
        self.least, self.most = (columns[k][self.s.starts] if k in columns else x for k, x in zip(("least", "most"), local, strict=True))
        self.own = self.s.starts + np.add.reduceat(self.halo.astype(np.int64), self.s.starts)  # the first row behind the halo
        # rows at which states are handed on: as far before a block's end as rolling windows of the levels reach back
        self.margin, self.before = margin, halo
        self.wide, self.met = "least" in columns, {}
        self.at = np.maximum(self.own - 1 - margin, self.s.starts)
        self.given = {k: columns[f"given_{k}"][self.s.starts] for k in STATES} if "given_worm" in columns else None
        self.settled, self.made = np.ones(len(self.s.starts), bool), {}

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self.made:
            with np.errstate(invalid="ignore", divide="ignore"):
                self.made[name] = np.asarray(getattr(self, f"_{name}")(), float)
        return self.made[name]

    def long_enough(self, n: int) -> np.ndarray:
        return (~self.begins | (self.s.sizes >= n))[self.s.owner]

    def handed(self, name: str) -> Given | None:
        """Where a state is given, and what it is there."""
        go_on = ~self.begins
        return (self.at[go_on], self.given[name][go_on]) if self.given else None

    def _held(self, name: str, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """A filter that holds a level: exact from the start of a series or from a given state; else both runs must meet before the row at which states are handed on."""
        self.met[name] = self.begins | (low[self.at] == high[self.at]) | (self.given is not None)
        self.settled &= self.met[name]
        return low

    def _ema(self):
        return ema(self.s, self.c, by_period(self.p.ppo_fast))

    def _ema_trailing(self):
        """The recursion as if it began 350 candles back: what came before is taken out again."""
        alpha, k = by_period(self.p.ppo_fast), self.p.trailing - 1
        gone = (1.0 - alpha) ** k * (self.s.lag(self["ema"], k) - self.s.lag(self.c, k))
        return self["ema"] - np.nan_to_num(gone)

    def _rma(self):
        return np.where(self.long_enough(self.p.rma_short), np.nan_to_num(rma(self.s, self.c, self.p.rma_short, self.begins)), 0.0)

    def _rma_long(self):
        return np.where(self.long_enough(self.p.rma_long), np.nan_to_num(rma(self.s, self.c, self.p.rma_long, self.begins)), 0.0)

    def _ppo(self):
        fast, slow = ema(self.s, self.c, by_period(self.p.ppo_fast)), ema(self.s, self.c, by_period(self.p.ppo_slow))
        ok = (slow != 0) & ~np.isnan(slow) & self.long_enough(max(self.p.ppo_fast, self.p.ppo_slow))
        return np.where(ok, (fast - slow) / np.where(ok, slow, 1.0) * 100.0, 0.0)

    def _sig(self):
        return ema(self.s, self["ppo"], by_period(self.p.ppo_signal))

    def _rsi(self):
        return rsi(self.s, self.c, self.p.rsi_len, self.begins)

    def _kalman(self):
        return kalman(self.s, self.c, self.p.kalman_len, self.p.kalman_r, self.p.kalman_q)

    def _srsi(self):
        x = ema(self.s, kalman(self.s, self["rsi"], self.p.kalman_len, self.p.kalman_r, self.p.kalman_q), by_period(self.p.srsi_ema))
        return np.where(self.long_enough(self.p.rsi_len + self.p.kalman_len) & ~np.isnan(x), x, 50.0)

    def _tr(self):
        before = self.s.lag(self.c, 1)
        return np.where(self.s.place == 0, self.h - self.l, np.maximum(self.h - self.l, np.maximum(abs(self.h - before), abs(self.l - before))))

    def _atr(self, period: int):
        return np.where(self.long_enough(period), rma(self.s, self["tr"], period, self.begins), NAN)

    def _atr_s(self):
        return self._atr(self.p.atr_short)

    def _atr_l(self):
        return self._atr(self.p.atr_long)

    def _range_1(self):
        return smooth_range(self.s, self.c, self.p.cloud[0], self.p.cloud[1])

    def _range_2(self):
        return smooth_range(self.s, self.c, self.p.cloud[2], self.p.cloud[3])

    def _filter_1(self):
        return self._filter(1)

    def _filter_2(self):
        return self._filter(2)

    def _filter(self, k: int) -> np.ndarray:
        far = np.full(len(self.s.starts), FAR)
        return self._held(f"filter_{k}", *range_filter(self.s, self.c, self[f"range_{k}"], self.begins, -far, far, given=self.handed(f"filter_{k}")))

    def _trend(self):
        """1 up, 0 down: which filter is above; a tie keeps what was, at first up."""
        x = np.sign(self["filter_2"] - self["filter_1"])
        if given := self.handed("trend"):
            x[given[0]] = np.where(given[1] > 0, 1.0, -1.0)
        at = self.s.last_place((x != 0) & ~np.isnan(x))
        self.settled &= self.begins | (at[self.at] >= self.s.starts)
        return np.where(at >= 0, x[np.maximum(at, 0)] > 0, True)

    def _cloud_up(self):
        return np.where(self.long_enough(max(self.p.cloud[0], self.p.cloud[2])), self["trend"], 0.0)

    def _cloud_down(self):
        return np.where(self.long_enough(max(self.p.cloud[0], self.p.cloud[2])), 1 - self["trend"], 0.0)

    def _std(self):
        return self.s.rolling(self.c, self.p.mmh_std, np.std, 0.0) * min(max(self.p.mmh_response, 1e-5), 1.0)

    def _worm(self):
        return self._held("worm", *worm(self.s, self.c, self["std"], self.begins, self.least, self.most, given=self.handed("worm")))

    def _mmh_raw(self):
        w = self["worm"]
        ok = abs(w) >= 1e-10
        return np.where(ok, (w - self.s.rolling(self.c, self.p.mmh_period, np.mean)) / np.where(ok, w, 1.0), NAN)

    def _mmh_value(self):
        raw = self["mmh_raw"]
        low, high = self.s.extreme(raw, self.p.mmh_period, np.minimum), self.s.extreme(raw, self.p.mmh_period, np.maximum)
        span = high - low
        ok = abs(span) >= 1e-10
        return held_value(self.s, np.where(ok, (raw - low) / np.where(ok, span, 1.0), NAN))

    def _mmh_momentum(self):
        v = np.clip(self["mmh_value"], -0.99999, 0.99999)
        return 0.25 * np.log((1.0 + v) / (1.0 - v))

    def _mmh(self):
        return half_sum(self.s, self["mmh_momentum"])

    def _vwap(self):
        """By UTC day."""
        volume, worth = self["day_volume"], self["day_worth"]
        out = np.where(volume != 0, worth / np.where(volume != 0, volume, 1.0), (self.h + self.l + self.c) / 3.0)
        return np.where(np.isnan(out), self.c, out)

    def _day_sum(self, x: np.ndarray, name: str) -> np.ndarray:
        """Since the day's start; a block whose halo doesn't hold the beginning of its first day hasn't settled."""
        day = self.t // DAY
        keep = np.where((self.s.place == 0) | np.concatenate(([True], day[1:] != day[:-1])), 0.0, 1.0)
        if given := self.handed(name):
            keep[given[0]], x[given[0]] = 0.0, given[1]
        else:
            self.settled &= self.begins | (day[self.s.starts] < day[np.minimum(self.at + 1, self.s.n - 1)])
        return affine(self.s, keep, x)

    def _day_volume(self):
        return self._day_sum(self.v.copy(), "day_volume")

    def _day_worth(self):
        return self._day_sum((self.h + self.l + self.c) / 3.0 * self.v, "day_worth")

    def _close(self):
        return self.c


    def ends(self, size: int) -> list[tuple[int, dict]]:
        """By row: what is said there for handing on. A block says on its first own row whether it has settled, and `margin` rows before its end (if it is full) what it gives the next one."""
        held = [k for k in STATES if k in self.made]
        last = np.append(self.s.starts[1:], self.s.n) - 1
        loose = {} if self.settled.all() else self.loose(held)
        day, lowest, highest = self.t // DAY, np.fmin.reduceat(self.c, self.s.starts), np.fmax.reduceat(self.c, self.s.starts)
        sign = np.sign(self["filter_2"] - self["filter_1"]) if "trend" in held else np.zeros(0)
        out: dict[int, dict] = {}
        for i, (own, end, at) in enumerate(zip(self.own.tolist(), last.tolist(), self.at.tolist(), strict=True)):
            if own > end:  # a block of a halo alone
                continue
            begins, ok = bool(self.begins[i]), bool(self.settled[i])
            about = {"begins": begins, "ok": ok, "wide": self.wide, "exact": self.given is not None, "worm": "worm" in held, "least": float(self.least[i]), "most": float(self.most[i]), "low": float(lowest[i]), "high": float(highest[i])}
            if self.given and not begins and "trend" in held and not sign[at + 1] != 0:  # the trend that is given counts
                about["trend_in"] = float(self.given["trend"][i])
            out.setdefault(own, {}).update(about)
            if end - own + 1 < size:
                continue
            e, row = end - self.margin, end - self.before
            ways = {}
            for k in held:
                seen = np.flatnonzero((sign[at + 1 : e + 1] != 0) & ~np.isnan(sign[at + 1 : e + 1])) if k == "trend" else []
                if k == "trend" and (self.given and not begins or not ok and not begins):
                    known = self.given is not None or self.met["filter_1"][i] and self.met["filter_2"][i]
                    ways[k] = handover.unknown() if not known else handover.fixed(float(sign[at + 1 + seen[-1]] > 0)) if len(seen) else handover.same()
                elif ok or begins:
                    ways[k] = handover.fixed(float(self[k][e]))
                elif k.startswith("filter"):
                    ways[k] = handover.clamp(*(float(x[e]) for x in loose[k]))
                elif k == "worm":
                    ways[k] = handover.follow(self.c[at + 1 : e + 1], self["std"][at + 1 : e + 1], float(self.least[i]), float(self.most[i]))
                else:
                    ways[k] = handover.fixed(float(self[k][e])) if day[at] < day[e] else handover.plus(float(loose[k][e]))
            # the worm just before the next block's first row: that block's runs must begin below and above it
            start = float(self["worm"][row]) if "worm" in held and row >= self.s.starts[i] and (begins or row >= at) else None
            out.setdefault(e, {}).update(states=ways, next=start)
        return list(out.items())

    def loose(self, held: list[str]) -> dict[str, list[np.ndarray]]:
        """Levels that come from below and from above all prices where states are handed on, and sums of what comes behind there."""
        go_on, out = ~self.begins, {}
        for k in (k for k in held if k.startswith("filter")):
            out[k] = [range_filter(self.s, self.c, self[f"range_{k[-1]}"], self.begins, np.zeros(len(go_on)), given=(self.at[go_on], np.full(go_on.sum(), far)))[0] for far in (-FAR, FAR)]
        self.given = {k: np.zeros(len(go_on)) for k in STATES}
        out |= {k: make() for k, make in (("day_volume", self._day_volume), ("day_worth", self._day_worth)) if k in held}
        self.given = None
        return out


def recursive(bars: DataFrame, wanted: list[str], params: Params = DEFAULT, block: int | None = None, halo: int | None = None) -> DataFrame:
    """bars (symbol, t, rn, open, high, low, close, volume) with indicators by name; name'k is the value k rows before. Missing values are null.

    The halo follows from the parameters, and blocks are eight times as long at least, unless both are given; a given halo must hold the rolling windows and what the averages remember.
    """
    halo = halo or halo_of(params)
    block = block or max(BLOCK, 8 * halo)
    if halo > block:
        raise ValueError("a halo can't be longer than a block")
    names = [w.replace("'", "_lag") for w in wanted]
    margin = min(margin_of(params), halo - 1)

    def compute(table: pa.Table, starts: np.ndarray) -> pa.Table:
        b = Blocks({c: table.column(c).to_numpy().astype(bool if c == "halo" else np.int64 if c in ("t", "rn") else float) for c in table.column_names if c not in ("symbol", "block")}, starts, params, margin, halo)
        made = []
        for w in wanted:
            base, _, k = w.partition("'")
            made.append((b.s.lag(b[base], int(k)) if k else b[base])[~b.halo])
        kept = table.select(KEEP).filter(pa.array(~b.halo))
        ends = np.full(b.s.n, None, object)
        if any(k in b.made for k in STATES) and (not b.begins.all() or (b.s.sizes >= block).any()):
            for row, what in b.ends(block):
                ends[row] = json.dumps(what)
        columns = [c.cast(pa.float64()) if n not in ("symbol", "t", "rn") else c for n, c in zip(KEEP, kept.columns, strict=True)]
        return pa.Table.from_arrays([*columns, *[pa.array(x, pa.float64()) for x in made], pa.array(ends[~b.halo], pa.string())], names=[*KEEP, *names, "ends"])

    def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        enough = AT_ONCE

        def begun(table: pa.Table) -> np.ndarray:
            code, k = pa.concat_arrays(table.column("symbol").chunks).dictionary_encode().indices.to_numpy(), table.column("block").to_numpy()
            return np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (k[1:] != k[:-1]))))

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= enough:
                table = pa.Table.from_batches(held).combine_chunks()
                starts = begun(table)
                if len(starts) > 1:  # the last block may go on
                    yield from compute(table.slice(0, starts[-1]), starts[:-1]).to_batches(max_chunksize=OUT)
                    table, enough = table.slice(starts[-1]), AT_ONCE
                else:
                    enough *= 2  # a block that is longer
                held = table.to_batches()
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from compute(table, begun(table)).to_batches(max_chunksize=OUT)

    schema = ", ".join(["symbol string, t long, rn long, open double, high double, low double, close double, volume double", *[f"`{n}` double" for n in names], "ends string"])

    def run(rows: DataFrame, extra: list[str]) -> DataFrame:
        rows = rows.select(*KEEP, "block", "halo", *extra).repartition("symbol", "block").sortWithinPartitions("symbol", "block", "rn")
        return rows.mapInArrow(run_batches, schema)

    of = F.floor((F.col("rn") - 1) / block).alias("block")
    out = materialize(run(blocked(bars, block, halo), []))
    if any(w.partition("'")[0] not in FORGETTING for w in wanted) and (out.agg(F.max("rn")).first()[0] or 0) > block:
        for step in range(5):  # with bounds of each block; with the series' bounds; from exact states; once more where the trend's state came late
            left = materialize(handover.unsettled(out.where("ends is not null").select("symbol", of, "ends"), STATES))
            n = left.count()  # a row for each block that hasn't settled
            if not n:
                break
            if step == 0:
                bounds = out.groupBy("symbol").agg(F.min("close").alias("least"), F.max("close").alias("most"))
                left, extra = left.select("symbol", "block").join(bounds, "symbol"), ["least", "most"]
            else:
                extra = [f"given_{k}" for k in STATES]
            again = blocked(bars, block, halo).join(small(left, n), ["symbol", "block"])
            settled = out.withColumn("block", of).join(small(left.select("symbol", "block"), n), ["symbol", "block"], "left_anti").drop("block")
            out = materialize(settled.unionByName(run(again, extra)))
        else:
            raise AssertionError("states can't be handed on")
    return out.select(*KEEP, *[F.when(~F.isnan(n), F.col(n)).alias(n) for n in names])
