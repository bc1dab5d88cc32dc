"""Indicators of one series, a candle at a time, from a few numbers and a ring of the last candles."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from emberline.operators.panel import DAY
from emberline.operators.recursions import by_period
from emberline.params import Params

NAN = float("nan")
#: Candles by which a value may be asked back.
BACK = 3


def warm_up(p: Params) -> dict[str, int]:
    """The first row number at which a live indicator has a value. Batch fills the rows before from later candles (an average's seed), or decides by the length of the whole series."""
    ppo, srsi, cloud = max(p.ppo_fast, p.ppo_slow), p.rsi_len + p.kalman_len, max(p.cloud[0], p.cloud[2])
    return {"rma": p.rma_short, "rma_long": p.rma_long, "atr_s": p.atr_short, "atr_l": p.atr_long, "ppo": ppo, "sig": ppo, "rsi": p.rsi_len + 1, "srsi": srsi, "cloud_up": cloud, "cloud_down": cloud}


class Steps:
    """The recursions of recursions.Blocks, each a step of one candle. What they remember are numbers by name, which are the state in between."""

    def __init__(self, wanted: list[str], p: Params, before: list[float] | None, ring: list[tuple[float, float]]) -> None:
        """before: numbers() of the last candle; ring: the last candles' closes and worm distances."""
        self.p, self.wanted, self.ring = p, wanted, ring
        self.most, self.warm = max(p.mmh_period, p.mmh_std), warm_up(p)
        self.bases = sorted({w.partition("'")[0] for w in wanted})
        self.wants = frozenset(self.bases)
        self.asked = [(w.replace("'", "_lag"), b, f"{b}'{k}" if k else "") for w in wanted for b, _, k in [w.partition("'")]]
        self.back = [(b, [f"{b}'{k}" for k in range(1, BACK + 1)]) for b in self.bases]
        self.held: dict[str, float] = {}
        if before:
            names = self.names()
            self.held = {k: v for k, v in zip(names, before, strict=True) if v is not None}
        self.n = int(self.held.get("n", 0))
        self.t = int(self.held["t"]) if "t" in self.held else None

    def names(self) -> list[str]:
        """Names of all numbers, in the order in which they are stored."""
        averages = [f"{k}{x}" for k in ("rma", "rma_long", "atr_s", "atr_l") for x in ("", "_sum", "_count", "_rows")]
        one = ["n", "t", "close", "fast", "slow", "ema", "sig", "up", "down", "rsi_rows", "rsi_close", "srsi", "deviation_1", "range_1", "deviation_2", "range_2", "filter_1", "filter_2", "trend", "worm", "value", "half", "volume", "worth"]
        kalman = [f"{k}_{x}" for k in ("k", "ks") for x in ("level", "error")]
        return [*one, *averages, *kalman, *[f"{b}'{k}" for b in self.bases for k in range(1, BACK + 1)]]

    def numbers(self) -> list[float | None]:
        return [self.held.get(k) for k in self.names()]

    def ema(self, name: str, x: float, alpha: float) -> float:
        if x == x:
            before = self.held.get(name)
            self.held[name] = x if before is None else alpha * x + (1.0 - alpha) * before
        return self.held.get(name, NAN)

    def rma(self, name: str, x: float, period: int) -> float:
        """Missing until the mean of the first `period` rows, counted from the first value, is there."""
        h = self.held
        if name not in h:
            if x != x and f"{name}_rows" not in h:
                return NAN
            h[f"{name}_rows"] = rows = h.get(f"{name}_rows", 0.0) + 1
            if x == x:
                h[f"{name}_sum"], h[f"{name}_count"] = h.get(f"{name}_sum", 0.0) + x, h.get(f"{name}_count", 0.0) + 1
            if rows >= period:
                h[name] = h[f"{name}_sum"] / h[f"{name}_count"]
            return h.get(name, NAN)
        return self.ema(name, x, 1.0 / period)

    def rsi(self, x: float, period: int) -> float:
        h = self.held
        if "rsi_close" not in h:
            if x == x:
                h |= {"rsi_close": x, "rsi_rows": 0.0, "up": 0.0, "down": 0.0}
            return 50.0
        h["rsi_rows"] += 1
        change = x - h["rsi_close"] if x == x else 0.0
        up, down = max(change, 0.0), max(-change, 0.0)
        if h["rsi_rows"] <= period:
            h["up"], h["down"] = h["up"] + up / period, h["down"] + down / period
        if x == x:
            if h["rsi_rows"] >= period:
                h["up"], h["down"] = (h["up"] * (period - 1) + up) / period, (h["down"] * (period - 1) + down) / period
            h["rsi_close"] = x
        if h["rsi_rows"] < period:
            return 50.0
        if h["down"] == 0:
            return 100.0 if h["up"] > 0 else 50.0
        return 100.0 - 100.0 / (1.0 + h["up"] / h["down"])

    def kalman(self, name: str, x: float) -> float:
        h, length = self.held, max(self.p.kalman_len, 1)
        if x == x:
            error = h.get(f"{name}_error", 1.0)
            gain = error / (error + self.p.kalman_r * length)
            level = h.get(f"{name}_level")
            h[f"{name}_level"] = x if level is None else (1.0 - gain) * level + gain * x
            h[f"{name}_error"] = (1.0 - gain) * error + self.p.kalman_q / length
        return h.get(f"{name}_level", NAN)

    def smooth_range(self, k: int, close: float) -> float:
        period, factor = self.p.cloud[2 * k - 2], self.p.cloud[2 * k - 1]
        before = self.held.get("close", NAN)
        distance = 0.0 if self.n == 1 else abs(close - before)
        return self.ema(f"range_{k}", self.ema(f"deviation_{k}", distance, by_period(period)), by_period(2 * period - 1)) * factor

    def range_filter(self, k: int, x: float, r: float) -> float:
        level = self.held.get(f"filter_{k}")
        if level is None:
            level = x if x == x else 0.0
        elif x == x and r == r:
            level = min(max(level, x - r), x + r)
        self.held[f"filter_{k}"] = level
        return level

    def worm_value(self, values: dict[str, float], close: float) -> None:
        """std, worm, mmh_raw, mmh_value, mmh_momentum and mmh."""
        h, p = self.held, self.p
        closes = np.array([c for c, _ in self.ring[-(self.most - 1) :]] + [close]) if self.most > 1 else np.array([close])
        last = closes[-p.mmh_std :]
        apart = last - np.add.reduce(last) / len(last)
        values["std"] = math.sqrt(np.add.reduce(apart * apart) / len(last)) * min(max(p.mmh_response, 1e-5), 1.0) if self.n >= p.mmh_std else 0.0
        w = h.get("worm")
        h["worm"] = w = close if w is None else w + min(max(close - w, -values["std"]), values["std"])
        raw = (w - float(np.add.reduce(last := closes[-p.mmh_period :])) / len(last)) / w if abs(w) >= 1e-10 and self.n >= p.mmh_period else NAN
        self.ring = [*self.ring, (close, raw)][-self.most :]
        seen = [r for _, r in self.ring[-p.mmh_period :]]
        low, high = (min(seen), max(seen)) if len(seen) == p.mmh_period and not math.isnan(sum(seen)) else (NAN, NAN)
        span = high - low
        known = span == span and abs(span) >= 1e-10
        value = min(max(0.5 * h.get("value", 0.0) + (raw - low) / span - 0.5, -0.9999), 0.9999) if known else NAN
        h["value"] = value if known else 0.0
        v = min(max(value, -0.99999), 0.99999) if known else NAN
        momentum = 0.25 * math.log((1.0 + v) / (1.0 - v)) if known else NAN
        h["half"] = 0.5 * h.get("half", 0.0) + momentum if known else 0.0
        values |= {"worm": w, "mmh_raw": raw, "mmh_value": value, "mmh_momentum": momentum, "mmh": h["half"] if known else NAN}

    def step(self, t: int, o: float, high: float, low: float, close: float, volume: float) -> dict[str, float]:
        """The wanted indicators of the next candle."""
        h, p = self.held, self.p
        self.n += 1
        need: Callable[..., bool] = lambda *names: not self.wants.isdisjoint(names)
        values: dict[str, float] = {"close": close}
        if need("ema"):
            values["ema"] = self.ema("ema", close, by_period(p.ppo_fast))
        if need("ppo", "sig"):
            fast, slow = self.ema("fast", close, by_period(p.ppo_fast)), self.ema("slow", close, by_period(p.ppo_slow))
            # what goes on into the signal line counts from the first candle, as in a series that is long enough
            values["ppo"] = (fast - slow) / slow * 100.0 if slow == slow and slow != 0 else 0.0
            values["sig"] = self.ema("sig", values["ppo"], by_period(p.ppo_signal))
        if need("rsi", "srsi"):
            values["rsi"] = self.rsi(close, p.rsi_len)
            values["srsi"] = self.ema("srsi", self.kalman("ks", values["rsi"]), by_period(p.srsi_ema))
        if need("kalman"):
            values["kalman"] = self.kalman("k", close)
        for name, period in (("rma", p.rma_short), ("rma_long", p.rma_long)):
            if need(name):
                values[name] = self.rma(name, close, period)
        before = h.get("close")
        values["tr"] = high - low if before is None else max(high - low, abs(high - before), abs(low - before))
        for name, period in (("atr_s", p.atr_short), ("atr_l", p.atr_long)):
            if need(name):
                values[name] = self.rma(name, values["tr"], period)
        if need("range_1", "range_2", "filter_1", "filter_2", "trend", "cloud_up", "cloud_down"):
            for k in (1, 2):
                values[f"range_{k}"] = self.smooth_range(k, close)
                values[f"filter_{k}"] = self.range_filter(k, close, values[f"range_{k}"])
            over = values["filter_2"] - values["filter_1"]
            h["trend"] = values["trend"] = float(over > 0) if over != 0 and over == over else h.get("trend", 1.0)
            values |= {"cloud_up": values["trend"], "cloud_down": 1.0 - values["trend"]}
        if need("std", "worm", "mmh_raw", "mmh_value", "mmh_momentum", "mmh"):
            self.worm_value(values, close)
        if need("vwap"):
            price = (high + low + close) / 3.0
            new = self.t is None or self.t // DAY != t // DAY
            h["volume"], h["worth"] = (0.0 if new else h["volume"]) + volume, (0.0 if new else h["worth"]) + price * volume
            out = h["worth"] / h["volume"] if h["volume"] != 0 else price
            values["vwap"] = out if out == out else close
        h |= {"close": close, "n": float(self.n), "t": float(t)}
        self.t = t
        for b in self.bases:
            if self.n < self.warm.get(b, 0):
                values[b] = NAN
        result = {name: h.get(key, NAN) if key else values[base] for name, base, key in self.asked}
        for b, keys in self.back:
            for before, key in zip(keys[-2::-1], keys[:0:-1], strict=True):
                if before in h:
                    h[key] = h[before]
            h[keys[0]] = values[b]
        return result
