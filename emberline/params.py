"""Analytic parameters and their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    ppo_fast: int = 7
    ppo_slow: int = 16
    ppo_signal: int = 5
    rma_short: int = 50
    rma_long: int = 200
    cloud: tuple[int, int, int, int] = (22, 9, 15, 5)
    rsi_len: int = 21
    kalman_len: int = 5
    kalman_r: float = 0.01
    kalman_q: float = 0.1
    srsi_ema: int = 5
    atr_short: int = 5
    atr_long: int = 14
    rvol_threshold: float = 0.0  # relative volatility is off by default; 1.0 turns it on
    mmh_period: int = 144
    mmh_response: float = 0.9
    mmh_std: int = 50
    mmh_first_bar: int = 160
    min_wick: float = 0.2
    ppo_cross_bound: float = 0.20
    rsi_level: float = 50.0
    ppo_rsi_guard: float = 0.30
    ppo_level: float = 0.11
    pivot_distance: float = 0.5
    vwap_distance: float = 1.0
    max_jump: float = 50.0
    staleness: int = 1200
    lag: int = 20
    tolerance: int = 120
    cap_symbol: int = 8
    cap_pivots: int = 3
    cap_run: int = 50
    cooldown: int = 300
    dedup: int = 600
    state_ttl: int = 30 * 86400
    meta_ttl: int = 7 * 86400
    trailing: int = 351  # candles of a recursion that begins anew for each candle
    clamp: float = 1e8
    vwap_on: bool = True  # whether VWAP, pivot and cloud take part
    pivot_on: bool = True
    cloud_on: bool = True

    def __post_init__(self) -> None:
        for name in ("ppo_fast", "ppo_slow", "ppo_signal", "rma_short", "rma_long", "rsi_len", "kalman_len", "atr_short", "atr_long", "mmh_period"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")
        if self.ppo_fast >= self.ppo_slow:
            raise ValueError("ppo_fast must be less than ppo_slow")
        if self.mmh_std < 2:
            raise ValueError("mmh_std must be at least 2")


DEFAULT = Params()
