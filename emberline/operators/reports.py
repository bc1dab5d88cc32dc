"""Reasons, summaries and run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.text import money
from emberline.operators.signals import DOWN_LEVELS, LEVELS, UP_LEVELS, asof, five, quality_reason
from emberline.params import DEFAULT, Params


def pivot_reason(level: str, up: bool, p: Params = DEFAULT) -> Column:
    """Why the level's alert isn't triggered, null if the price crossed it and is near."""
    x, c, c1 = F.col(level), F.col("close"), F.col("close_lag1")
    crossed = (c1 <= x) & (x < c) if up else (c1 >= x) & (x > c)
    far = F.abs(x - c) / F.when(x > 0, x) * 100
    text = F.concat(F.lit("Pivot too far: price "), money(c), F.lit(" is "), money(far), F.lit(f"% away from {level} pivot "), money(x))
    return F.when(x <= 0, F.lit("Invalid pivot value")).when(c1.isNull(), F.lit("Missing close data")).when(~crossed, F.lit("No pivot cross")).when(far > p.pivot_distance, text)


def suppression(p: Params = DEFAULT) -> Column:
    """The failed conditions and all reasons, in their order; pivot reasons only where any level is known. The texts are fixed values."""
    yes = lambda x: F.coalesce(x, F.lit(False))
    buy, sell = F.col("buy"), F.col("sell")
    o, c, c1, v, v1 = (F.col(x) for x in ("open", "close", "close_lag1", "vwap", "vwap_lag1"))
    ppo, ppo1, rsi, rsi1 = (F.col(x) for x in ("ppo", "ppo_lag1", "srsi", "srsi_lag1"))
    parts = [F.when(~buy, "buy_common"), F.when(~sell, "sell_common"), F.when(~(c > o), "is_green"), F.when(~(c < o), "is_red"), F.when(~buy & ~sell, "Trend filter blocked")]
    parts.append(F.when(F.col("buy_trend") & ~F.col("buy_candle"), F.concat(F.lit("BUY quality: "), quality_reason(True, p))))
    parts.append(F.when(F.col("sell_trend") & ~F.col("sell_candle"), F.concat(F.lit("SELL quality: "), quality_reason(False, p))))
    known = F.lit(False)
    for n in LEVELS if p.pivot_on else ():
        known = known | (F.col(n) != 0)
    for up, names in ((True, UP_LEVELS), (False, DOWN_LEVELS)):
        for n in names:
            parts.append(F.when(known, F.concat(F.lit(f"pivot_{'up' if up else 'down'}_{n}: "), pivot_reason(n, up, p))))
    prices = F.concat(F.lit(" (C="), five(c), F.lit(", O="), five(o), F.lit(")"))
    up0, down0 = yes((ppo1 <= 0) & (ppo > 0)) & ~buy, yes((ppo1 >= 0) & (ppo < 0)) & ~sell
    parts.append(F.when(up0, F.when(~F.col("buy_trend"), "PPO>0 blocked: base_buy_trend=False").when(~F.col("buy_candle"), "PPO>0 blocked: candle quality failed").when(~(c > o), F.concat(F.lit("PPO>0 blocked: candle not green"), prices))))
    parts.append(F.when(down0, F.when(~F.col("sell_trend"), "PPO<0 blocked: base_sell_trend=False").when(~F.col("sell_candle"), "PPO<0 blocked: candle quality failed").when(~(c < o), F.concat(F.lit("PPO<0 blocked: candle not red"), prices))))
    lv, g, level = p.ppo_level, p.ppo_rsi_guard, p.rsi_level
    parts.append(F.when(yes((ppo1 <= lv) & (ppo > lv)) & ~buy, "PPO>+0.11 blocked: buy_common=False"))
    parts.append(F.when(yes((ppo1 >= -lv) & (ppo < -lv)) & ~sell, "PPO<-0.11 blocked: sell_common=False"))
    parts.append(F.when(yes((rsi1 <= level) & (rsi > level)), F.when(ppo >= g, F.concat(F.lit("RSI>50 blocked: PPO="), money(ppo), F.lit(f" ≥ guard {g}"))).when(~buy, "RSI>50 blocked: buy_common=False")))
    parts.append(F.when(yes((rsi1 >= level) & (rsi < level)), F.when(ppo <= -g, F.concat(F.lit("RSI<50 blocked: PPO="), money(ppo), F.lit(f" ≤ guard {-g}"))).when(~sell, "RSI<50 blocked: sell_common=False")))
    there = F.lit(p.vwap_on) & yes((v > 0) & (v1 > 0))
    parts.append(F.when(there & yes((c1 <= v1) & (c > v)) & ~buy, "VWAP up-cross blocked: buy_common=False"))
    parts.append(F.when(there & yes((c1 >= v1) & (c < v)) & ~sell, "VWAP down-cross blocked: sell_common=False"))
    text = F.concat_ws(", ", *parts)
    return F.when(text == "", "No conditions met").otherwise(text)


def vwap_cross(up: bool, p: Params = DEFAULT) -> Column:
    """Why a candle is no strict cross of VWAP; null if it is one."""
    o, h, lo, c, c1, v, v1 = (F.col(x) for x in ("open", "high", "low", "close", "close_lag1", "vwap", "vwap_lag1"))
    crossed = ((c1 <= v1) & (c > v)) | ((c1 < v1) & (c >= v)) if up else (c1 > v1) & (c < v)
    tail = h - F.greatest(o, c) if up else F.least(o, c) - lo
    return (
        F.when(v.isNull() | v1.isNull(), F.lit("VWAP not available"))
        .when(c <= o if up else c >= o, F.lit("red candle" if up else "green candle"))
        .when(~crossed, F.lit("no cross"))
        .when(F.abs(c - v) / v * 100 > p.vwap_distance, F.lit("too far"))
        .when((h - lo > 1e-9) & (tail / F.when(h - lo > 1e-9, h - lo) >= p.min_wick), F.lit("wick too large"))
    )


def summary(evaluated: DataFrame, sent: DataFrame) -> DataFrame:
    """A row for each symbol and evaluated candle: state, alerts, cloud and momentum."""
    counts = sent.groupBy("symbol", "t").agg(F.count(F.lit(1)).alias("_n"))
    rows = evaluated.join(counts, ["symbol", "t"], "left")
    cloud = F.when(F.col("cloud_up") == 1, "green").when(F.col("cloud_down") == 1, "red").otherwise("neutral")
    n = F.coalesce("_n", F.lit(0).cast("long"))
    return rows.select("symbol", "t", F.when(n > 0, "ALERT_SENT").otherwise("NO_SIGNAL").alias("state"), n.alias("alerts"), cloud.alias("cloud"), (F.round("mmh", 4) + 0.0).alias("mmh_hist"))


def run_stats(evaluated: DataFrame, sent: DataFrame, requests: list[tuple[str, int]], bars: DataFrame, limit: int = 350) -> DataFrame:
    """By run (candle time): symbols evaluated, alerts sent, and the share of the requests (symbol, resolution in minutes) that get candles.

    A request asks for the last `limit` candles up to the run; it succeeds if there is one. bars: symbol, resolution, t of all candles.
    """
    runs = evaluated.groupBy("t").agg(F.count(F.lit(1)).alias("evaluated"))
    name = lambda s, m: F.concat(s, F.lit("/"), m.cast("string"))
    asked = runs.select("t", F.inline(F.array(*[F.struct(F.lit(s).alias("_s"), F.lit(m).alias("_m")) for s, m in requests]))).select(name(F.col("_s"), F.col("_m")).alias("symbol"), "t", "_m")
    found = asof(asked, bars.select(name(F.col("symbol"), F.col("resolution")).alias("symbol"), "t", F.col("t").alias("_last")), ["_last"], first=False)
    rate = found.groupBy("t").agg(F.round(100.0 * F.count_if(F.col("t") - F.col("_last") <= F.col("_m") * 60 * limit) / F.count(F.lit(1)), 1).alias("success"))
    counts = sent.groupBy("t").agg(F.count(F.lit(1)).alias("_sent"))
    return runs.join(counts, "t", "left").join(rate, "t").select("t", "evaluated", F.coalesce("_sent", F.lit(0).cast("long")).alias("sent"), "success")


_two = lambda x: f"round(({x})::decimal(38,10), 2)::decimal(38,2)::varchar"
_five = lambda x: f"round(({x})::decimal(28,10), 5)::decimal(28,5)::varchar"


def _corrupt(buy: bool) -> str:
    return f"'Corrupted data (H=' || {_five('high')} || ' < C=' || {_five('close')} || ')'" if buy else f"'Corrupted data (L=' || {_five('low')} || ' > C=' || {_five('close')} || ')'"


def quality_sql(buy: bool) -> str:
    tail, ratio = ("high - close", "(high - close) / (high - low)") if buy else ("close - low", "(close - low) / (high - low)")
    colour = f"when close <= open then 'Not green (C=' || {_five('close')} || ' ≤ O=' || {_five('open')} || ')'" if buy else f"when close >= open then 'Not red (C=' || {_five('close')} || ' ≥ O=' || {_five('open')} || ')'"
    one = f"round(({ratio} * 100)::decimal(28,10), 1)::decimal(28,1)::varchar"
    return f"case when high - low < 1e-8 then 'Range too small' when {tail} < 0 then {_corrupt(buy)} {colour} when {ratio} >= 0.2 then '{'Upper' if buy else 'Lower'} wick ' || {one} || '% ≥ 20.0%' else '✅ {'Green' if buy else 'Red'} wick:' || {one} || '%' end"


def _sql() -> str:
    """The reasons in DuckDB, as arguments of concat_ws."""
    p = DEFAULT
    on = "coalesce(vwap > 0 and vwap_lag1 > 0, false)"
    parts = [
        "case when not buy and not sell then 'Trend filter blocked' end",
        f"case when buy_trend and not buy_candle then 'BUY quality: ' || {quality_sql(True)} end",
        f"case when sell_trend and not sell_candle then 'SELL quality: ' || {quality_sql(False)} end",
    ]
    known = "(P <> 0 or R1 <> 0 or R2 <> 0 or R3 <> 0 or S1 <> 0 or S2 <> 0 or S3 <> 0)"
    for up, names in ((True, UP_LEVELS), (False, DOWN_LEVELS)):
        for n in names:
            crossed = f"(close_lag1 <= {n} and {n} < close)" if up else f"(close_lag1 >= {n} and {n} > close)"
            far = f"abs({n} - close) / nullif({n}, 0) * 100"
            parts.append(f"case when {known} then 'pivot_{'up' if up else 'down'}_{n}: ' || case when {n} <= 0 then 'Invalid pivot value' when close_lag1 is null then 'Missing close data' when not {crossed} then 'No pivot cross' when {far} > {p.pivot_distance} then 'Pivot too far: price ' || {_two('close')} || ' is ' || {_two(far)} || '% away from {n} pivot ' || {_two(n)} end end")
    for word, up, gate, trend, candle in ((">", True, "buy", "base_buy_trend", "buy_candle"), ("<", False, "sell", "base_sell_trend", "sell_candle")):
        sides = "ppo_lag1 <= 0 and ppo > 0" if up else "ppo_lag1 >= 0 and ppo < 0"
        parts.append(f"case when {sides} and not {gate} then case when not {gate}_trend then 'PPO{word}0 blocked: {trend}=False' when not {candle} then 'PPO{word}0 blocked: candle quality failed' when not close {word} open then 'PPO{word}0 blocked: candle not {'green' if up else 'red'} (C=' || {_five('close')} || ', O=' || {_five('open')} || ')' end end")
    parts += [
        f"case when ppo_lag1 <= {p.ppo_level} and ppo > {p.ppo_level} and not buy then 'PPO>+0.11 blocked: buy_common=False' end",
        f"case when ppo_lag1 >= -{p.ppo_level} and ppo < -{p.ppo_level} and not sell then 'PPO<-0.11 blocked: sell_common=False' end",
        f"case when srsi_lag1 <= 50 and srsi > 50 then case when ppo >= {p.ppo_rsi_guard} then 'RSI>50 blocked: PPO=' || {_two('ppo')} || ' ≥ guard {p.ppo_rsi_guard}' when not buy then 'RSI>50 blocked: buy_common=False' end end",
        f"case when srsi_lag1 >= 50 and srsi < 50 then case when ppo <= -{p.ppo_rsi_guard} then 'RSI<50 blocked: PPO=' || {_two('ppo')} || ' ≤ guard -{p.ppo_rsi_guard}' when not sell then 'RSI<50 blocked: sell_common=False' end end",
        f"case when {on} and close_lag1 <= vwap_lag1 and close > vwap and not buy then 'VWAP up-cross blocked: buy_common=False' end",
        f"case when {on} and close_lag1 >= vwap_lag1 and close < vwap and not sell then 'VWAP down-cross blocked: sell_common=False' end",
    ]
    return ", ".join(parts)


SQL = _sql()
