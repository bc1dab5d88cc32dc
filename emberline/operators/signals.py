"""Features, gates, and the 24 alerts as Columns."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberline.functions.text import grouped_money, money
from emberline.operators.panel import DAY, day_of
from emberline.operators.recursions import recursive
from emberline.operators.validation import with_reason
from emberline.params import DEFAULT, Params

LEVELS = ("P", "R1", "R2", "R3", "S1", "S2", "S3")
UP_LEVELS, DOWN_LEVELS = ("P", "S1", "S2", "S3", "R1", "R2"), ("P", "S1", "S2", "R1", "R2", "R3")
#: Share of the day's range between the middle and each level (fixed values).
RATIOS = {"1": 0.382, "2": 0.618, "3": 1.0}


def asof(left: DataFrame, right: DataFrame, columns: list[str], first: bool = True) -> DataFrame:
    """left (symbol, t) with the columns of right's last row at or before t, by one union: left's columns go through it, and nothing is joined but
    a small table with a row for each symbol and day, which carries what was last known before.

    Rows before all of right's take its first row, if first holds. Rows that repeat stay as they are.
    """
    kept = [c for c in left.columns if c not in ("symbol", "t")]
    value, own = F.struct(*columns), F.struct(*kept) if kept else F.struct(F.lit(0).alias("_none"))
    null_of = lambda df, x: F.lit(None).cast(df.select(x).schema[0].dataType)
    a = left.select("symbol", "t", F.lit(1).alias("_side"), own.alias("_own"), null_of(right, value).alias("_r"))
    b = right.select("symbol", "t", F.lit(0).alias("_side"), null_of(left, own).alias("_own"), value.alias("_r"))
    rows = a.unionByName(b).withColumn("_b", day_of(F.col("t")))
    known = F.col("_r").isNotNull()
    days = rows.groupBy("symbol", "_b").agg(F.max_by("_r", F.when(known, F.col("t"))).alias("_l"), F.min_by("_r", F.when(known, F.col("t"))).alias("_f"))
    series = Window.partitionBy("symbol").orderBy("_b")
    before = F.last("_l", ignorenulls=True).over(series.rowsBetween(Window.unboundedPreceding, -1))
    if first:
        before = F.coalesce(before, F.first("_f", ignorenulls=True).over(series.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    days = days.select("symbol", "_b", before.alias("_carry"))
    within = Window.partitionBy("symbol", "_b").orderBy("t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(days, ["symbol", "_b"]).withColumn("_found", F.coalesce(F.last("_r", ignorenulls=True).over(within), F.col("_carry"))).where("_side = 1")
    return out.select("symbol", "t", *[F.col(f"_own.{c}").alias(c) for c in kept], *[F.col(f"_found.{c}").alias(c) for c in columns]).select(*left.columns, *columns)


def levels(h: Column, lo: Column, c: Column) -> dict[str, Column]:
    """Seven levels of a day's candle; a level that isn't positive, and all of a day without range, are 0."""
    span, middle = h - lo, (h + lo + c) / 3
    out = {"P": middle} | {f"R{k}": middle + span * r for k, r in RATIOS.items()} | {f"S{k}": middle - span * r for k, r in RATIOS.items()}
    return {n: F.when((span >= 1e-8) & (x > 0), x).otherwise(0.0) for n, x in out.items()}


def pivots(daily: DataFrame) -> DataFrame:
    """symbol, day (from which the levels hold) and the levels of the day before."""
    found = levels(F.col("high"), F.col("low"), F.col("close"))
    return daily.select("symbol", (day_of(F.col("t")) + 1).alias("day"), *[x.alias(n) for n, x in found.items()])


def eval_day(p: Params = DEFAULT, width: int = 900) -> Column:
    """The day on which a candle is evaluated, after its close: the last candle of a day belongs to the next."""
    return F.floor((F.col("t") + width + p.lag) / DAY)


def with_pivots(bars: DataFrame, daily: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """bars with eval_day and the levels of the day before; levels of a missing day are 0."""
    rows = bars.withColumn("eval_day", eval_day(p))
    out = rows.join(pivots(daily).withColumnRenamed("day", "eval_day"), ["symbol", "eval_day"], "left")
    return out.withColumns({n: F.coalesce(n, F.lit(0.0)) for n in LEVELS})


def wick(buy: bool, p: Params = DEFAULT) -> Column:
    """Whether the candle has the right colour, a small wick and enough relative volatility."""
    o, h, lo, c = F.col("open"), F.col("high"), F.col("low"), F.col("close")
    tail, colour = (h - c, c > o) if buy else (c - lo, c < o)
    lively = (F.col("atr_s") > F.col("atr_l") * p.rvol_threshold) if p.rvol_threshold >= 0 else F.lit(False)
    return F.coalesce(lively & (h - lo > 1e-9) & colour & (tail >= 0) & (tail / (h - lo) < p.min_wick), F.lit(False))


def wick_ratio(buy: bool) -> Column:
    span = F.col("high") - F.col("low")
    return F.when(span <= 1e-9, 1.0).otherwise((F.col("high") - F.col("close") if buy else F.col("close") - F.col("low")) / span)


def percent1(x: Column) -> Column:
    return F.round((x * 100).cast("decimal(28,10)"), 1).cast("decimal(28,1)").cast("string")


def five(x: Column) -> Column:
    return F.round(x.cast("decimal(28,10)"), 5).cast("decimal(28,5)").cast("string")


def quality_reason(buy: bool, p: Params = DEFAULT) -> Column:
    """Why the candle's shape passes or not. The texts are fixed values."""
    o, h, lo, c = F.col("open"), F.col("high"), F.col("low"), F.col("close")
    ratio = (h - c if buy else c - lo) / (h - lo)
    corrupt = F.concat(F.lit("Corrupted data (H="), five(h), F.lit(" < C="), five(c), F.lit(")")) if buy else F.concat(F.lit("Corrupted data (L="), five(lo), F.lit(" > C="), five(c), F.lit(")"))
    colour = F.concat(F.lit("Not green (C="), five(c), F.lit(" ≤ O="), five(o), F.lit(")")) if buy else F.concat(F.lit("Not red (C="), five(c), F.lit(" ≥ O="), five(o), F.lit(")"))
    return (
        F.when(h - lo < 1e-8, F.lit("Range too small"))
        .when((h - c if buy else c - lo) < 0, corrupt)
        .when(c <= o if buy else c >= o, colour)
        .when(ratio >= p.min_wick, F.concat(F.lit("Upper wick " if buy else "Lower wick "), percent1(ratio), F.lit(f"% ≥ {p.min_wick * 100:.1f}%")))
        .otherwise(F.concat(F.lit("✅ Green wick:" if buy else "✅ Red wick:"), percent1(ratio), F.lit("%")))
    )


FEATURES = ["close'1", "ppo", "ppo'1", "sig", "sig'1", "srsi", "srsi'1", "rma", "atr_s", "atr_l", "cloud_up", "cloud_down", "mmh", "mmh'1", "mmh'2", "mmh'3", "vwap", "vwap'1"]


def features(bars15: DataFrame, bars5: DataFrame, daily: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """A row for each 15-minute candle with all indicators, the aligned 5-minute candle and average, levels and gates.

    bars15 and bars5 have rn, the row number in their series.
    """
    rows = recursive(bars15, FEATURES, p)
    five_min = recursive(bars5, ["rma_long"], p).select("symbol", "t", F.col("close").alias("close5"), F.col("rma_long").alias("rma200"), F.col("rn").alias("rn5"))
    rows = with_pivots(asof(rows, five_min, ["close5", "rma200", "rn5"]), daily, p)
    return gated(rows, p)


def gated(rows: DataFrame, p: Params = DEFAULT) -> DataFrame:
    up, down = (F.col("cloud_up") == 1) & F.lit(p.cloud_on), (F.col("cloud_down") == 1) & F.lit(p.cloud_on)
    yes = lambda x: F.coalesce(x, F.lit(False))
    rows = rows.withColumns(
        {
            "buy_trend": yes((F.col("rma") < F.col("close")) & (F.col("rma200") < F.col("close5")) & (F.col("mmh") > 0) & up & ~down),
            "sell_trend": yes((F.col("rma") > F.col("close")) & (F.col("rma200") > F.col("close5")) & (F.col("mmh") < 0) & down & ~up),
            "buy_candle": wick(True, p),
            "sell_candle": wick(False, p),
        }
    )
    rows = rows.withColumns({"buy": F.col("buy_trend") & F.col("buy_candle"), "sell": F.col("sell_trend") & F.col("sell_candle")})
    m, m1, m2, m3 = F.col("mmh"), F.col("mmh_lag1"), F.col("mmh_lag2"), F.col("mmh_lag3")
    warm = (F.col("rn") - 1 >= p.mmh_first_bar) & m.isNotNull() & m1.isNotNull() & m2.isNotNull() & m3.isNotNull()
    return rows.withColumns(
        {
            "mmh_ok": warm,
            "mmh_up": yes(F.col("buy") & warm & (m > 0) & (m3 > m2) & (m2 > m1) & (m > m1)),
            "mmh_down": yes(F.col("sell") & warm & (m < 0) & (m3 < m2) & (m2 < m1) & (m < m1)),
        }
    )


def evaluated(rows: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Rows that are evaluated: enough history, a valid candle, and a close that differs from the open."""
    checked = with_reason(rows.where("close != open and rn >= 5 and rn5 >= 3"), 15, p, before=F.col("close_lag1"))
    return checked.where("reason is null").drop("reason")


@dataclass(frozen=True)
class Alert:
    key: str
    title: str
    trigger: Column
    reset: Column
    text: Column
    enabled: Column
    daily: bool  # its state is cleared on a new day


def number(x: Column) -> Column:
    return F.coalesce(money(x), F.lit("nan"))


def alerts(p: Params = DEFAULT) -> list[Alert]:
    """All alerts in the order in which caps count them, made once for each Spark application. Keys, titles, texts and their order are fixed values."""
    return _alerts(p, SparkContext.getOrCreate().applicationId)


@cache
def _alerts(p: Params, application: str) -> list[Alert]:
    ppo, ppo1, sig, sig1, rsi, rsi1 = (F.col(c) for c in ("ppo", "ppo_lag1", "sig", "sig_lag1", "srsi", "srsi_lag1"))
    c, c1, v, v1, m, m1 = (F.col(x) for x in ("close", "close_lag1", "vwap", "vwap_lag1", "mmh", "mmh_lag1"))
    buy, sell, on = F.col("buy"), F.col("sell"), F.lit(True)
    wicks = {True: F.concat(F.lit("Wick "), percent1(wick_ratio(True)), F.lit("%")), False: F.concat(F.lit("Wick "), percent1(wick_ratio(False)), F.lit("%"))}
    mmh = F.concat(F.lit("MMH ("), number(m), F.lit(")"))
    bar = F.lit(" | ")

    def ppo_text(up: bool) -> Column:
        return F.concat(F.lit("PPO "), number(ppo), bar, wicks[up], bar, mmh)

    def rsi_text(up: bool) -> Column:
        return F.concat(F.lit("RSI "), number(rsi), bar, F.lit("PPO "), number(ppo), bar, wicks[up], bar, mmh)

    def sig_text(up: bool) -> Column:
        return F.concat(F.lit("PPO "), number(ppo), F.lit(" vs Sig "), number(sig), bar, wicks[up], bar, mmh)

    def vwap_text(up: bool) -> Column:
        return F.concat(F.lit("VWAP "), number(v), bar, wicks[up], bar, mmh)

    def crossed(x1: Column, y1: Column | float, x: Column, y: Column | float, up: bool) -> Column:
        return (x1 <= y1) & (x > y) if up else (x1 >= y1) & (x < y)

    def undone(x1: Column, y1: Column | float, x: Column, y: Column | float, up: bool) -> Column:
        return (x1 > y1) & (x <= y) if up else (x1 < y1) & (x >= y)

    lv, b, g, level = p.ppo_level, p.ppo_cross_bound, p.ppo_rsi_guard, p.rsi_level
    vwap_on = F.lit(p.vwap_on) & F.coalesce((v > 0) & (v1 > 0), F.lit(False))
    out = [
        Alert("ppo_signal_up", "🟢 PPO cross above signal", buy & crossed(ppo1, sig1, ppo, sig, True) & (ppo < b), undone(ppo1, sig1, ppo, sig, True) | ~buy, sig_text(True), on, False),
        Alert("ppo_signal_down", "🔴 PPO cross below signal", sell & crossed(ppo1, sig1, ppo, sig, False) & (ppo > -b), undone(ppo1, sig1, ppo, sig, False) | ~sell, sig_text(False), on, False),
        Alert("ppo_zero_up", "🟢 PPO cross above 0", buy & crossed(ppo1, 0.0, ppo, 0.0, True), undone(ppo1, 0.0, ppo, 0.0, True) | ~buy, ppo_text(True), on, False),
        Alert("ppo_zero_down", "🔴 PPO cross below 0", sell & crossed(ppo1, 0.0, ppo, 0.0, False), undone(ppo1, 0.0, ppo, 0.0, False) | ~sell, ppo_text(False), on, False),
        Alert("ppo_011_up", "🟢 PPO cross above 0.11", buy & crossed(ppo1, lv, ppo, lv, True), undone(ppo1, lv, ppo, lv, True) | ~buy, ppo_text(True), on, False),
        Alert("ppo_011_down", "🔴 PPO cross below -0.11", sell & crossed(ppo1, -lv, ppo, -lv, False), undone(ppo1, -lv, ppo, -lv, False) | ~sell, ppo_text(False), on, False),
        Alert("rsi_50_up", "🟢 RSI cross above 50 (PPO < 0.30)", buy & crossed(rsi1, level, rsi, level, True) & (ppo < g), undone(rsi1, level, rsi, level, True) | ~buy | (ppo >= g), rsi_text(True), on, False),
        Alert("rsi_50_down", "🔴 RSI cross below 50 (PPO > -0.30)", sell & crossed(rsi1, level, rsi, level, False) & (ppo > -g), undone(rsi1, level, rsi, level, False) | ~sell | (ppo <= -g), rsi_text(False), on, False),
        Alert("vwap_up", "🔵▲ Price cross above VWAP", buy & crossed(c1, v1, c, v, True), undone(c1, v1, c, v, True) | ~buy, vwap_text(True), vwap_on, True),
        Alert("vwap_down", "🟣▼ Price cross below VWAP", sell & crossed(c1, v1, c, v, False), undone(c1, v1, c, v, False) | ~sell, vwap_text(False), vwap_on, True),
        Alert("mmh_buy", "🔵⬆️ MMH Reversal BUY", F.col("mmh_up"), F.col("mmh_ok") & (m > 0) & (m <= m1), F.concat(mmh, bar, wicks[True]), on, False),
        Alert("mmh_sell", "🟣⬇️ MMH Reversal SELL", F.col("mmh_down"), F.col("mmh_ok") & (m < 0) & (m >= m1), F.concat(mmh, bar, wicks[False]), on, False),
    ]
    levels_on = F.lit(False)
    for n in LEVELS:
        levels_on = levels_on | (F.col(n) != 0)
    for up, names in ((True, UP_LEVELS), (False, DOWN_LEVELS)):
        for n in names:
            x, gate = F.col(n), buy if up else sell
            near = F.abs(x - c) / F.when(x > 0, x) * 100 <= p.pivot_distance
            text = F.concat(F.lit("$"), grouped_money(x), bar, mmh, F.lit(" [Dist: "), number(F.abs(x - c) / c * 100), F.lit("%]"))
            title = f"🟢⬆️ Cross above {n}" if up else f"🔴⬇️ Cross below {n}"
            out.append(Alert(f"pivot_{'up' if up else 'down'}_{n}", title, gate & (x > 0) & crossed(c1, x, c, x, up) & near & levels_on, undone(c1, x, c, x, up) | ~gate, text, F.lit(p.pivot_on), True))
    return out


def long_alerts(rows: DataFrame, p: Params = DEFAULT, more: list[str] | None = None) -> DataFrame:
    """A row for each evaluated candle and alert that fires or resets: symbol, t, eval_day, ord, key, trigger, reset, daily, and bar: what its text shows, only where it fires; and the columns in more."""
    yes = lambda x: F.coalesce(x, F.lit(False))
    each = [
        F.struct(F.lit(i).alias("ord"), F.lit(a.key).alias("key"), yes(a.enabled & a.trigger).alias("trigger"), yes(a.enabled & a.reset).alias("reset"), F.lit(a.daily).alias("daily"))
        for i, a in enumerate(alerts(p))
    ]
    out = rows.select("symbol", "t", "eval_day", *(more or []), F.struct(*SHOWN).alias("bar"), F.inline(F.array(*each))).where("trigger or reset")
    return out.withColumn("bar", F.when(F.col("trigger"), F.col("bar")))


#: Columns that the alerts' texts show.
SHOWN = ["high", "low", "close", "ppo", "sig", "srsi", "mmh", "vwap", *LEVELS]


def with_text(fired: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Alerts (symbol, t, ord, bar) with close, title and text in bar's place."""
    each = alerts(p)
    text = F.lit(None).cast("string")
    for i, a in enumerate(each):
        text = F.when(F.col("ord") == i, a.text).otherwise(text)
    title = F.element_at(F.array(*[F.lit(a.title) for a in each]), F.col("ord") + 1)
    return fired.select("*", "bar.*").select(*[c for c in fired.columns if c != "bar"], "close", title.alias("title"), text.alias("text"))
