"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberline.functions import text as tx
from emberline.operators import delivery, reports, signals, validation
from emberline.operators.panel import day_of, frame, numbered, over_blocks
from emberline.operators.recursions import recursive
from emberline.params import DEFAULT as P
from emberline.plans.oracle import VIEWS, sql
from emberline.sources import candles
from emberline.storage import materialize, scratch
from emberline.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The reference time of queries at one instant: 2024-01-20 00:00:30 UTC.
REFERENCE = 1_705_708_830
#: Configured instruments: symbol and id. The events have five of these.
SYMBOLS = {"click": 27, "error": 139, "purchase": 3136, "signup": 15041, "view": 14745, "refund": 14969}


class Data:
    """Tables of one folder, each derived once."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    @cached_property
    def events(self) -> DataFrame:
        return candles.events(self.spark, self.dir)

    @cached_property
    def ticks(self) -> DataFrame:
        return candles.ticks(self.events)

    def bars(self, minutes: int) -> DataFrame:
        return candles.candles(self.ticks, minutes)

    @cached_property
    def b15(self) -> DataFrame:
        return numbered(self.bars(15))

    @cached_property
    def b5(self) -> DataFrame:
        return numbered(self.bars(5))

    @cached_property
    def daily(self) -> DataFrame:
        return self.bars(1440)

    @cached_property
    def features(self) -> DataFrame:
        """From 5-minute candles, made once; longer ones are rolled up from them."""
        five = materialize(self.bars(5))
        return signals.features(numbered(candles.rollup(five, 15)), numbered(five), candles.rollup(five, 1440))

    @cached_property
    def evaluated(self) -> DataFrame:
        return materialize(signals.evaluated(self.features))

    @cached_property
    def alerts(self) -> DataFrame:
        return signals.long_alerts(self.evaluated)

    @cached_property
    def fired(self) -> DataFrame:
        return delivery.latched(self.alerts)

    @cached_property
    def capped(self) -> DataFrame:
        return delivery.cap_pivots(delivery.cap_symbol(self.fired))

    @cached_property
    def every(self) -> DataFrame:
        """Candles of all resolutions: symbol, resolution in minutes, t."""
        five = materialize(self.bars(5))
        rows = five.select("symbol", F.lit(5).alias("resolution"), "t")
        for m in (15, 1440):
            rows = rows.unionByName(candles.rollup(five, m).select("symbol", F.lit(m).alias("resolution"), "t"))
        return rows

    def told(self, alerts: DataFrame) -> DataFrame:
        return signals.with_text(alerts.drop("eval_day", "trigger", "reset", "daily"))


def query(statement: str | None = None, *needs: str) -> Callable:
    """Registers a function of Data under its name, with its SQL."""

    def register(f: Callable[[Data], DataFrame]) -> Callable[[Data], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Data(spark, sf_dir))
        if statement is not None:
            ORACLES[f.__name__] = sql(statement, *needs) if needs else statement
        return f

    return register


def r6(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


def s6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) as {n.rpartition('.')[2]}" for n in names)


BAR = ("open", "high", "low", "close", "volume")
_bars = f"select symbol, t, {s6(*BAR)} from "


# sources -----------------------------------------------------------------------------------------


@query(f"select symbol, t, {s6(*BAR)} from b15 where symbol in ('click', 'view') and t between {REFERENCE // 900 * 900 - 900 - 350 * 900} and {REFERENCE + 2700}", "b15")
def candle_scan(d: Data) -> DataFrame:
    return candles.scan(candles.land(d.bars(15), scratch(d.spark, "candles")), ["click", "view"], 15, REFERENCE, 350).select("symbol", "t", *r6(*BAR))


@query(
    f"""select r.symbol, r.resolution, count(b.t) as candles, max(b.t) as last_t from (select * from (values {", ".join(f"('{s}')" for s in SYMBOLS)}) v(symbol), (values (5), (15), (1440)) w(resolution)) r
    left join (select symbol, t, 5 as resolution from b5 union all select symbol, t, 15 from b15 union all select symbol, t, 1440 from b1d) b on r.symbol = b.symbol and r.resolution = b.resolution group by all""",
    "b5", "b15", "b1d",
)
def scan_coverage(d: Data) -> DataFrame:
    requests = d.spark.createDataFrame([(s, m) for s in SYMBOLS for m in (5, 15, 1440)], "symbol string, resolution int")
    return candles.coverage(requests, d.every)


@query(_bars + "b15", "b15")
def parse_candles(d: Data) -> DataFrame:
    return candles.parse(candles.payloads(d.bars(15))).select("symbol", "t", *r6(*BAR))


@query(_bars + "b15", "b15")
def bars_15m(d: Data) -> DataFrame:
    return d.bars(15).select("symbol", "t", *r6(*BAR))


@query(_bars + "b5", "b5")
def bars_5m(d: Data) -> DataFrame:
    return d.bars(5).select("symbol", "t", *r6(*BAR))


@query(_bars + "b1d", "b1d")
def bars_1d(d: Data) -> DataFrame:
    return d.bars(1440).select("symbol", "t", *r6(*BAR))


@query(f"select event_type as symbol, id, 'perpetual_futures' as contract_type, count(*) as events from events join (values {', '.join(f"('{k}', {v})" for k, v in SYMBOLS.items())}) v(symbol, id) on event_type = symbol group by all")
def symbol_dim(d: Data) -> DataFrame:
    dim = d.spark.createDataFrame([(s, i) for s, i in SYMBOLS.items()], "symbol string, id int").withColumn("contract_type", F.lit("perpetual_futures"))
    return d.events.groupBy("symbol").agg(F.count(F.lit(1)).alias("events")).join(dim, "symbol").select("symbol", "id", "contract_type", "events")


# validation --------------------------------------------------------------------------------------

#: Candles with faults: some have no close, some a high below the low.
_faulty = "select symbol, t, t // 86400 as day, open, case when t // 900 % 307 = 0 then low - 1 else high end as high, low, case when t // 900 % 211 = 0 then null else close end as close from b15"


def faulty(d: Data) -> DataFrame:
    bar = F.floor(F.col("t") / 900)
    rows = d.bars(15).withColumn("high", F.when(bar % 307 == 0, F.col("low") - 1).otherwise(F.col("high"))).withColumn("close", F.when(bar % 211 != 0, F.col("close")))
    return rows.select("symbol", "t", day_of(F.col("t")).alias("day"), "open", "high", "low", "close")


@query(
    f"""select symbol, day, count(*) as n, round(sum(close), 4) as total from ({_faulty}) f where not exists (select 1 from ({_faulty}) g where g.symbol = f.symbol and g.day = f.day
    and (g.close is null or g.open is null or not (g.low <= g.open and g.open <= g.high and g.low <= g.close and g.close <= g.high) or least(g.open, g.high, g.low, g.close) <= 0)) group by 1, 2""",
    "b15",
)
def reject_invalid_series(d: Data) -> DataFrame:
    return validation.reject(faulty(d), ["symbol", "day"]).groupBy("symbol", "day").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("close"), 4).alias("total"))


@query("select symbol, count(*) as n, count(*) filter (where abs(close - (high + low) / 2) / ((high + low) / 2 + 1e-9) > 0.5) as anomalous from vb15 group by 1", "vb15")
def anomaly_flags(d: Data) -> DataFrame:
    return candles.value_candles(d.events, 15).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count_if(validation.is_anomalous()).alias("anomalous"))


@query(
    """select symbol, count(*) as n, min(s) as least_step, count(*) filter (where s < 0) as backward, count(*) filter (where s > 3600) as gaps, count(*) >= 250 and count(*) filter (where s < 0) = 0 as ok
    from (select symbol, t - lag(t) over (partition by symbol order by event_id) as s from ev) group by 1""",
    "ev",
)
def series_audit(d: Data) -> DataFrame:
    return validation.audit(d.events, ["symbol"], "event_id", 250, 3600)


@query(
    f"""select symbol, t, case when least(open, high, low, close) <= 0 then 'non-positive price' when abs(close - c) / nullif(c, 0) * 100 > {P.max_jump} and c > 0
    then 'price gap: ' || round((abs(close - c) / c * 100)::decimal(28,10), 2)::decimal(38,2) || '%' end as reason from (select *, lag(close) over (partition by symbol order by t) as c from vb15)""",
    "vb15",
)
def bar_validity(d: Data) -> DataFrame:
    return validation.with_reason(candles.value_candles(d.events, 15), 15).select("symbol", "t", "reason")


_start = REFERENCE // 900 * 900


@query(
    f"""select symbol, max(t) as t, round(arg_max(close, t), 6) as close, abs(max(t) - {_start - 900}) <= {P.tolerance} as as_expected, {REFERENCE} - max(t) <= {P.staleness} as fresh, {REFERENCE} - max(t) - 900 >= {P.lag} as published
    from b15 where t >= {_start - 900} and t < {_start} group by 1""",
    "b15",
)
def last_closed_bar(d: Data) -> DataFrame:
    return validation.last_closed(d.bars(15), 15, REFERENCE).select("symbol", "t", *r6("close"), "as_expected", "fresh", "published")


@query(
    f"""select symbol, last_t, case when abs(last_t - {_start - 900}) <= 300 then 'on time' when last_t < {_start - 900} then 'delayed' else 'ahead' end as state, abs(last_t - {_start - 900}) as seconds
    from (select symbol, max(t) as last_t from b15 where t <= {REFERENCE} group by 1)""",
    "b15",
)
def feed_delay(d: Data) -> DataFrame:
    return validation.feed_delay(d.bars(15), 15, REFERENCE)


@query(
    """select event_id, case when event_id % 7 = 0 or event_id % 11 = 0 or value is null then -1.0 else value end as clean,
    case when event_id % 7 = 0 or value is null then null else greatest(least(value * 1e7, 1e8), -1e8) end as clamped from events"""
)
def sanitize(d: Data) -> DataFrame:
    x = F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("double")).when(F.col("event_id") % 11 == 0, float("nan")).otherwise(F.col("value"))
    y = F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("double")).otherwise(F.col("value") * 1e7)
    return d.events.select("event_id", tx.sanitize(x, -1.0).alias("clean"), tx.clamp(y, P.clamp).alias("clamped"))


@query("select event_id, case when event_id % 3 = 0 then 0.0 when event_id % 5 = 0 then 0.0 else value end as number from events")
def safe_cast(d: Data) -> DataFrame:
    s = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("x"), F.col("value").cast("string"))).when(F.col("event_id") % 5 == 0, "Infinity").otherwise(F.col("value").cast("string"))
    return d.events.select("event_id", tx.safe_double(s).alias("number"))


# joins -------------------------------------------------------------------------------------------


@query("select b.symbol, b.t, coalesce(r.rn, 1) as rn5, round(coalesce(r.close, f.close), 6) as close5 from b15 b asof left join b5 r on b.symbol = r.symbol and b.t >= r.t left join (select * from b5 where rn = 1) f on f.symbol = b.symbol", "b15", "b5")
def asof_15m_5m(d: Data) -> DataFrame:
    five = materialize(d.bars(5))  # made once; longer candles are rolled up from them
    right = numbered(five).select("symbol", "t", F.col("close").alias("close5"), F.col("rn").alias("rn5"))
    return signals.asof(candles.rollup(five, 15), right, ["close5", "rn5"]).select("symbol", "t", "rn5", *r6("close5"))


@query(f"select b.symbol, b.t, (b.t + 900 + {P.lag}) // 86400 as eval_day, {', '.join(f'round(coalesce({n}, 0), 6)::double as {n}' for n in signals.LEVELS)} from b15 b left join piv on b.symbol = piv.symbol and (b.t + 900 + {P.lag}) // 86400 = piv.day", "b15", "piv")
def pivot_join(d: Data) -> DataFrame:
    return signals.with_pivots(d.bars(15), d.daily).select("symbol", "t", "eval_day", *r6(*signals.LEVELS))


# rolling and recursive indicators ----------------------------------------------------------------


@query("select symbol, t, round(case when rn >= 20 then avg(close) over (partition by symbol order by rn rows 19 preceding) end, 6) as sma from b15", "b15")
def sma(d: Data) -> DataFrame:
    return over_blocks(d.b15, {"sma": F.when(F.col("rn") >= 20, F.avg("close").over(frame(20)))}, 20).select("symbol", "t", *r6("sma"))


@query(f"select symbol, t, {s6('least', 'most')} from (select symbol, t, case when count(close) over w = 144 then min(close) over w end as least, case when count(close) over w = 144 then max(close) over w end as most from b15 window w as (partition by symbol order by rn rows 143 preceding))", "b15")
def rolling_min_max(d: Data) -> DataFrame:
    full = F.count("close").over(frame(144)) == 144
    return over_blocks(d.b15, {"least": F.when(full, F.min("close").over(frame(144))), "most": F.when(full, F.max("close").over(frame(144)))}, 144).select("symbol", "t", *r6("least", "most"))


@query("select symbol, t, round(s, 6) as std from b15 join sd using (symbol, rn)", "b15", "sd")
def rolling_std(d: Data) -> DataFrame:
    x = F.when((F.col("rn") >= P.mmh_std) & (F.count("close").over(frame(P.mmh_std)) >= 2), F.stddev_pop("close").over(frame(P.mmh_std)) * P.mmh_response).otherwise(0.0)
    return over_blocks(d.b15, {"std": x}, P.mmh_std).select("symbol", "t", *r6("std"))


def indicator(name: str, columns: dict[str, str], statement: str, *needs: str, five: bool = False) -> None:
    """A query of recursive indicators: their names, each with the name of its column."""

    def f(d: Data) -> DataFrame:
        return recursive(d.b5 if five else d.b15, list(columns)).select("symbol", "t", *[F.round(k, 6).alias(v) for k, v in columns.items()])

    f.__name__ = name
    query(statement, *needs)(f)


indicator("ema", {"ema": "ema"}, "select b.symbol, t, round(y, 6) as ema from fast join b15 b using (symbol, rn)", "fast", "b15")
indicator("rma", {"rma": "rma50"}, f"select b.symbol, t, round(case when n < {P.rma_short} then 0 else y end, 6) as rma50 from rma50 join b15 b using (symbol, rn)", "rma50", "b15")
indicator("rma_5m", {"rma_long": "rma200"}, "select symbol, t, round(rma200v, 6)::double as rma200 from r5", "r5", five=True)
indicator("ppo", {"ppo": "ppo", "sig": "ppo_signal"}, "select b.symbol, t, round(x, 6) as ppo, round(y, 6) as ppo_signal from ppo join sig using (symbol, rn) join b15 b using (symbol, rn)", "ppo", "sig", "b15")
indicator("rsi", {"rsi": "rsi"}, "select b.symbol, t, round(x, 6) as rsi from rsi join b15 b using (symbol, rn)", "rsi", "b15")
_rsi_a, _rsi_n = 1 / P.rsi_len, P.rsi_len


@query(
    f"""select symbol, t, round(x, 6)::double as rsi from (with recursive
    g as (select symbol, rn, t, case when close >= open then close end as c from b15),
    k as (select *, last_value(c ignore nulls) over (partition by symbol order by rn rows between unbounded preceding and 1 preceding) as before,
      rn - min(case when c is not null then rn end) over (partition by symbol) as place, max(rn) over (partition by symbol) as n from g),
    d as (select *, case when c is not null and before is not null then c - before else 0 end as ch from k),
    s as (select *, sum(case when place between 1 and {_rsi_n} then greatest(ch, 0) end) over (partition by symbol) / {_rsi_n} as g0, sum(case when place between 1 and {_rsi_n} then greatest(-ch, 0) end) over (partition by symbol) / {_rsi_n} as l0 from d),
    r as (select symbol, rn, g0 as up, l0 as down from s where place = {_rsi_n - 1}
      union all select s.symbol, s.rn, case when s.c is null then r.up else greatest(s.ch, 0) * {_rsi_a!r} + r.up * {1 - _rsi_a!r} end, case when s.c is null then r.down else greatest(-s.ch, 0) * {_rsi_a!r} + r.down * {1 - _rsi_a!r} end from r join s on s.symbol = r.symbol and s.rn = r.rn + 1)
    select s.symbol, s.t, case when s.n <= {_rsi_n} or r.rn is null or s.place < {_rsi_n} then 50 when r.down = 0 then case when r.up > 0 then 100 else 50 end else 100 - 100 / (1 + r.up / r.down) end as x from s left join r on r.symbol = s.symbol and r.rn = s.rn)""",
    "b15",
)
def rsi_gaps(d: Data) -> DataFrame:
    """RSI of series in which the closes of falling candles are missing."""
    rows = d.b15.withColumn("close", F.when(F.col("close") >= F.col("open"), F.col("close")))
    return recursive(rows, ["rsi"]).select("symbol", "t", F.round("rsi", 6).alias("rsi"))


indicator("kalman", {"kalman": "kalman"}, "select b.symbol, t, round(y, 6) as kalman from kal_close join b15 b using (symbol, rn)", "kal_close", "b15")
indicator("smooth_rsi", {"srsi": "srsi"}, "select b.symbol, t, round(x, 6) as srsi from srsi join b15 b using (symbol, rn)", "srsi", "b15")
indicator("atr", {"tr": "tr", "atr_s": "atr_short", "atr_l": "atr_long"}, f"select b.symbol, t, round(x, 6) as tr, round(case when b.n >= {P.atr_short} then a.y end, 6) as atr_short, round(case when b.n >= {P.atr_long} then l.y end, 6) as atr_long from tr join atr_s a using (symbol, rn) join atr_l l using (symbol, rn) join b15 b using (symbol, rn)", "tr", "atr_s", "atr_l", "b15")
indicator("smooth_range", {"range_1": "range_1", "range_2": "range_2"}, "select b.symbol, t, round(p.r, 6) as range_1, round(q.r, 6) as range_2 from sr1 p join sr2 q using (symbol, rn) join b15 b using (symbol, rn)", "sr1", "sr2", "b15")
indicator("range_filter", {"filter_1": "filter_1", "filter_2": "filter_2"}, "select b.symbol, t, round(p.y, 6) as filter_1, round(q.y, 6) as filter_2 from rf1 p join rf2 q using (symbol, rn) join b15 b using (symbol, rn)", "rf1", "rf2", "b15")
indicator("cloud_trend", {"trend": "up"}, "select b.symbol, t, up::double as up from trend join b15 b using (symbol, rn)", "trend", "b15")
indicator("cirrus_cloud", {"cloud_up": "up", "cloud_down": "down"}, "select b.symbol, t, up::double as up, down::double as down from cloud join b15 b using (symbol, rn)", "cloud", "b15")
indicator("mmh_worm", {"worm": "worm"}, "select b.symbol, t, round(y, 6) as worm from worm join b15 b using (symbol, rn)", "worm", "b15")
indicator("mmh_raw", {"mmh_raw": "raw"}, "select b.symbol, t, round(raw, 6) as raw from mraw join b15 b using (symbol, rn)", "mraw", "b15")
indicator("mmh_value", {"mmh_value": "value"}, "select b.symbol, t, round(y, 6) as value from mval join b15 b using (symbol, rn)", "mval", "b15")
indicator("mmh_momentum", {"mmh_momentum": "momentum"}, "select b.symbol, t, round(x, 6) as momentum from mmom join b15 b using (symbol, rn)", "mmom", "b15")
indicator("mmh", {"mmh": "mmh"}, "select b.symbol, t, round(y, 6) as mmh from mmh join b15 b using (symbol, rn)", "mmh", "b15")


@query(
    """select symbol, t, round(list_reduce(list_prepend(c[1], c), lambda y, x: 0.25 * x + 0.75 * y), 6) as ema from (
    select symbol, t, list(close) over (partition by symbol order by rn rows 350 preceding) as c from b15)""",
    "b15",
)
def ema_trailing(d: Data) -> DataFrame:
    """The recursion begun anew for each candle on its last 351."""
    return recursive(d.b15, ["ema_trailing"]).select("symbol", "t", F.round("ema_trailing", 6).alias("ema"))


@query("select symbol, t, round(x, 6) as vwap from vwap", "vwap")
def vwap(d: Data) -> DataFrame:
    w = Window.partitionBy("symbol", day_of(F.col("t"))).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    price = (F.col("high") + F.col("low") + F.col("close")) / 3
    v = F.sum("volume").over(w)
    x = F.coalesce(F.when(v != 0, F.sum(price * F.col("volume")).over(w) / v).otherwise(price), F.col("close"))
    return d.bars(15).withColumn("vwap", x).select("symbol", "t", *r6("vwap"))


@query(f"select symbol, day, {', '.join(f'round({n}, 6)::double as {n}' for n in signals.LEVELS)} from piv", "piv")
def pivot_levels(d: Data) -> DataFrame:
    return signals.pivots(d.daily).select("symbol", "day", *r6(*signals.LEVELS))


@query(
    """select symbol, t, coalesce(h - l > 0 and (abs(close - h) < 0.5 * (h - l) or abs(close - l) < 0.5 * (h - l)), false) as near from (
    select symbol, t, close, max(high) over w as h, min(low) over w as l from b15 window w as (partition by symbol, t // 86400 order by t rows unbounded preceding))""",
    "b15",
)
def pivot_gate(d: Data) -> DataFrame:
    w = Window.partitionBy("symbol", day_of(F.col("t"))).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    rows = d.bars(15).withColumns({"_h": F.max("high").over(w), "_l": F.min("low").over(w)})
    half = 0.5 * (F.col("_h") - F.col("_l"))
    return rows.select("symbol", "t", ((half > 0) & ((F.abs(F.col("close") - F.col("_h")) < half) | (F.abs(F.col("close") - F.col("_l")) < half))).alias("near"))


FEATURE = ("ppo", "sig", "srsi", "rma", "rma200", "atr_s", "atr_l", "cloud_up", "cloud_down", "mmh", "vwap", "close5", *signals.LEVELS)


@query(f"select symbol, t, rn, {', '.join(f'round({n}, 6)::double as {n}' for n in FEATURE)}, buy, sell from gt", "gt")
def features(d: Data) -> DataFrame:
    return d.features.select("symbol", "t", "rn", *r6(*FEATURE), "buy", "sell")


# gates -------------------------------------------------------------------------------------------


@query("select symbol, t, buy_candle as ok from gt", "gt")
def wick_buy(d: Data) -> DataFrame:
    return atrs(d).select("symbol", "t", signals.wick(True).alias("ok"))


@query("select symbol, t, sell_candle as ok from gt", "gt")
def wick_sell(d: Data) -> DataFrame:
    return atrs(d).select("symbol", "t", signals.wick(False).alias("ok"))


def atrs(d: Data) -> DataFrame:
    return recursive(d.b15, ["atr_s", "atr_l"])


@query("select symbol, t, buy_candle, sell_candle from gt", "gt")
def candle_quality(d: Data) -> DataFrame:
    return atrs(d).select("symbol", "t", signals.wick(True).alias("buy_candle"), signals.wick(False).alias("sell_candle"))


#: Every hundredth candle's close is beyond its range, which the reason tells.
_odd = "select symbol, t, open, high, low, case when t // 900 % 101 = 0 then high + 1 when t // 900 % 103 = 0 then low - 1 else close end as close from b15"


@query(f"select symbol, t, {reports.quality_sql(True)} as buy, {reports.quality_sql(False)} as sell from ({_odd})", "b15")
def quality_reason(d: Data) -> DataFrame:
    bar = F.floor(F.col("t") / 900)
    close = F.when(bar % 101 == 0, F.col("high") + 1).when(bar % 103 == 0, F.col("low") - 1).otherwise(F.col("close"))
    return d.bars(15).withColumn("close", close).select("symbol", "t", signals.quality_reason(True).alias("buy"), signals.quality_reason(False).alias("sell"))


@query("select symbol, t, buy_trend, sell_trend, buy, sell from gt", "gt")
def gates(d: Data) -> DataFrame:
    return d.features.select("symbol", "t", "buy_trend", "sell_trend", "buy", "sell")


@query("select symbol, t, mmh_up, mmh_down from gt", "gt")
def mmh_reversal(d: Data) -> DataFrame:
    return d.features.select("symbol", "t", "mmh_up", "mmh_down")


@query("select symbol, t, eval_day, rn from evd", "evd")
def evaluated_bars(d: Data) -> DataFrame:
    return d.evaluated.select("symbol", "t", "eval_day", "rn")


# alerts ------------------------------------------------------------------------------------------


@query("select symbol, t, key, text from la where trigger and key not like 'pivot%'", "la")
def alerts_raw_base(d: Data) -> DataFrame:
    return d.told(d.alerts.where(F.col("trigger") & ~F.col("key").startswith("pivot"))).select("symbol", "t", "key", "text")


@query("select symbol, t, key, text from la where trigger and key like 'pivot%'", "la")
def alerts_raw_pivot(d: Data) -> DataFrame:
    return d.told(d.alerts.where(F.col("trigger") & F.col("key").startswith("pivot"))).select("symbol", "t", "key", "text")


@query(
    """select symbol, t, case when vwap is null or vwap_lag1 is null then 'VWAP not available' when close <= open then 'red candle'
      when not ((close_lag1 <= vwap_lag1 and close > vwap) or (close_lag1 < vwap_lag1 and close >= vwap)) then 'no cross' when abs(close - vwap) / vwap * 100 > 1 then 'too far'
      when high - low > 1e-9 and (high - greatest(open, close)) / (high - low) >= 0.2 then 'wick too large' end as up,
    case when vwap is null or vwap_lag1 is null then 'VWAP not available' when close >= open then 'green candle' when not (close_lag1 > vwap_lag1 and close < vwap) then 'no cross'
      when abs(close - vwap) / vwap * 100 > 1 then 'too far' when high - low > 1e-9 and (least(open, close) - low) / (high - low) >= 0.2 then 'wick too large' end as down
    from gt""",
    "gt",
)
def vwap_cross_diag(d: Data) -> DataFrame:
    rows = recursive(d.b15, ["close'1", "vwap", "vwap'1"])
    return rows.select("symbol", "t", reports.vwap_cross(True).alias("up"), reports.vwap_cross(False).alias("down"))


@query("select symbol, t, key, title, text from lat", "lat")
def alerts_latched(d: Data) -> DataFrame:
    return d.told(d.fired).select("symbol", "t", "key", "title", "text")


@query("select symbol, 'ALERT:' || upper(key) as state_key, case when arg_max(trigger, t) then 'ACTIVE' else 'INACTIVE' end as state, max(t) as t from la where trigger or reset group by symbol, key", "la")
def alert_state_latest(d: Data) -> DataFrame:
    return delivery.latest_state(d.alerts)


_state_now = 1_706_659_200  # 2024-01-31
_state_cut = 1_705_276_800  # 2024-01-15


@query(
    f"""with l as (select symbol, 'ALERT:' || upper(key) as state_key, arg_max(trigger, t) as on_, max(t) as t from la where trigger or reset group by 1, 2),
    v as (select symbol, state_key, '{{"state":"' || case when on_ then 'ACTIVE' else 'INACTIVE' end || '","ts":' || t || '}}' as value, t as written, case when state_key like 'ALERT:PIVOT%' then {P.meta_ttl} else {P.state_ttl} end as ttl from l)
    select symbol, state_key, value, written, ttl::int as ttl from v where written + ttl > {_state_now} and not (symbol = 'error' and state_key like 'ALERT:VWAP%')""".replace("with l as", "select * from (with l as") + ")",
    "la",
)
def state_sink(d: Data) -> DataFrame:
    """States written in two batches, the second of which deletes some keys and meets the time at which some have expired; those of pivots have the short life of metadata."""
    rows = materialize(d.alerts.select("symbol", "key", "trigger", "t"))

    def states(part: DataFrame) -> DataFrame:
        latest = delivery.latest_state(part)
        ttl = F.when(F.col("state_key").startswith("ALERT:PIVOT"), P.meta_ttl).otherwise(P.state_ttl)
        return latest.select("symbol", "state_key", F.to_json(F.struct("state", F.col("t").alias("ts"))).alias("value"), F.col("t").alias("written"), ttl.alias("ttl"))

    early, late = states(rows.where(F.col("t") < _state_cut)), states(rows.where(F.col("t") >= _state_cut))
    stored = delivery.upsert_state(early.where(F.lit(False)), early, early.where(F.lit(False)), _state_cut)
    gone = early.unionByName(late).where(F.col("state_key").startswith("ALERT:VWAP") & (F.col("symbol") == "error"))
    return delivery.upsert_state(stored, late, gone, _state_now)


@query(
    f"""select s.symbol, k.state_key, coalesce(l.trigger and l.symbol <> 'error', false) as active from (select unnest([{", ".join(f"'{s}'" for s in SYMBOLS)}]) as symbol) s, (select distinct 'ALERT:' || upper(key) as state_key from la where trigger or reset) k
    left join (select symbol, 'ALERT:' || upper(key) as state_key, arg_max(trigger, t) as trigger from la where trigger or reset group by 1, 2) l on l.symbol = s.symbol and l.state_key = k.state_key""",
    "la",
)
def alert_state_read(d: Data) -> DataFrame:
    """States stored as JSON, broken for one symbol, and read for every configured symbol and key."""
    latest = delivery.latest_state(d.alerts)
    stored = latest.select("symbol", "state_key", F.when(F.col("symbol") == "error", "{broken").otherwise(F.to_json(F.struct("state", F.col("t").alias("ts")))).alias("value"))
    wanted = stored.select("state_key").distinct().select(F.explode(F.array(*[F.lit(s) for s in SYMBOLS])).alias("symbol"), "state_key")
    return delivery.read_state(wanted, stored)


@query("select symbol, t, key, k::int as place from cap8", "cap8")
def cap_per_symbol(d: Data) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("symbol", "t").orderBy("ord"))
    return delivery.cap_symbol(d.fired).select("symbol", "t", "key", place.alias("place"))


@query("select symbol, t, key, rank::int as rank from cap3", "cap3")
def cap_pivots(d: Data) -> DataFrame:
    return d.capped.select("symbol", "t", "key", "rank")


@query(f"select t, symbol, alerts, total::bigint as total, total <= {P.cap_run} as counted from (select *, sum(alerts) over (partition by t order by symbol) as total from (select t, symbol, count(*) as alerts from cap3 group by 1, 2))", "cap3")
def cap_per_run(d: Data) -> DataFrame:
    return delivery.cap_run(d.capped.groupBy("t", "symbol").agg(F.count(F.lit(1)).alias("alerts")))


@query(f"select event_id, user_id, symbol, t from (select *, row_number() over (partition by user_id, symbol, t // {P.dedup} order by t, event_id) as k from ev) where k = 1", "ev")
def dedup_bucket(d: Data) -> DataFrame:
    return delivery.dedup_bucket(d.events.select("event_id", "user_id", "symbol", "t"), ["user_id", "symbol"], P.dedup)


def _rolling(keys: str, seconds: int, source: str = "ev") -> str:
    return f"""{source}_n as (select *, row_number() over (partition by {keys} order by t, event_id) as rn from {source}), {source}_r as (
    select {keys}, rn, event_id, t, t as sent, true as ok from {source}_n where rn = 1
    union all select {", ".join(f"n.{k.strip()}" for k in keys.split(","))}, n.rn, n.event_id, n.t, case when n.t - r.sent >= {seconds} then n.t else r.sent end, n.t - r.sent >= {seconds} from {source}_n n join {source}_r r on {" and ".join(f"n.{k.strip()} = r.{k.strip()}" for k in keys.split(","))} and n.rn = r.rn + 1)"""


@query(f"with recursive ev as ({VIEWS['ev'][1]}), {_rolling('symbol', P.dedup)} select event_id, symbol, t from ev_r where ok")
def dedup_rolling(d: Data) -> DataFrame:
    return delivery.rolling_dedup(d.events.select("event_id", "symbol", "t"), ["symbol"], P.dedup, ["t", "event_id"]).select("event_id", "symbol", "t")


@query(f"with recursive ev as ({VIEWS['ev'][1]}), {_rolling('user_id, symbol', P.cooldown)} select event_id, user_id, symbol, t from ev_r where ok")
def cooldown(d: Data) -> DataFrame:
    return delivery.rolling_dedup(d.events.select("event_id", "user_id", "symbol", "t"), ["user_id", "symbol"], P.cooldown, ["t", "event_id"]).select("event_id", "user_id", "symbol", "t")


# reports -----------------------------------------------------------------------------------------


@query("select symbol, t, coalesce(nullif(concat_ws(', ', case when not buy then 'buy_common' end, case when not sell then 'sell_common' end, case when not close > open then 'is_green' end, case when not close < open then 'is_red' end, " + reports.SQL + "), ''), 'No conditions met') as suppression from evd", "evd")
def suppression_reasons(d: Data) -> DataFrame:
    return d.evaluated.select("symbol", "t", reports.suppression().alias("suppression"))


@query(
    "select e.symbol, e.t, case when alerts > 0 then 'ALERT_SENT' else 'NO_SIGNAL' end as state, coalesce(alerts, 0) as alerts, case when cloud_up = 1 then 'green' when cloud_down = 1 then 'red' else 'neutral' end as cloud, round(mmh, 4) + 0.0 as mmh_hist from evd e left join (select symbol, t, count(*) as alerts from cap3 group by 1, 2) c on c.symbol = e.symbol and c.t = e.t",
    "evd", "cap3",
)
def pair_summary(d: Data) -> DataFrame:
    return reports.summary(d.evaluated, d.capped)


@query(
    f"""select r.t, r.evaluated, coalesce(c.sent, 0) as sent, f.success from (select t, count(*) as evaluated from evd group by 1) r
    left join (select t, count(*) as sent from cap3 group by 1) c on c.t = r.t
    join (select q.t, round(100.0 * count(b.t) / count(*), 1)::double as success from (select t, symbol, resolution from (select distinct t from evd), (select unnest([{", ".join(f"'{s}'" for s in SYMBOLS)}]) as symbol), (values (5), (15), (1440)) v(resolution)) q
      left join lateral (select max(a.t) as t from (select symbol, t, 5 as resolution from b5 union all select symbol, t, 15 from b15 union all select symbol, t, 1440 from b1d) a
        where a.symbol = q.symbol and a.resolution = q.resolution and a.t <= q.t and a.t >= q.t - q.resolution * 60 * 350) b on true group by q.t) f on f.t = r.t""",
    "evd", "cap3", "b5", "b15", "b1d",
)
def run_stats(d: Data) -> DataFrame:
    return reports.run_stats(d.evaluated, d.capped, [(s, m) for s in SYMBOLS for m in (5, 15, 1440)], d.every)


_esc = lambda x: f"regexp_replace({x}, '[_*\\[\\]()~`>#+-=|{{}}.!]', '\\\\\\0', 'g')"
_price = "format('{:t,}', floor(round(close::decimal(28,10), 2))::bigint) || '.' || lpad(((round(close::decimal(28,10), 2)::decimal(38,2) * 100)::bigint % 100)::varchar, 2, '0')"
_ist = lambda t: f"strftime(make_timestamp(({t} + 19800) * 1000000), '%d-%m-%Y %H:%M IST')"


@query(
    f"select symbol, t, key, {_esc(f'''split_part(title, ' ', 1) || ' ' || symbol || ' - $' || {_price} || chr(10) || substr(title, strpos(title, ' ') + 1) || ' : ' || text || chr(10) || {_ist('t')}''')} as message from lat",
    "lat",
)
def msg_single(d: Data) -> DataFrame:
    return d.told(d.fired).select("symbol", "t", "key", delivery.single_message(F.col("title"), F.col("symbol"), F.col("close"), F.col("t"), F.col("text")).alias("message"))


_batched = f"""select symbol, t, count(*) as alerts, {_esc(f'''split_part(arg_min(title, rank), ' ', 1) || ' **' || symbol || '** • $' || any_value({_price}) || '  ' || {_ist('t')} || chr(10) || string_agg(case when rank = last then '└➤' else '├➤' end || ' ' || title || ' | ' || text, chr(10) order by rank)''')} as message
from (select *, max(rank) over (partition by symbol, t) as last from cap3 where rank <= 25) group by symbol, t"""


@query(_batched, "cap3")
def msg_batched(d: Data) -> DataFrame:
    return delivery.batched_messages(d.told(d.capped))


@query(f"select doc_id, {_esc('text')} as escaped from documents")
def md_escape(d: Data) -> DataFrame:
    return d.spark.read.parquet(f"{d.dir}/documents.parquet").select("doc_id", tx.md_escape(F.col("text")).alias("escaped"))


@query(
    f"""with recursive m as (select symbol, t // 86400 as day, message, row_number() over (partition by symbol, t // 86400 order by t) as i, floor(strlen(message) * 1.15)::bigint as size from ({_batched})),
    p as (select symbol, day, i, message, size, 1 as batch, case when size > 3996 then 0 else size end as used, case when size > 3996 then 0 else 1 end as held from m where i = 1
      union all select m.symbol, m.day, m.i, m.message, m.size,
        case when m.size > 3996 or p.held = 0 or p.used + m.size + 2 > 3996 then p.batch + 1 else p.batch end,
        case when m.size > 3996 then 0 when p.held = 0 then m.size when p.used + m.size + 2 > 3996 then m.size + 2 else p.used + m.size + 2 end,
        case when m.size > 3996 then 0 when p.held = 0 or p.used + m.size + 2 > 3996 then 1 else p.held + 1 end
      from m join p on m.symbol = p.symbol and m.day = p.day and m.i = p.i + 1)
    select symbol, day, (batch - 1)::int as batch, count(*)::int as messages, string_agg(message, chr(10) || chr(10) order by i) as text from p group by symbol, day, batch""".replace("with recursive m as", "select * from (with recursive m as", 1) + ")",
    "cap3",
)
def msg_pack(d: Data) -> DataFrame:
    """The day's messages of each symbol, packed."""
    rows = delivery.batched_messages(d.told(d.capped)).withColumn("day", day_of(F.col("t")))
    return delivery.packed(rows, ["symbol", "day"], "t")


@query(
    r"""select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\b\d{6,}:[A-Za-z0-9_-]{20,}\b', '[REDACTED_TOKEN]', 'g'), 'chat_id=\d+', 'chat_id=[REDACTED]', 'g'), 'redis://[^@]+@', 'redis://[REDACTED]', 'g') as redacted,
    (regexp_matches(text, '\b\d{6,}:[A-Za-z0-9_-]{20,}\b') or regexp_matches(text, 'chat_id=\d+') or regexp_matches(text, 'redis://[^@]+@')) as hit from (
    select doc_id, text || case when doc_id % 5 = 0 then ' bot 123456789:AAAAAAAAAAbbbbbbbbbbCC-_1 chat_id=42 redis://user:secret@host' else '' end as text from documents)"""
)
def redact_text(d: Data) -> DataFrame:
    secret = F.when(F.col("doc_id") % 5 == 0, " bot 123456789:AAAAAAAAAAbbbbbbbbbbCC-_1 chat_id=42 redis://user:secret@host").otherwise("")
    rows = d.spark.read.parquet(f"{d.dir}/documents.parquet").select("doc_id", F.concat("text", secret).alias("text"))
    return rows.select("doc_id", tx.redact(F.col("text")).alias("redacted"), (tx.redact(F.col("text")) != F.col("text")).alias("hit"))


@query(f"select event_id, {_ist('t')} as shown from ev", "ev")
def ist_time(d: Data) -> DataFrame:
    """Some times are milliseconds."""
    t = F.when(F.col("event_id") % 2 == 0, F.col("t") * 1000).otherwise(F.col("t"))
    return d.events.select("event_id", tx.ist_time(t).alias("shown"))


@query(f"select symbol, t, alerts, message from ({_batched})", "cap3")
def alert_feed(d: Data) -> DataFrame:
    """What the sink gets: a row for each message, keyed by symbol and candle; written as a table and read back."""
    return materialize(delivery.batched_messages(d.told(d.capped)))


@query(
    f"""with recursive k as (select *, case when daily then eval_day else -1 end as d, row_number() over (partition by symbol, key, case when daily then eval_day else -1 end order by t) as i from la where trigger or reset),
    r as (select symbol, key, d, i, t, text, trigger as on_, case when trigger then t end as since, trigger as fires from k where i = 1
      union all select k.symbol, k.key, k.d, k.i, k.t, k.text, k.trigger, case when k.trigger and not (r.on_ and k.t - r.since < {P.state_ttl}) then k.t when k.trigger then r.since end, k.trigger and not (r.on_ and k.t - r.since < {P.state_ttl})
      from k join r on k.symbol = r.symbol and k.key = r.key and k.d = r.d and k.i = r.i + 1)
    select symbol, t, key, text from r where fires""".replace("with recursive k as", "select * from (with recursive k as", 1) + ")",
    "la",
)
def latch_ttl(d: Data) -> DataFrame:
    """The latch with states that expire: exact, run by run."""
    return d.told(delivery.latched_with_ttl(d.alerts, P)).select("symbol", "t", "key", "text")



# streams -----------------------------------------------------------------------------------------

_live = "symbol string, t long, open double, high double, low double, close double, n long"
_stream_bars = f"""select symbol, t, open, high, low, close, n from (select symbol, t // 900 * 900 as t, arg_min(value, (ts, event_id)) as open, max(value) as high, min(value) as low, arg_max(value, (ts, event_id)) as close, count(*) as n
from ev where %s group by 1, 2) where t + 900 <= (select epoch(max(ts)) from ev) - {P.lag}"""


#: The days on which streams go on after a pause.
_pauses = [1_704_672_000, 1_705_708_800]


@query(_stream_bars % "true", "ev")
def stream_bars(d: Data) -> DataFrame:
    """Events arrive in three steps; the candles that are open at a step's end are closed in the next."""
    return live.in_steps(d.spark.read.parquet(f"{d.dir}/events.parquet").withColumn("t", candles.epoch(F.col("ts"))), _pauses, live.scratch(d.spark), lambda rows: live.live_candles(live.events(rows), 15), _live, [], idle=True)


@query(_stream_bars % "t >= 1705276800", "ev")
def stream_late(d: Data) -> DataFrame:
    """Events of the first half of the month come after those of the second half, and are dropped."""
    folder = live.scratch(d.spark)
    source = d.spark.read.parquet(f"{d.dir}/events.parquet")
    late = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    source.where(~late).write.mode("append").parquet(f"{folder}/in")
    live.run(live.live_candles(live.events(live.stream(d.spark, f"{folder}/in")), 15), folder, _live, [], idle=True)
    source.where(late).write.mode("append").parquet(f"{folder}/in")
    return live.run(live.live_candles(live.events(live.stream(d.spark, f"{folder}/in")), 15), folder, _live, [], idle=True)


@query(f"with recursive ev as ({VIEWS['ev'][1]}), {_rolling('user_id, symbol', P.dedup)} select event_id, user_id, symbol, t from ev_r where ok")
def stream_dedup(d: Data) -> DataFrame:
    rows = d.events.select("user_id", "symbol", "t", "event_id")
    return live.in_steps(rows, _pauses, live.scratch(d.spark), lambda r: live.live_dedup(r, ["user_id", "symbol"]), "user_id long, symbol string, t long, event_id long", [])


LIVE = ["ppo", "sig", "srsi", "rma", "atr_s", "atr_l", "cloud_up", "cloud_down", "mmh", "mmh'3", "vwap"]


_warm = live.warm_up(P)


@query(f"select symbol, t, rn, {', '.join(f'case when rn >= {_warm.get(n, 0)} then round({n}, 6) end::double as {n}' for n in (x.replace(chr(39), '_lag') for x in LIVE))} from gt", "gt")
def stream_features(d: Data) -> DataFrame:
    """Indicators of all candles, which arrive in three steps."""
    names = [w.replace("'", "_lag") for w in LIVE]
    kinds = ", ".join(["symbol string, t long, rn long, open double, high double, low double, close double, volume double", *[f"{n} double" for n in names]])
    rows = live.in_steps(d.bars(15), _pauses, live.scratch(d.spark), lambda r: live.live_indicators(r, LIVE, wait=False), kinds, [])
    return rows.select("symbol", "t", "rn", *[F.round(F.when(~F.isnan(n), F.col(n)), 6).alias(n) for n in names])


def both_widths(d: Data) -> DataFrame:
    """15- and 5-minute candles as one stream brings them."""
    five = materialize(d.bars(5))
    return candles.rollup(five, 15).withColumn("width", F.lit(15)).unionByName(five.withColumn("width", F.lit(5)))


_fired = "symbol string, t long, ord int, key string, title string, text string"
_newest = f"(select max(t) from b15) - {P.lag}"


@query(f"select symbol, t, key, title, text from lat where t <= {_newest}", "lat", "b15")
def stream_alerts(d: Data) -> DataFrame:
    """From candles that arrive in three steps to alerts: indicators, as-of, gates, triggers and latch in one query."""
    out = live.in_steps(both_widths(d), _pauses, live.scratch(d.spark), lambda r: live.live_alerts(r).drop("ts"), _fired, [], idle=True)
    return out.select("symbol", "t", "key", "title", "text")


@query(f"select symbol, t, key, rank::int as rank, total::bigint as total, total <= {P.cap_run} as counted from cap3 join (select t, symbol, sum(k) over (partition by t order by symbol) as total from (select t, symbol, count(*) as k from cap3 group by 1, 2)) using (t, symbol) where t <= {_newest}", "cap3", "b15")
def stream_caps(d: Data) -> DataFrame:
    """From candles that arrive in four steps to capped alerts: as stream_alerts, then ranked when a candle's alerts of all symbols are there."""
    kinds = f"{_fired}, rank int, total long, counted boolean"
    out = live.in_steps(both_widths(d), [1_704_400_000, *_pauses], live.scratch(d.spark), lambda r: live.live_caps(live.live_alerts(r)), kinds, [], idle=True)
    return out.select("symbol", "t", "key", "rank", "total", "counted")


@query(_stream_bars % "true", "ev")
def stream_chain(d: Data) -> DataFrame:
    """15-minute candles made of live 5-minute candles in the same query."""
    rows = d.spark.read.parquet(f"{d.dir}/events.parquet").withColumn("t", candles.epoch(F.col("ts")))
    return live.in_steps(rows, _pauses, live.scratch(d.spark), lambda r: live.chained_candles(live.events(r), 15), _live, [], idle=True)


@query(
    f"""select * from (with l as (select symbol, 'ALERT:' || upper(key) as state_key, arg_max(trigger, t) as on_, max(t) as t from la where trigger or reset group by 1, 2)
    select symbol, state_key, '{{"state":"' || case when on_ then 'ACTIVE' else 'INACTIVE' end || '","ts":' || t || '}}' as value, t as written, case when state_key like 'ALERT:PIVOT%' then {P.meta_ttl} else {P.state_ttl} end::bigint as ttl from l)
    where written + ttl > {_state_now} and not (symbol = 'error' and state_key like 'ALERT:VWAP%')""",
    "la",
)
def stream_state(d: Data) -> DataFrame:
    """The states of alerts, written live in three steps, one symbol's VWAP states deleted at the end; read from the stream's own state."""
    rows = materialize(d.alerts.select("symbol", "key", "trigger", "t"))
    state_key = F.concat(F.lit("ALERT:"), F.upper("key"))
    value = F.to_json(F.struct(F.when(F.col("trigger"), "ACTIVE").otherwise("INACTIVE").alias("state"), F.col("t").alias("ts")))
    ttl = F.when(F.col("key").startswith("pivot"), P.meta_ttl).otherwise(P.state_ttl).cast("long")
    changes = rows.select("symbol", state_key.alias("state_key"), value.alias("value"), F.col("t").alias("written"), ttl.alias("ttl"), F.lit(False).alias("deleted"))
    gone = changes.where((F.col("symbol") == "error") & F.col("state_key").startswith("ALERT:VWAP")).select("symbol", "state_key").distinct()
    gone = gone.select("symbol", "state_key", F.lit(None).cast("string").alias("value"), F.lit(_state_now - 1).cast("long").alias("written"), F.lit(0).cast("long").alias("ttl"), F.lit(True).alias("deleted"))
    folder = live.scratch(d.spark)
    live.in_steps(changes.unionByName(gone), [*_pauses, _state_now - 1], folder, live.live_state, "symbol string, state_key string, value string, written long", [], t="written")
    held = live.read_state(d.spark, folder, "values").select("key.symbol", "entry.state_key", "value.*")
    return held.where(F.col("written") + F.col("ttl") > _state_now)


@query("select symbol, t, key from la where trigger or reset", "la")
def stream_sink(d: Data) -> DataFrame:
    """The sink alone: each row once, though every row arrives twice."""
    folder = live.scratch(d.spark)
    rows = materialize(d.alerts.select("symbol", "t", "key"))
    for _ in range(2):
        rows.write.mode("append").parquet(f"{folder}/in")
        out = live.run(live.stream(d.spark, f"{folder}/in"), folder, "symbol string, t long, key string", ["symbol", "t", "key"])
    return out
