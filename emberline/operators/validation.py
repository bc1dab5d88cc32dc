"""Checks of candles: flags, reasons, and rejection of series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.text import money
from emberline.operators.panel import day_of, lagged
from emberline.params import DEFAULT, Params

OHLC = ("open", "high", "low", "close")


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def bad_row() -> Column:
    """A price is missing or not finite, not positive, or outside the candle's range."""
    finite = F.lit(True)
    for f in OHLC:
        finite = finite & is_finite(F.col(f)) & F.coalesce(F.col(f) > 0, F.lit(False))
    o, h, lo, c = (F.col(f) for f in OHLC)
    return ~(finite & F.coalesce((lo <= o) & (o <= h) & (lo <= c) & (c <= h), F.lit(False)))


def reject(bars: DataFrame, keys: list[str], policy: str = "series") -> DataFrame:
    """Without bad rows, or, by policy `series`, without the series (keys) that have one."""
    if policy == "row":
        return bars.where(~bad_row())
    bad = bars.where(bad_row()).select(*keys).distinct()
    return bars.join(bad, keys, "left_anti")


def is_anomalous() -> Column:
    middle = (F.col("high") + F.col("low")) / 2
    return F.abs(F.col("close") - middle) / (middle + 1e-9) > 0.5


def audit(rows: DataFrame, keys: list[str], arrival: str, required: int, gap: int) -> DataFrame:
    """By series, in the order of arrival: rows, least step of t, backward steps, gaps of more than `gap` seconds, and whether the strict check holds."""
    stepped = lagged(rows, keys, F.floor(F.col(arrival) / 100_000), [arrival], F.col("t"), "_before").withColumn("_step", F.col("t") - F.col("_before"))
    out = stepped.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_step").alias("least_step"), F.count_if(F.col("_step") < 0).alias("backward"), F.count_if(F.col("_step") > gap).alias("gaps"))
    return out.withColumn("ok", (F.col("n") >= required) & (F.col("backward") == 0))


def with_reason(bars: DataFrame, minutes: int, p: Params = DEFAULT, reference: Column | None = None, before: Column | None = None) -> DataFrame:
    """bars with reason: the first check that fails, null if none does.

    The reference time is the candle's close and the publication lag unless given; before is the
    close of the candle before, found here unless given.
    """
    width = minutes * 60
    rows = lagged(bars, ["symbol"], day_of(F.col("t")), ["t"], F.col("close"), "_c") if before is None else bars.withColumn("_c", before)
    ref = reference if reference is not None else F.col("t") + width + p.lag
    start = F.floor(ref / width) * width
    o, h, lo, c = (F.col(f) for f in OHLC)
    missing, endless, low = F.lit(False), F.lit(False), F.lit(False)
    for f in OHLC:
        missing = missing | F.col(f).isNull() | F.isnan(f)
        endless = endless | (F.abs(F.col(f)) == float("inf"))
        low = low | (F.col(f) <= 0)
    failed = F.concat_ws(", ", *[F.when(~ok, name) for name, ok in (("L≤O", lo <= o), ("O≤H", o <= h), ("L≤C", lo <= c), ("C≤H", c <= h), ("L≤H", lo <= h))])
    jump = F.when(F.col("_c") > 0, F.abs(c - F.col("_c")) / F.col("_c") * 100)
    reason = (
        F.when(F.col("t") >= start, F.lit("still forming"))
        .when(ref - F.col("t") > p.staleness, F.concat(F.lit("stale: "), (ref - F.col("t")).cast("string"), F.lit("s")))
        .when(missing, F.lit("missing value"))
        .when(endless, F.lit("infinite value"))
        .when(low, F.lit("non-positive price"))
        .when(failed != "", F.concat(F.lit("invalid relationships: "), failed))
        .when(jump > p.max_jump, F.concat(F.lit("price gap: "), money(jump), F.lit("%")))
    )
    return rows.withColumn("reason", reason).drop("_c")


def last_closed(bars: DataFrame, minutes: int, reference: int, p: Params = DEFAULT) -> DataFrame:
    """The last closed candle of each symbol, with its checks of expected time, age and publication lag."""
    width = minutes * 60
    start = reference // width * width
    rows = bars.where((F.col("t") >= start - width) & (F.col("t") < start))
    top = rows.groupBy("symbol").agg(F.max_by(F.struct(*[c for c in bars.columns if c != "symbol"]), "t").alias("_top")).select("symbol", "_top.*")
    return top.select(
        "*",
        (F.abs(F.col("t") - (start - width)) <= p.tolerance).alias("as_expected"),
        (reference - F.col("t") <= p.staleness).alias("fresh"),
        (reference - (F.col("t") + width) >= p.lag).alias("published"),
    )


def feed_delay(bars: DataFrame, minutes: int, reference: int) -> DataFrame:
    width = minutes * 60
    expected = reference // width * width - width
    out = bars.where(F.col("t") <= reference).groupBy("symbol").agg(F.max("t").alias("last_t"))
    d = F.col("last_t") - expected
    return out.select("symbol", "last_t", F.when(F.abs(d) <= 300, "on time").when(d < 0, "delayed").otherwise("ahead").alias("state"), F.abs(d).alias("seconds"))
