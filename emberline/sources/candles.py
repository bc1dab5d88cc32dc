"""Ticks, candles, and candle payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators.panel import DAY, day_of, running_sum

PAYLOAD = "struct<result: struct<t: array<bigint>, o: array<double>, h: array<double>, l: array<double>, c: array<double>, v: array<double>>>"
FIELDS = ("t", "o", "h", "l", "c", "v")


def epoch(ts: Column) -> Column:
    """Seconds since 1970 of a UTC time stamp without zone."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / 1_000_000)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", F.col("event_type").alias("symbol"), "value", "props").withColumn("t", epoch(F.col("ts")))


def ticks(rows: DataFrame) -> DataFrame:
    """Prices before and after each event: a walk in whole thousandths, so that no order of addition matters."""
    cents = F.round(F.col("value") * 100).cast("long")
    rows = running_sum(rows.withColumn("cents", cents), ["symbol"], day_of(F.col("t")), ["ts", "event_id"], F.col("cents") - 5000, "_sum")
    return rows.select("symbol", "event_id", "ts", "t", "cents", ((F.lit(10_000_000) + F.col("_sum")) / F.lit(1e3)).alias("px"), ((F.lit(10_000_000) + F.col("_sum") - (F.col("cents") - 5000)) / F.lit(1e3)).alias("px_before"))


def candles(rows: DataFrame, minutes: int) -> DataFrame:
    """symbol, t (opening second), open, high, low, close, volume of ticks. Opens at the price before the first tick."""
    width, place = minutes * 60, F.struct("ts", "event_id")
    return (
        rows.groupBy("symbol", (F.floor(F.col("t") / width) * width).alias("t"))
        .agg(
            F.min_by("px_before", place).alias("open"),
            F.max(F.greatest("px_before", "px")).alias("high"),
            F.min(F.least("px_before", "px")).alias("low"),
            F.max_by("px", place).alias("close"),
            (F.sum("cents") / F.lit(100.0)).alias("volume"),
        )
    )


def rollup(bars: DataFrame, minutes: int) -> DataFrame:
    """Longer candles of shorter ones."""
    width = minutes * 60
    return bars.groupBy("symbol", (F.floor(F.col("t") / width) * width).alias("_t")).agg(
        F.min_by("open", "t").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "t").alias("close"), F.sum("volume").alias("volume")
    ).withColumnRenamed("_t", "t")


def value_candles(rows: DataFrame, minutes: int) -> DataFrame:
    """Candles of the raw values, which jump wildly: input for checks."""
    width, place = minutes * 60, F.struct("ts", "event_id")
    return rows.groupBy("symbol", (F.floor(F.col("t") / width) * width).alias("t")).agg(
        F.min_by("value", place).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", place).alias("close"), F.count(F.lit(1)).cast("double").alias("volume")
    )


def land(bars: DataFrame, path: str) -> DataFrame:
    """Candles as a Parquet table by symbol and day, read back: scans of some symbols and days read their folders only."""
    bars.withColumn("day", day_of(F.col("t"))).repartition("symbol", "day").write.partitionBy("symbol", "day").parquet(path)
    return bars.sparkSession.read.schema(", ".join([f"{f.name} {f.dataType.simpleString()}" for f in bars.schema if f.name != "symbol"] + ["symbol string, day long"])).parquet(path)


def scan(bars: DataFrame, symbols: list[str], minutes: int, reference: int, limit: int) -> DataFrame:
    """Candles of some symbols from `limit` before the last closed one up to three after the reference time. Of a landed table, only its folders of these symbols and days are read."""
    width = minutes * 60
    opened = reference // width * width - width
    first, last = opened - limit * width, reference + 3 * width
    rows = bars.where(F.col("symbol").isin(symbols) & F.col("t").between(first, last))
    return rows.where(F.col("day").between(first // DAY, last // DAY)) if "day" in bars.columns else rows


def payloads(bars: DataFrame) -> DataFrame:
    """The wire format, JSON of parallel arrays: one payload a symbol and day (96 candles of 15 minutes). Odd days have milliseconds."""
    rows = F.array_sort(F.collect_list(F.struct("t", "open", "high", "low", "close", "volume")))
    day = day_of(F.col("t"))
    grouped = bars.groupBy("symbol", day.alias("day")).agg(rows.alias("_rows"))
    t = F.transform("_rows", lambda x: F.when(F.col("day") % 2 == 1, x["t"] * 1000).otherwise(x["t"]))
    columns = [t.alias("t"), *[F.col(f"_rows.{f}").alias(f[0]) for f in ("open", "high", "low", "close", "volume")]]
    return grouped.select("symbol", "day", F.to_json(F.struct(F.struct(*columns).alias("result"))).alias("payload"))


def parse(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """symbol, t, open, high, low, close, volume. A payload without all six arrays, or with arrays of unequal length, gives no rows. Milliseconds become seconds."""
    r = F.from_json(payload, PAYLOAD)["result"]
    rows = rows.select("symbol", r.alias("r")).where(F.col("r").isNotNull())
    same = F.lit(True)
    for f in FIELDS:
        same = same & (F.size(F.col(f"r.{f}")) == F.size("r.t")) & F.col(f"r.{f}").isNotNull()
    zipped = F.arrays_zip(*[F.col(f"r.{f}").alias(f) for f in FIELDS])
    rows = rows.where(same).select("symbol", F.inline(zipped).alias(*FIELDS))
    seconds = F.when(F.col("t") > 1_000_000_000_000, F.floor(F.col("t") / 1000)).otherwise(F.col("t"))
    return rows.select("symbol", seconds.alias("t"), F.col("o").alias("open"), F.col("h").alias("high"), F.col("l").alias("low"), F.col("c").alias("close"), F.col("v").alias("volume"))


def coverage(requests: DataFrame, bars: DataFrame) -> DataFrame:
    """For each request (symbol, resolution in minutes): the candles there are, none for what is missing. bars has a resolution column."""
    have = bars.groupBy("symbol", "resolution").agg(F.count(F.lit(1)).alias("candles"), F.max("t").alias("last_t"))
    return requests.join(have, ["symbol", "resolution"], "left").select("symbol", "resolution", F.coalesce("candles", F.lit(0).cast("long")).alias("candles"), "last_t")

