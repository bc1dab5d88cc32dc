"""Live counterparts of the batch operators, in Structured Streaming.

Rows of a key come in the order of time over micro-batches, in any order within one; however they are cut into micro-batches, the result is the same.
States go by event time: timers clear what can't matter any more once the watermark has passed it, however long a pause or a replay takes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from emberline.operators import signals
from emberline.operators.panel import DAY
from emberline.params import DEFAULT, Params
from emberline.storage import scratch as new_folder
from emberline.streaming.steps import Steps, warm_up

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream(spark: SparkSession, path: str, files_at_once: int | None = None) -> DataFrame:
    """Parquet files at path as a stream; their schema is that of the files there now. A path is a folder or a glob; a single file needs one, such as event[s].parquet."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).parquet(path)


def events(rows: DataFrame) -> DataFrame:
    """symbol, ts (time stamp with zone, for watermarks), event_id, user_id, value."""
    return rows.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "user_id", "value")


def live_candles(rows: DataFrame, minutes: int, p: Params = DEFAULT) -> DataFrame:
    """Candles of values, sent once they are closed for as long as the publication lag. Later rows are dropped."""
    place = F.struct("ts", "event_id")
    bars = rows.withWatermark("ts", f"{p.lag} seconds").groupBy("symbol", F.window("ts", f"{minutes} minutes").alias("w")).agg(
        F.min_by("value", place).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", place).alias("close"), F.count(F.lit(1)).alias("n")
    )
    return bars.select("symbol", F.unix_seconds("w.start").alias("t"), "open", "high", "low", "close", "n")


def chained_candles(rows: DataFrame, minutes: int, base: int = 5, p: Params = DEFAULT) -> DataFrame:
    """Candles of values made of shorter candles in the same query: windows over the times at which the shorter windows close. As live_candles of the same width."""
    place = F.struct("ts", "event_id")
    of = rows.withWatermark("ts", f"{p.lag} seconds").groupBy("symbol", F.window("ts", f"{base} minutes").alias("w")).agg(
        F.min_by("value", place).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", place).alias("close"), F.count(F.lit(1)).alias("n")
    )
    of = of.select("symbol", F.window_time("w").alias("_at"), "open", "high", "low", "close", "n")
    bars = of.groupBy("symbol", F.window("_at", f"{minutes} minutes").alias("w")).agg(
        F.min_by("open", "_at").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "_at").alias("close"), F.sum("n").alias("n")
    )
    return bars.select("symbol", F.unix_seconds("w.start").alias("t"), "open", "high", "low", "close", "n")


def timed(rows: DataFrame, late: int, end: Column | None = None) -> DataFrame:
    """rows with ts, the time of t (or of end) as a time stamp, whose watermark lies `late` seconds behind the newest. It begins at the epoch, before which no row counts."""
    return rows.withColumn("ts", F.timestamp_seconds(F.col("t") if end is None else end)).withWatermark("ts", f"{late} seconds")


class Repeats(StatefulProcessor):
    """Passes on rows that come at least `seconds` of event time after the last one passed on. That time is forgotten once no row can come so early."""

    def __init__(self, seconds: int, columns: list[str]) -> None:
        self.seconds, self.columns = seconds, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "t long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        before = self.last.get()
        last = before[0] if before else None
        for r in sorted(rows, key=lambda r: (r["t"], r["event_id"])):
            if last is None or r["t"] - last >= self.seconds:
                last = r["t"]
                yield Row(**{c: r[c] for c in self.columns})
        if before is None or before[0] != last:
            if before:
                self.handle.deleteTimer(1000 * (before[0] + self.seconds))
            self.last.update((last,))
            self.handle.registerTimer(1000 * (last + self.seconds))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def live_dedup(rows: DataFrame, keys: list[str], p: Params = DEFAULT, late: int | None = None) -> DataFrame:
    """Of rows (keys, t, event_id): the first of each key, and those that come the dedup window after the last accepted one. Rows that come late, from before the last accepted one, are repeats.

    late: seconds of event time that rows may lag behind the newest, the dedup window unless given; older ones are dropped. States go by event time, so that a pause changes nothing.
    """
    kept = timed(rows.select(*keys, "t", "event_id"), p.dedup if late is None else late)
    columns = [*keys, "t", "event_id"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.select(*columns).schema)
    return kept.groupBy(*keys).transformWithState(statefulProcessor=Repeats(p.dedup, columns), outputStructType=schema, outputMode="Append", timeMode="EventTime")


FIRED = ["symbol", "t", "ord", "key", "title", "text"]


class Latch(StatefulProcessor):
    """Keeps a symbol's active alerts (alert to time and day on which it was set), and passes on triggers that find theirs inactive. An active state expires `ttl` seconds of candle time after it was set."""

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.active = handle, handle.getMapState("active", "key string", "since long, day long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        before = {k[0]: tuple(v) for k, v in self.active.iterator()}  # a symbol has as many alerts as there are kinds
        now = dict(before)
        for r in sorted(rows, key=lambda r: (r["t"], r["ord"])):
            on = now.pop(r["key"], None)
            if on and (r["t"] - on[0] >= self.ttl or r["daily"] and r["eval_day"] != on[1]):
                on = None
            if r["trigger"]:
                if not on:
                    yield Row(**{c: r[c] for c in FIRED}, ts=r["ts"])
                now[r["key"]] = (on[0] if on else r["t"], r["eval_day"])
        for alert in before.keys() - now.keys():
            self.active.removeKey((alert,))
        for alert, value in now.items():
            if before.get(alert) != value:
                self.active.updateValue((alert,), value)
                self.handle.registerTimer(1000 * (value[0] + self.ttl))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        until = expiredTimerInfo.getExpiryTimeInMs() // 1000 - self.ttl
        for alert, since in [(a, v[0]) for a, v in self.active.iterator()]:
            if since <= until:
                self.active.removeKey(alert)
        return iter(())

    def close(self) -> None:
        pass


def live_latch(rows: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Of a stream of long alerts (as signals.long_alerts gives them, with title, text and ts, which carries the watermark): those that fire, with ts.

    A symbol has one state, from alert to when it was set; an alert that isn't active has none. The state of a daily key is cleared on a new day; an active
    one expires by candle time, so that a replay gives the same alerts. Needs the RocksDB state store.
    """
    return rows.groupBy("symbol").transformWithState(
        statefulProcessor=Latch(p.state_ttl), outputStructType="symbol string, t long, ord int, key string, title string, text string, ts timestamp", outputMode="Append", timeMode="EventTime", eventTimeColumnName="ts"
    )


class Caps(StatefulProcessor):
    """Holds a candle's alerts of all symbols until no more can come, then ranks and counts them."""

    def __init__(self, wait: int, p: Params) -> None:
        self.wait, self.p = wait, p

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.rows = handle, handle.getListState("rows", "symbol string, t long, ord int, key string, title string, text string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        self.rows.appendList([tuple(r[c] for c in FIRED) for r in rows])
        self.handle.registerTimer(1000 * (key[0] + self.wait))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        symbols: dict[str, list[tuple]] = {}
        for r in sorted(map(tuple, self.rows.get()), key=lambda r: (r[0], r[2])):
            symbols.setdefault(r[0], []).append(r)
        self.rows.clear()
        total = 0
        for alerts in symbols.values():
            first = alerts[: self.p.cap_symbol]
            pivots = [r for r in first if r[3].startswith("pivot_")]
            if len(pivots) > self.p.cap_pivots:
                first = [r for r in first if r not in pivots] + pivots[: self.p.cap_pivots]
            total += len(first)
            for rank, r in enumerate(first, 1):
                yield Row(**dict(zip(FIRED, r, strict=True)), rank=rank, total=total, counted=total <= self.p.cap_run)

    def close(self) -> None:
        pass


def live_caps(fired: DataFrame, p: Params = DEFAULT, wait: int = 900) -> DataFrame:
    """Of a stream of alerts that fire (with ts): those within the caps of their symbol and of pivots, with rank; total up to their symbol in their candle, and counted: whether the run's cap still holds.

    A candle's alerts are sent `wait` seconds of event time after its start, when those of all symbols are there. As delivery.cap_symbol, cap_pivots and cap_run.
    """
    schema = "symbol string, t long, ord int, key string, title string, text string, rank int, total long, counted boolean"
    return fired.groupBy("t").transformWithState(statefulProcessor=Caps(wait, p), outputStructType=schema, outputMode="Append", timeMode="EventTime")


class Features(StatefulProcessor):
    """Indicators of a symbol's candles as they come. Its state: the recursions' numbers, a ring of the candles that rolling windows see, and for two widths of candles the last shorter ones.

    Candles wait until the watermark has passed their end, so that shorter ones are there before the longer one that they lie in, in whatever order they come. Their rows' ts is that watermark: rows can't be older.
    Without shorter candles nothing need be waited for, and wait may be false.
    """

    def __init__(self, wanted: list[str], p: Params, short: list[str], width: int, wait: bool = True) -> None:
        """wanted: indicators of the candles (width minutes); short: those of 5-minute candles, of which the last one up to a candle's start is aligned with it; wait: whether candles wait."""
        self.wanted, self.p, self.short, self.width, self.wait = wanted, p, short, width, wait
        self.ring_size = max(p.mmh_period, p.mmh_std)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "width int, t long, open double, high double, low double, close double, volume double")
        self.numbers = handle.getMapState("numbers", "width int", "state array<double>")
        self.ring = handle.getListState("ring", "close double, raw double")
        self.recent = handle.getListState("recent", "t long, rn long, close double, value double")
        self.days = handle.getValueState("days", "day long, high double, low double, close double, before long, before_high double, before_low double, before_close double")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        new = [(r["width"], r["t"], r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in rows]
        if not self.wait:
            return self.advanced(key, sorted(set(new), key=lambda r: r[1]), timerValues.getCurrentWatermarkInMs())
        self.waiting.appendList(new)
        # the newest row waits for later ones; whatever ends a lag before it is due as soon as this micro-batch's watermark holds
        ends = sorted(r[1] + 60 * r[0] for r in new)
        for end in {ends[-1], *[e for e in ends if e <= ends[-1] - self.p.lag][-1:]}:
            self.handle.registerTimer(1000 * end)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        """Timers of one micro-batch come in no order, and the first one does all that is due."""
        due = timerValues.getCurrentWatermarkInMs()
        held = sorted({tuple(r) for r in self.waiting.get()}, key=lambda r: (r[1] + 60 * r[0], r[0], r[1]))
        ready = [r for r in held if 1000 * (r[1] + 60 * r[0]) <= due]
        if not ready:
            return
        self.waiting.put(held[len(ready) :]) if len(ready) < len(held) else self.waiting.clear()
        yield from self.advanced(key, ready, due)

    def advanced(self, key: Any, ready: list[tuple], due: int) -> Iterator[Row]:
        """Rows of the candles in order, and the states after them."""
        steps = {}
        for w, wanted in ((self.width, self.wanted), (5, self.short)):
            before = self.numbers.getValue((w,))[0] if self.numbers.containsKey((w,)) else None
            steps.setdefault(w, Steps(wanted, self.p, before, [tuple(r) for r in self.ring.get()] if w == self.width else []))
        recent = [tuple(r) for r in self.recent.get()] if self.short else []
        day = self.days.get()
        day = list(day) if day else [None] * 8
        for w, t, *candle in ready:
            s = steps[w]
            if s.t is not None and t <= s.t:  # a candle that comes again, or late
                continue
            out = s.step(t, *candle)
            if w != self.width:
                recent.append((t, s.n, candle[3], out[self.short[0]]))
                continue
            found = {}
            if self.short:
                known = [r for r in recent if r[0] <= t]
                recent = [*known[-1:], *[r for r in recent if r[0] > t]]
                known = known or recent[:1]
                found = dict(zip(("rn5", "close5", "rma200"), known[-1][1:], strict=True)) if known else {"rn5": None, "close5": None, "rma200": None}
                today = t // DAY
                if day[0] != today:
                    day = [today, candle[1], candle[2], candle[3], *day[:4]]
                else:
                    day[1:4] = [max(day[1], candle[1]), min(day[2], candle[2]), candle[3]]
                evaluated_on = (t + 60 * w + self.p.lag) // DAY
                past = next((d[1:] for d in (day[:4], day[4:]) if d[0] == evaluated_on - 1), [None] * 3)
                found |= dict(zip(("day_high", "day_low", "day_close"), past, strict=True)) | {"ts": datetime.fromtimestamp(due / 1000, UTC)}
            yield Row(symbol=key[0], t=t, rn=s.n, **dict(zip(("open", "high", "low", "close", "volume"), candle, strict=True)), **out, **found)
        for w, s in steps.items():
            self.numbers.updateValue((w,), (s.numbers(),))
        if steps[self.width].ring:
            self.ring.put(steps[self.width].ring)
        if recent:
            self.recent.put(recent)
        if day[0] is not None:
            self.days.update(tuple(day))

    def close(self) -> None:
        pass


CANDLE = ["open", "high", "low", "close", "volume"]


def live_indicators(bars: DataFrame, wanted: list[str], p: Params = DEFAULT, width: int = 15, wait: bool = True) -> DataFrame:
    """A stream of candles (symbol, t, open, high, low, close, volume) of `width` minutes with rn and indicators, as recursions.recursive gives them once they are warm (see steps.warm_up). NaN stands for what is missing.

    A candle's row comes once the watermark has passed its end; without wait it comes with the candle, the newest ones too, for candles that are closed when they come. However the candles are cut into micro-batches, the values are the same.
    """
    names = [w.replace("'", "_lag") for w in wanted]
    schema = ", ".join(["symbol string, t long, rn long, open double, high double, low double, close double, volume double", *[f"`{n}` double" for n in names]])
    rows = timed(bars.select("symbol", F.lit(width).alias("width"), "t", *CANDLE), p.lag, F.col("t") + 60 * width)
    return rows.groupBy("symbol").transformWithState(statefulProcessor=Features(wanted, p, [], width, wait), outputStructType=schema, outputMode="Append", timeMode="EventTime")


def live_features(bars: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """A stream of 15- and 5-minute candles (symbol, width, t, open, high, low, close, volume) as signals.features gives them: indicators, the aligned 5-minute candle, levels of the day before, gates; and ts, with the watermark.

    The as-of alignment, the recursions and the day's candle are states of one symbol; gates are Columns of the batch.
    """
    names = [w.replace("'", "_lag") for w in signals.FEATURES]
    kinds = [*[f"`{n}` double" for n in names], "rn5 long, close5 double, rma200 double, day_high double, day_low double, day_close double, ts timestamp"]
    schema = ", ".join(["symbol string, t long, rn long, open double, high double, low double, close double, volume double", *kinds])
    rows = timed(bars.select("symbol", "width", "t", *CANDLE), p.lag, F.col("t") + 60 * F.col("width"))
    out = rows.groupBy("symbol").transformWithState(statefulProcessor=Features(signals.FEATURES, p, ["rma_long"], 15), outputStructType=schema, outputMode="Append", timeMode="EventTime", eventTimeColumnName="ts")
    out = out.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in [*names, "rma200"]})
    levels = signals.levels(F.col("day_high"), F.col("day_low"), F.col("day_close"))
    out = out.withColumns({"eval_day": signals.eval_day(p), **{n: F.coalesce(x, F.lit(0.0)) for n, x in levels.items()}}).drop("day_high", "day_low", "day_close")
    return signals.gated(out, p)


def live_alerts(bars: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """From candles (as live_features takes them) to alerts that fire, with ts: indicators, gates, triggers, texts and latch in one query."""
    rows = signals.evaluated(live_features(bars, p), p)
    return live_latch(signals.with_text(signals.long_alerts(rows, p, ["ts"]), p), p)


class KeyValues(StatefulProcessor):
    """A symbol's keys with their values, each until its time to live is over. Passes on what a micro-batch changed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.values = handle, handle.getMapState("values", "state_key string", "value string, written long, ttl long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        last: dict[str, tuple] = {}
        gone = set()
        for r in rows:
            k, new = r["state_key"], (r["written"], r["value"] or "", r["ttl"])
            if r["deleted"]:
                gone.add(k)
            elif k not in last or new > last[k]:
                last[k] = new
        for k in sorted(gone | last.keys()):
            before = self.values.getValue((k,)) if self.values.containsKey((k,)) else None
            if k in gone:
                if before:
                    self.values.removeKey((k,))
                yield Row(symbol=key[0], state_key=k, value=None, written=None)
            elif before is None or (last[k][0], last[k][1]) >= (before[1], before[0]):
                written, value, ttl = last[k]
                self.values.updateValue((k,), (value, written, ttl))
                self.handle.registerTimer(1000 * (written + ttl))
                yield Row(symbol=key[0], state_key=k, value=value, written=written)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs() // 1000
        for k in [k[0] for k, v in self.values.iterator() if v[1] + v[2] <= now]:
            self.values.removeKey((k,))
        return iter(())

    def close(self) -> None:
        pass


def live_state(changes: DataFrame, late: int = 0) -> DataFrame:
    """Of a stream of changes (symbol, state_key, value, written, ttl, deleted): those that count, null where a key was deleted.

    The table is the stream's state, which read_state reads: of a key's values the one written last counts (then the larger), a deleted key goes even if the same micro-batch writes
    it, and one that was not written for its ttl goes once the watermark (of written, `late` seconds behind) has passed. A micro-batch touches the keys that it has, however many there are.
    """
    rows = changes.withColumn("ts", F.timestamp_seconds("written")).withWatermark("ts", f"{late} seconds")
    return rows.groupBy("symbol").transformWithState(statefulProcessor=KeyValues(), outputStructType="symbol string, state_key string, value string, written long", outputMode="Append", timeMode="EventTime")


def read_state(spark: SparkSession, path: str, name: str, operator: int = 0) -> DataFrame:
    """The entries (key, entry, value: structs) of a live operator's map state as of the last micro-batch of the stream that `run` keeps at path."""
    rows = spark.read.format("statestore").option("path", f"{path}/state").option("operatorId", operator).option("stateVarName", name).load()
    return rows.select("key", F.explode("map_value").alias("entry", "value")) if "map_value" in rows.columns else rows.select("key", F.col("user_map_key").alias("entry"), F.col("user_map_value").alias("value"))


def into_table(path: str, t: str = "t") -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch. A batch has its own folder, by day, so that a batch that is run again replaces itself, whatever rows it has then. Nothing of earlier batches is read or listed."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_day", F.floor(F.col(t) / DAY)).repartition("_day").write.mode("overwrite").partitionBy("_day").parquet(f"{path}/_batch={number}")

    return write


def compact(spark: SparkSession, path: str, columns: str, into: str) -> None:
    """Write what the batches at path hold to a table at `into` with a few files a day; for readers, and for a new stream's start."""
    spark.read.schema(columns + ", _batch long, _day long").parquet(path).drop("_batch").repartition("_day").write.partitionBy("_day").parquet(into)


def run(rows: DataFrame, path: str, columns: str, keys: list[str], idle: bool = False, t: str = "t") -> DataFrame:
    """Run the stream over all that is there now, and read what it has written so far. A path's second run goes on after its first.

    columns is the table's schema. keys are columns of which each row is written once, however often it comes: the stream's own state is their index, so that a micro-batch
    costs as much as its rows; none where the operators before send no row twice. idle: whether a micro-batch without rows follows the last one, which closes what
    its watermark allows and lets timers go.

    States lie in as many partitions as tasks can run at once, however many shuffles of batch jobs have: each costs every micro-batch a task with a worker and a
    store to open and to commit for each operator, whatever it holds. A path keeps the number of its first run.
    """
    spark = rows.sparkSession
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(spark.sparkContext.defaultParallelism, 1))
    wanted = {"spark.sql.shuffle.partitions": str(tasks), "spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": str(idle).lower()}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        rows = rows.dropDuplicates(keys) if keys else rows
        rows.writeStream.foreachBatch(into_table(f"{path}/table", t)).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    names = [c.split()[0] for c in columns.split(", ")]
    return spark.read.schema(columns + ", _batch long, _day long").parquet(f"{path}/table").select(*names)


def in_steps(rows: DataFrame, cuts: list[int], path: str, make: Callable[[DataFrame], DataFrame], columns: str, keys: list[str], idle: bool = False, t: str = "t") -> DataFrame:
    """Rows (with t, or another column of that meaning) arrive up to each of the cuts in turn, then the rest, and the stream goes on after each arrival."""
    out = None
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = rows if low is None else rows.where(F.col(t) >= low)
        (part if high is None else part.where(F.col(t) < high)).write.mode("append").parquet(f"{path}/in")
        out = run(make(stream(rows.sparkSession, f"{path}/in")), path, columns, keys, idle, t)
    return out


def scratch(spark: SparkSession) -> str:
    return new_folder(spark, "stream")


def closed_before(t: Column, minutes: int, newest: Column, p: Params = DEFAULT) -> Column:
    """Whether a candle is closed by the watermark that the newest row leaves."""
    return t + minutes * 60 <= newest - p.lag
