"""From triggers to messages: latch, caps, repeats, texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberline.functions.text import grouped_money, ist_time, md_escape
from emberline.operators.panel import day_of, lagged, last_known
from emberline.params import DEFAULT, Params


def latched(rows: DataFrame) -> DataFrame:
    """Of long alerts: the rows that fire. A trigger fires if what happened to its key before, since the day's start for daily keys, was a reset or nothing."""
    day = F.when(F.col("daily"), F.col("eval_day")).otherwise(F.lit(-1).cast("long"))
    keyed = rows.withColumn("_day", day)
    before = lagged(keyed, ["symbol", "key", "_day"], day_of(F.col("t")), ["t"], F.col("trigger"), "_was")
    return before.where(F.col("trigger") & ~F.coalesce("_was", F.lit(False))).drop("_was", "_day")


def latched_with_ttl(rows: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """As latched, with states that expire state_ttl after they were last written.

    A trigger while the key is active writes nothing, so what counts is the last trigger or reset that wrote. Resets end
    an active state for certain: between two of them a key's triggers are independent of the rest, and only the spacing of those matters,
    as in rolling_dedup.
    """
    day = F.when(F.col("daily"), F.col("eval_day")).otherwise(F.lit(-1).cast("long"))
    keyed = rows.withColumn("_day", day)
    resets = F.when(~F.col("trigger"), F.col("t"))
    keyed = last_known(keyed, ["symbol", "key", "_day"], day_of(F.col("t")), ["t"], resets, "_since")
    triggers = keyed.where("trigger").withColumn("_since", F.coalesce("_since", F.lit(-1).cast("long")))
    return rolling_dedup(triggers, ["symbol", "key", "_day", "_since"], p.state_ttl, ["t"]).drop("_day", "_since")


def latest_state(rows: DataFrame) -> DataFrame:
    """The last state of each key: symbol, state key, ACTIVE or INACTIVE, and when it was set."""
    out = rows.groupBy("symbol", "key").agg(F.max_by("trigger", "t").alias("_on"), F.max("t").alias("t"))
    return out.select("symbol", F.concat(F.lit("ALERT:"), F.upper("key")).alias("state_key"), F.when(F.col("_on"), "ACTIVE").otherwise("INACTIVE").alias("state"), "t")


def upsert_state(stored: DataFrame, updates: DataFrame, deletes: DataFrame, now: int) -> DataFrame:
    """The key-value table after a batch: symbol, state_key, value, written, ttl.

    Of a key's stored and new values the one written last counts (then the larger value); writing starts its ttl (seconds) anew. Keys in
    deletes (symbol, state_key) go, even if the batch writes them too, and so does what has expired at the time `now`.
    """
    names = ["symbol", "state_key", "value", "written", "ttl"]
    rows = stored.select(*names).unionByName(updates.select(*names)).groupBy("symbol", "state_key").agg(F.max(F.struct("written", "value", "ttl")).alias("_last"))
    rows = rows.select("symbol", "state_key", "_last.value", "_last.written", "_last.ttl").where(F.col("written") + F.col("ttl") > now)
    return rows.join(deletes.select("symbol", "state_key").distinct(), ["symbol", "state_key"], "left_anti")


def read_state(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """For each wanted key whether its stored JSON says ACTIVE; a missing key and bad JSON say no."""
    out = wanted.join(stored, ["symbol", "state_key"], "left")
    return out.select("symbol", "state_key", F.coalesce(F.get_json_object("value", "$.state") == "ACTIVE", F.lit(False)).alias("active"))


def cap_symbol(fired: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The first alerts of each symbol and candle."""
    w = Window.partitionBy("symbol", "t").orderBy("ord")
    return fired.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= p.cap_symbol).drop("_n")


def cap_pivots(fired: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """With more than three pivot alerts on a candle, the first three, placed after the others. rank is the new place."""
    group = Window.partitionBy("symbol", "t")
    rows = fired.withColumn("_pivot", F.col("key").startswith("pivot_"))
    rows = rows.withColumns({"_many": F.count_if("_pivot").over(group), "_k": F.row_number().over(Window.partitionBy("symbol", "t", "_pivot").orderBy("ord"))})
    rows = rows.where(~F.col("_pivot") | (F.col("_many") <= p.cap_pivots) | (F.col("_k") <= p.cap_pivots))
    last = F.when((F.col("_many") > p.cap_pivots) & F.col("_pivot"), 1).otherwise(0)
    return rows.withColumn("rank", F.row_number().over(group.orderBy(last, "ord"))).drop("_pivot", "_many", "_k")


def cap_run(counts: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """counts: t, symbol, alerts. Adds total up to the symbol by name, and whether it is still counted: from the first that would exceed the cap, none is."""
    w = Window.partitionBy("t").orderBy("symbol")
    return counts.withColumn("total", F.sum("alerts").over(w)).withColumn("counted", F.col("total") <= p.cap_run)


def dedup_bucket(rows: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """The first row of each key in each bucket of time."""
    w = Window.partitionBy(*keys, F.floor(F.col("t") / seconds)).orderBy("t", "event_id")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def rolling_dedup(rows: DataFrame, keys: list[str], seconds: int, order: list[str]) -> DataFrame:
    """Rows that come at least `seconds` after the last accepted row of their key.

    Rows that follow a quiet time of as long start anew whatever came before, so a key's rows are cut there into
    independent runs. A task reads its runs one after the other and holds only the last accepted time.
    """
    rows = lagged(rows, keys, day_of(F.col("t")), order, F.col("t"), "_before")
    starts = F.when(F.col("_before").isNull() | (F.col("t") - F.col("_before") >= seconds), F.col("t"))
    rows = last_known(rows, keys, day_of(F.col("t")), order, starts, "_run").drop("_before")
    names = [*keys, "_run"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, *names).sortWithinPartitions(*names, *order)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, last = None, 0
        for rows in batches:
            keep = []
            for *now, t in zip(*[rows[k].tolist() for k in names], rows["t"].tolist(), strict=True):
                ok = now != run or t - last >= seconds
                run, last = now, t if ok else last
                keep.append(ok)
            yield rows[keep]

    return dealt.mapInPandas(decide, dealt.schema).drop("_run")


def single_message(title: Column, symbol: Column, price: Column, t: Column, text: Column) -> Column:
    parts = F.split(title, " ", 2)
    rest = F.when(F.size(parts) == 2, F.get(parts, F.lit(1))).otherwise(title)
    line = F.when(F.coalesce(text, F.lit("")) != "", F.concat(rest, F.lit(" : "), text)).otherwise(rest)
    return md_escape(F.concat(F.get(parts, F.lit(0)), F.lit(" "), symbol, F.lit(" - $"), grouped_money(price), F.lit("\n"), line, F.lit("\n"), ist_time(t)))


def batched_messages(rows: DataFrame, most: int = 25) -> DataFrame:
    """A message for each symbol and candle: a headline and a bullet for each alert in order (25 at most)."""
    items = F.array_sort(F.collect_list(F.struct("rank", "title", "text")))
    out = rows.where(F.col("rank") <= most).groupBy("symbol", "t", "close").agg(items.alias("_items"), F.count(F.lit(1)).alias("alerts"))
    bullets = F.transform("_items", lambda x, i: F.concat(F.when(i == F.size("_items") - 1, "└➤").otherwise("├➤"), F.lit(" "), x["title"], F.lit(" | "), x["text"]))
    head = F.concat(F.get(F.split(F.col("_items")[0]["title"], " ", 2), F.lit(0)), F.lit(" **"), F.col("symbol"), F.lit("** • $"), grouped_money(F.col("close")), F.lit("  "), ist_time(F.col("t")))
    return out.select("symbol", "t", "alerts", md_escape(F.concat(head, F.lit("\n"), F.array_join(bullets, "\n"))).alias("message"))


def packed(rows: DataFrame, keys: list[str], order: str, most: int = 3996, growth: float = 1.15) -> DataFrame:
    """Messages (column message) of each group packed in order: batch number and text of each batch.

    A message counts its bytes and fifteen in a hundred more, and two for the separator unless it begins the packing or stands after one sent alone;
    one that is too long is cut at a character and sent alone. A group is a channel's messages of one run.
    """

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        done: list[list[str]] = []
        now: list[str] = []
        used = 0
        for text in group["message"]:
            size = int(len(text.encode()) * growth)
            need = size + (2 if now else 0)
            if size > most:
                done += [now] * bool(now)
                now, used = [], 0
                done.append([text.encode()[:most].decode("utf-8", "ignore")])
                continue
            if used + need > most:
                done.append(now)
                now, used = [], 0
            now.append(text)
            used += need
        done += [now] * bool(now)
        return pd.DataFrame({**{k: group[k].iloc[0] for k in keys}, "batch": range(len(done)), "messages": [len(x) for x in done], "text": ["\n\n".join(x) for x in done]})

    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "batch int, messages int, text string"])
    return rows.select(*keys, order, "message").groupBy(*keys).applyInPandas(pack, schema)
