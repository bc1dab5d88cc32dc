"""Boundary rows of checks, joins, caps and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.functions import text as tx
from emberline.operators import delivery, panel, signals, validation
from emberline.params import Params
from emberline.sources import candles

BAR = "symbol string, t long, open double, high double, low double, close double, volume double"


def test_reasons_come_in_order(spark):
    bars = [
        ("a", 0, 100.0, 100.0, 100.0, 100.0, 1.0),
        ("a", 900, 100.0, 150.0, 100.0, 150.0, 1.0),  # exactly half up
        ("a", 1800, 150.0, 226.0, 150.0, 225.1, 1.0),
        ("a", 2700, 225.0, 220.0, 230.0, 225.0, 1.0),
        ("a", 3600, None, 1.0, 1.0, 1.0, 1.0),
        ("a", 4500, 1.0, float("inf"), 1.0, 1.0, 1.0),
        ("a", 5400, 0.0, 1.0, 0.0, 1.0, 1.0),
    ]
    got = [r["reason"] for r in validation.with_reason(spark.createDataFrame(bars, BAR), 15).orderBy("t").collect()]
    assert got == [None, None, "price gap: 50.07%", "invalid relationships: O≤H, L≤O, L≤C, C≤H, L≤H".replace("O≤H, L≤O", "L≤O, O≤H"), "missing value", "infinite value", "non-positive price"]
    late = validation.with_reason(spark.createDataFrame(bars[:1], BAR), 15, reference=F.lit(1201)).first()["reason"]
    assert late == "stale: 1201s"
    assert validation.with_reason(spark.createDataFrame(bars[:1], BAR), 15, reference=F.lit(899)).first()["reason"] == "still forming"


def test_series_and_rows_are_rejected(spark):
    bars = spark.createDataFrame([("a", 0, 1.0, 2.0, 1.0, 1.5, 1.0), ("a", 900, 1.0, 0.5, 1.0, 1.5, 1.0), ("b", 0, 1.0, 2.0, 1.0, 1.5, 1.0)], BAR)
    assert validation.reject(bars, ["symbol"]).count() == 1
    assert validation.reject(bars, ["symbol"], "row").count() == 2


def test_payloads_of_unequal_arrays_give_nothing(spark):
    rows = [("a", '{"result": {"t": [1700000000000, 2], "o": [1, 2], "h": [1, 2], "l": [1, 2], "c": [1, 2], "v": [1, 2]}}'), ("b", '{"result": {"t": [1], "o": [], "h": [1], "l": [1], "c": [1], "v": [1]}}'), ("c", '{"result": {"t": [1]}}'), ("d", "broken")]
    got = candles.parse(spark.createDataFrame(rows, "symbol string, payload string")).orderBy("t").collect()
    assert [(r["symbol"], r["t"]) for r in got] == [("a", 2), ("a", 1_700_000_000)]


def test_asof_takes_the_first_row_before_all(spark):
    left = spark.createDataFrame([("a", 10), ("a", 100), ("a", 200_000)], "symbol string, t long")
    right = spark.createDataFrame([("a", 50, 1.0), ("a", 100, 2.0)], "symbol string, t long, x double")
    assert [r["x"] for r in signals.asof(left, right, ["x"]).orderBy("t").collect()] == [1.0, 2.0, 2.0]
    assert [r["x"] for r in signals.asof(left, right, ["x"], first=False).orderBy("t").collect()] == [None, 2.0, 2.0]


def test_asof_keeps_repeated_rows_and_columns(spark):
    left = spark.createDataFrame([("a", 100, 1.5)] * 2 + [("b", 5, None)], "symbol string, t long, y double")
    right = spark.createDataFrame([("a", 50, 1.0), ("a", 90, None)], "symbol string, t long, x double")
    got = signals.asof(left, right, ["x"])
    assert got.columns == ["symbol", "t", "y", "x"]
    assert sorted(map(tuple, got.collect())) == [("a", 100, 1.5, None)] * 2 + [("b", 5, None, None)]


def test_switches_turn_alerts_off(spark):
    keys = lambda p: {a.key: a for a in signals.alerts(p)}
    row = spark.range(1).selectExpr("100.0 as close", "99.0 as close_lag1", "99.5 as vwap", "99.4 as vwap_lag1", "true as buy", "false as sell")
    for on in (True, False):
        assert row.select(keys(Params(vwap_on=on))["vwap_up"].enabled.alias("e")).first()["e"] == on
        assert row.select(keys(Params(pivot_on=on))["pivot_up_P"].enabled.alias("e")).first()["e"] == on


def test_states_are_upserted_expire_and_go(spark):
    schema = "symbol string, state_key string, value string, written long, ttl int"
    state = lambda *rows: spark.createDataFrame(list(rows), schema)
    stored = state(("a", "k", "1", 10, 100), ("a", "old", "x", 0, 50), ("b", "k", "y", 20, 100))
    updates = state(("a", "k", "2", 30, 100), ("a", "k", "3", 25, 100), ("c", "new", "z", 40, 5))
    got = delivery.upsert_state(stored, updates, state(("b", "k", "", 0, 0)), 50)
    assert [tuple(r) for r in got.collect()] == [("a", "k", "2", 30, 100)]


def test_pivots_of_a_flat_day_are_zero(spark):
    rows = signals.pivots(spark.createDataFrame([("a", 0, 5.0, 5.0, 5.0, 5.0, 1.0), ("b", 0, 1.0, 9.0, 1.0, 2.0, 1.0)], BAR)).orderBy("symbol").collect()
    assert rows[0]["P"] == 0.0 and rows[0]["day"] == 1
    assert rows[1]["P"] == 4.0 and rows[1]["S3"] == 0.0 and rows[1]["R3"] == 12.0


def test_lag_and_last_known_cross_buckets(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, None), ("a", 100_000, None), ("a", 100_001, 4)], "symbol string, t long, x int")
    bucket = panel.day_of(F.col("t"))
    assert [r["y"] for r in panel.lagged(df, ["symbol"], bucket, ["t"], F.col("x"), "y").orderBy("t").collect()] == [None, 1, None, None]
    assert [r["y"] for r in panel.last_known(df, ["symbol"], bucket, ["t"], F.col("x"), "y").orderBy("t").collect()] == [1, 1, 1, 4]
    assert [r["rn"] for r in panel.numbered(df).orderBy("t").collect()] == [1, 2, 3, 4]


def fired(spark, keys):
    return spark.createDataFrame([("a", 0, i, k, 1.0) for i, k in enumerate(keys)], "symbol string, t long, ord int, key string, close double")


def test_caps(spark):
    nine = fired(spark, [f"k{i}" for i in range(9)])
    assert delivery.cap_symbol(nine).count() == 8
    four = delivery.cap_pivots(fired(spark, ["pivot_up_P", "pivot_up_S1", "x", "pivot_up_S2", "pivot_up_R1"])).orderBy("rank").collect()
    assert [r["key"] for r in four] == ["x", "pivot_up_P", "pivot_up_S1", "pivot_up_S2"]
    counts = spark.createDataFrame([(0, "a", 30), (0, "b", 21), (0, "c", 1)], "t long, symbol string, alerts long")
    assert [r["counted"] for r in delivery.cap_run(counts).orderBy("symbol").collect()] == [True, False, False]


def test_rolling_repeats(spark):
    rows = spark.createDataFrame([("a", t) for t in (0, 299, 300, 598, 601, 5000)], "key string, t long")
    got = delivery.rolling_dedup(rows, ["key"], 300, ["t"]).orderBy("t").collect()
    assert [r["t"] for r in got] == [0, 300, 601, 5000]


def test_states_expire(spark):
    rows = [("a", t, 0, 1.0, 0, "k", "T x", trigger, not trigger, "", False) for t, trigger in ((0, True), (900, True), (40 * 86400, True), (40 * 86400 + 900, False), (40 * 86400 + 1800, True))]
    df = spark.createDataFrame(rows, "symbol string, t long, eval_day long, close double, ord int, key string, title string, trigger boolean, reset boolean, text string, daily boolean")
    assert [r["t"] for r in delivery.latched(df).orderBy("t").collect()] == [0, 40 * 86400 + 1800]
    assert [r["t"] for r in delivery.latched_with_ttl(df).orderBy("t").collect()] == [0, 40 * 86400, 40 * 86400 + 1800]


def test_packing(spark):
    rows = spark.createDataFrame([("g", i, m) for i, m in enumerate(["a" * 1700, "b" * 1700, "c" * 100, "é" * 3000, "d"])], "g string, i int, message string")
    got = delivery.packed(rows, ["g"], "i").orderBy("batch").collect()
    assert [r["messages"] for r in got] == [2, 1, 1, 1]
    assert len(got[2]["text"].encode()) == 3996


def test_texts(spark):
    row = spark.range(1).select(
        tx.md_escape(F.lit("a_b 1,2<3 x")).alias("e"),
        tx.ist_time(F.lit(1_700_000_000_000)).alias("t"),
        tx.redact(F.lit("123456:AAAAAAAAAABBBBBBBBBBcc chat_id=7 redis://u:p@h")).alias("r"),
        tx.safe_double(F.lit("x"), 2.0).alias("d"),
        tx.clamp(F.lit(1e9), 1e8).alias("c"),
        tx.grouped_money(F.lit(1234.5)).alias("m"),
    ).first()
    assert row["e"] == r"a\_b \1\,\2\<\3 x"
    assert row["t"] == "15-11-2023 03:43 IST"
    assert row["r"] == "[REDACTED_TOKEN] chat_id=[REDACTED] redis://[REDACTED]h"
    assert (row["d"], row["c"], row["m"]) == (2.0, 1e8, "1,234.50")


def test_there_are_24_alerts_in_order(spark):
    keys = [a.key for a in signals.alerts()]
    assert len(keys) == len(set(keys)) == 24
    assert keys[:2] == ["ppo_signal_up", "ppo_signal_down"] and keys[-1] == "pivot_down_R3"


def test_parameters_are_checked():
    import pytest

    with pytest.raises(ValueError):
        Params(ppo_fast=20)
