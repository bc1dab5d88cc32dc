"""Streams give the same however their rows are cut into micro-batches."""

from __future__ import annotations

import time

import numpy as np
import pytest

from emberline.operators import recursions
from emberline.params import Params
from emberline.streaming import live


@pytest.mark.parametrize("cuts", [[], [4000, 9000], [900, 4000, 7500, 9000, 12000]])
def test_repeats(spark, cuts):
    day = 86_400  # no row is as early as the watermark at the beginning, the epoch
    rows = spark.createDataFrame([("a", day + 3600 * i // 4, i) for i in range(20)] + [("b", day + t, 100 + i) for i, t in enumerate((0, 0, 599, 600, 1199, 1200, 9000))], "k string, t long, event_id long")
    got = live.in_steps(rows, [day + c for c in cuts], live.scratch(spark), lambda r: live.live_dedup(r, ["k"]), "k string, t long, event_id long", ["event_id"])
    assert sorted(r["event_id"] for r in got.collect()) == [*range(20), 100, 103, 105, 106]


def test_indicators_of_any_cut_are_those_of_one_piece(spark):
    rng = np.random.default_rng(5)
    n, p = 900, Params(rma_long=60)
    close = 100 + np.cumsum(rng.normal(0, 0.3, n))
    rows = spark.createDataFrame([("a", 900 * i, i + 1, float(c), float(c + 0.2), float(c - 0.2), float(c + 0.1), 1.0 + i % 7) for i, c in enumerate(close)], "symbol string, t long, rn long, open double, high double, low double, close double, volume double")
    wanted = ["ppo", "sig", "srsi", "atr_l", "filter_1", "trend", "worm", "mmh", "mmh'2", "vwap"]
    want = recursions.recursive(rows, wanted, p).orderBy("t").toPandas()
    kinds = ", ".join(["symbol string, t long, rn long", *[f"{w.replace(chr(39), '_lag')} double" for w in wanted]])
    got = live.in_steps(rows, [900 * 10, 900 * 400, 900 * 401], live.scratch(spark), lambda r: live.live_indicators(r, wanted, p), kinds, [], idle=True).orderBy("t").toPandas()
    assert len(got) == n - 1  # the newest candle waits
    want = want[: n - 1]
    for c in got.columns[3:]:
        known = got["rn"] >= live.warm_up(p).get(c, 0)
        assert np.allclose(got[c][known].astype(float), want[c][known].astype(float), rtol=0, atol=1e-9, equal_nan=True), c


def test_the_newest_candles_count_too(spark):
    """As many rows as candles, also of a symbol whose last candle is the newest of all."""
    rows = spark.createDataFrame([(s, 900 * i, 1.0, 2.0, 1.0, 1.0 + i % 3, 1.0) for s, n in (("a", 40), ("b", 37)) for i in range(n)] + [("a", 900 * 9, 1.0, 2.0, 1.0, 1.0, 1.0)], "symbol string, t long, open double, high double, low double, close double, volume double")
    got = live.in_steps(rows, [900 * 10, 900 * 39], live.scratch(spark), lambda r: live.live_indicators(r, ["ppo", "vwap"], wait=False), "symbol string, t long, rn long, vwap double", [])
    assert sorted((r["symbol"], r["t"], r["rn"]) for r in got.collect()) == [(s, 900 * i, i + 1) for s, n in (("a", 40), ("b", 37)) for i in range(n)]


def test_the_query_of_live_indicators_has_all_candles(spark):
    from emberline.plans import catalog

    got = catalog.QUERIES["stream_features"](spark, "/root/testdata/sf0.001")
    assert got.count() == catalog.QUERIES["bars_15m"](spark, "/root/testdata/sf0.001").count()


def test_steps_of_one_candle_are_the_recursions():
    from emberline.streaming.steps import Steps

    rng = np.random.default_rng(1)
    n, p = 700, Params(rma_long=60)
    close = 50 * np.exp(np.cumsum(rng.normal(0, 0.01, n) * (rng.random(n) < 0.8)))
    columns = {"t": np.arange(n) * 900, "rn": np.arange(n) + 1, "open": close, "high": close * 1.01, "low": close * 0.99, "close": close, "volume": rng.uniform(0, 2, n), "halo": np.zeros(n, bool)}
    wanted = ["ema", "ppo", "sig", "rsi", "srsi", "kalman", "rma", "rma_long", "tr", "atr_s", "atr_l", "range_1", "filter_1", "filter_2", "trend", "cloud_down", "std", "worm", "mmh_raw", "mmh_value", "mmh_momentum", "mmh", "vwap"]
    whole = recursions.Blocks(columns, np.array([0]), p)
    state, ring, rows = None, [], []
    for i in range(n):  # the state goes out and in at each candle
        s = Steps([*wanted, "mmh'3"], p, state, ring)
        rows.append(s.step(*(columns[k][i].item() for k in ("t", "open", "high", "low", "close", "volume"))))
        state, ring = s.numbers(), s.ring
    assert len(ring) == 144
    for name in wanted:
        known = columns["rn"] >= live.warm_up(p).get(name, 0)
        assert np.allclose(np.array([r[name] for r in rows])[known], whole[name][known], rtol=1e-9, atol=1e-9, equal_nan=True), name
    assert [r["mmh_lag3"] for r in rows[3:]] == pytest.approx([r["mmh"] for r in rows[:-3]], nan_ok=True)


def test_repeats_after_a_pause(spark):
    """Runs that lie far apart on the clock, and events that lie a second apart."""
    rows = spark.createDataFrame([("a", 100, 1), ("a", 101, 2), ("a", 103, 3)], "k string, t long, event_id long")
    folder = live.scratch(spark)
    out = None
    for e in (1, 2, 3):
        rows.where(f"event_id = {e}").write.mode("append").parquet(f"{folder}/in")
        out = live.run(live.live_dedup(live.stream(spark, f"{folder}/in"), ["k"], Params(dedup=2)), folder, "k string, t long, event_id long", [], idle=True)
        time.sleep(2.5)
    assert sorted(r["event_id"] for r in out.collect()) == [1, 3]


def test_states_go_when_their_time_is_over(spark):
    folder = live.scratch(spark)
    kind = "symbol string, state_key string, value string, written long, ttl long, deleted boolean"
    out = "symbol string, state_key string, value string, written long"
    for rows in ([("s", "a", "1", 100, 50, False), ("s", "b", "1", 100, 500, False), ("s", "a", "0", 90, 50, False)], [("s", "c", "x", 200, 900, False), ("s", "c", None, 200, 0, True), ("s", "b", "2", 210, 500, False)], [("r", "b", "9", 400, 500, False)]):
        spark.createDataFrame(rows, kind).write.mode("append").parquet(f"{folder}/in")
        live.run(live.live_state(live.stream(spark, f"{folder}/in")), folder, out, [], idle=True, t="written")
    held = live.read_state(spark, folder, "values").select("key.symbol", "entry.state_key", "value.value").collect()
    assert sorted(map(tuple, held)) == [("r", "b", "9"), ("s", "b", "2")]


def test_caps_wait_for_all_symbols(spark):
    p = Params(cap_symbol=3, cap_pivots=1, cap_run=4)
    rows = [(s, 900, o, k, "title", "text") for s in "ab" for o, k in enumerate(["pivot_up_P", "pivot_up_S1", "x", "y"])] + [("c", 1800, 0, "x", "title", "text"), ("c", 90_000, 0, "z", "title", "text")]
    kinds = "symbol string, t long, ord int, key string, title string, text string, rank int, total long, counted boolean"
    given = spark.createDataFrame(rows, "symbol string, t long, ord int, key string, title string, text string")
    out = live.in_steps(given, [1000], live.scratch(spark), lambda r: live.live_caps(live.timed(r, 0), p), kinds, [], idle=True)
    want = [("a", 900, "x", 1, 2, True), ("a", 900, "pivot_up_P", 2, 2, True), ("b", 900, "x", 1, 4, True), ("b", 900, "pivot_up_P", 2, 4, True), ("c", 1800, "x", 1, 1, True)]
    assert sorted(map(tuple, out.select("symbol", "t", "key", "rank", "total", "counted").collect())) == sorted(want)


def test_the_sink_writes_a_key_once(spark):
    folder = live.scratch(spark)
    rows = lambda *x: spark.createDataFrame(list(x), "k string, t long")
    for part in (rows(("a", 0), ("a", 0), ("b", 90_000)), rows(("a", 0), ("c", 5))):
        part.write.mode("append").parquet(f"{folder}/in")
        out = live.run(live.stream(spark, f"{folder}/in"), folder, "k string, t long", ["k", "t"])
    assert sorted(map(tuple, out.collect())) == [("a", 0), ("b", 90_000), ("c", 5)]


def test_a_batch_that_is_run_again_replaces_itself(spark, tmp_path):
    write = live.into_table(str(tmp_path / "t"))
    rows = lambda *x: spark.createDataFrame(list(x), "k string, t long")
    write(rows(("a", 0), ("b", 90_000)), 0)
    write(rows(("x", 0), ("c", 5)), 1)
    write(rows(("d", 7)), 1)
    live.compact(spark, str(tmp_path / "t"), "k string, t long", str(tmp_path / "u"))
    for folder in "tu":
        assert sorted(map(tuple, spark.read.parquet(str(tmp_path / folder)).select("k", "t").collect())) == [("a", 0), ("b", 90_000), ("d", 7)]


def test_states_lie_in_no_more_partitions_than_tasks_run_at_once(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        folder = live.scratch(spark)
        rows = spark.createDataFrame([("a", 86_400, 1), ("b", 86_500, 2), ("a", 86_401, 3)], "k string, t long, event_id long")
        got = live.in_steps(rows, [86_401], folder, lambda r: live.live_dedup(r, ["k"]), "k string, t long, event_id long", [])
        assert sorted(r["event_id"] for r in got.collect()) == [1, 2]
        assert spark.conf.get("spark.sql.shuffle.partitions") == "37"
        held = spark.read.format("state-metadata").load(f"{folder}/state").first()
        assert held["numPartitions"] == min(37, spark.sparkContext.defaultParallelism)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
