"""Hand-made vectors, and blocks of any size against one piece."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.operators import recursions as R
from emberline.operators.scans import Series, affine, clamped, followed
from emberline.params import Params

NAN = float("nan")


def one(*x):
    """A single series."""
    return Series(np.array([0]), len(x[0])), *[np.array(v, float) for v in x]


YES = np.array([True])


def test_ema_seeds_and_holds():
    s, x = one([NAN, 4.0, NAN, 8.0])
    assert R.ema(s, x, 0.5)[1:].tolist() == [4.0, 4.0, 6.0]
    assert math.isnan(R.ema(s, x, 0.5)[0])


def test_rma_fills_its_warm_up_with_the_seed():
    assert R.rma(*one([1.0, 2.0, 3.0, 9.0]), 3, YES) == pytest.approx([2.0, 2.0, 2.0, 2.0 * 2 / 3 + 3.0])
    assert R.rma(*one([1.0, 2.0]), 3, YES) == pytest.approx([1.0, 1.0 * 2 / 3 + 2.0 / 3])


def test_rsi_counts_the_change_of_its_first_bar_twice():
    out = R.rsi(*one([10.0, 11.0, 10.0, 12.0]), 2, YES)
    assert out[:2].tolist() == [50.0, 50.0]
    gain, loss = (0.5 + 0.0) / 2, (0.5 + 1.0) / 2
    assert out[2] == pytest.approx(100 - 100 / (1 + gain / loss))
    assert R.rsi(*one([1.0, 2.0, 3.0]), 2, YES)[2] == 100.0
    assert R.rsi(*one([1.0, 1.0, 1.0]), 2, YES)[2] == 50.0


def test_range_filter_is_a_clamp():
    x, r = [10.0, 12.0, 11.5, 8.0], [1.0] * 4
    y, want = x[0], [x[0]]
    for v, w in zip(x[1:], r[1:], strict=True):
        y = max(y, v - w) if v > y else min(y, v + w)
        want.append(y)
    s, x, r = one(x, r)
    assert R.range_filter(s, x, r, YES, np.zeros(1))[0].tolist() == want


def test_worm_moves_by_its_deviation_at_most():
    s, x, sd = one([10.0, 15.0, 10.5], [0.0, 2.0, 2.0])
    assert R.worm(s, x, sd, YES, np.zeros(1))[0].tolist() == [10.0, 12.0, 10.5]


def test_values_reset_at_missing_ones():
    out = R.held_value(*one([1.0, 1.0, NAN, 1.0]))
    assert out[1] == pytest.approx(0.75) and out[3] == 0.5
    assert R.half_sum(*one([1.0, NAN, 1.0]))[2] == 1.0


def test_deviation_is_zero_before_it_is_known():
    s, x = one(np.arange(4.0))
    assert s.rolling(x, 3, np.std, 0.0)[:2].tolist() == [0.0, 0.0]


def slow(step, x, start):
    """Row by row."""
    y, out = start, []
    for v in zip(*x, strict=True):
        y = step(y, *v)
        out.append(y)
    return np.array(out)


@pytest.mark.parametrize("sizes", [[1], [700], [3, 1, 900, 257, 256, 5], [2] * 40])
def test_scans_equal_row_by_row(sizes):
    rng = np.random.default_rng(len(sizes))
    n = sum(sizes)
    starts = np.cumsum([0, *sizes[:-1]])
    s = Series(starts, n)
    x, w, into = 100 + np.cumsum(rng.normal(0, 1, n)), rng.uniform(0, 0.8, n), rng.uniform(50, 150, len(sizes))
    holes = np.where(rng.random(n) < 0.1, NAN, x)
    cut = [slice(a, a + k) for a, k in zip(starts, sizes, strict=True)]

    def every(step, *columns, start=into):
        return np.concatenate([slow(step, [c[k] for c in columns], y) for k, y in zip(cut, start, strict=True)])

    zero = np.zeros(len(sizes))
    assert np.allclose(affine(s, w, x), every(lambda y, a, b: a * y + b, w, x, start=zero), rtol=1e-12)
    (got,) = clamped(s, np.ones(n), np.zeros(n), x - w, x + w, into)
    assert np.allclose(got, every(lambda y, v, r: min(max(y, v - r), v + r), x, w), rtol=1e-13)
    for wide in (1.0, 1e-3):  # with narrow steps chunks don't settle
        (got,) = followed(s, x, w * wide, np.full(len(sizes), 0.0), np.full(len(sizes), 300.0), into)
        assert np.allclose(got, every(lambda y, v, d: y + min(max(v - y, -d), d), x, w * wide), rtol=1e-13)
    got = R.kalman(s, holes, 5, 0.01, 0.1)
    for k in cut:
        y, e = NAN, 1.0
        for i in range(k.start, k.stop):
            v = holes[i]
            if v == v:
                y = v if y != y else y
                g = e / (e + 0.05)
                y, e = y + g * (v - y), (1 - g) * e + 0.02
            assert got[i] == pytest.approx(y, nan_ok=True)
    for period in (3, 50):
        for f, of in ((np.minimum, np.min), (np.maximum, np.max)):
            assert np.array_equal(s.extreme(holes, period, f), s.rolling(holes, period, of), equal_nan=True)


def test_long_parameters_have_long_halos():
    assert R.halo_of(Params()) == R.HALO
    assert (1 - 1 / 1000) ** R.halo_of(Params(rma_long=1000)) < 1e-16
    with pytest.raises(ValueError):
        R.recursive(None, ["ppo"], block=10, halo=20)


WANTED = ["ema_trailing", "ppo", "sig", "rsi", "srsi", "rma", "atr_s", "filter_1", "trend", "worm", "mmh", "mmh'1", "vwap"]


@pytest.mark.parametrize(("block", "halo"), [(1500, 1400), (1700, 1200)])
def test_blocks_give_what_one_piece_gives(spark, block, halo):
    rng = np.random.default_rng(3)
    n = 4000
    close = 100 + np.cumsum(rng.normal(0, 0.3, n))
    rows = [("a", 900 * i, i + 1, float(c), float(c + 0.2), float(c - 0.2), float(c + 0.1), 1.0 + i % 7) for i, c in enumerate(close)]
    bars = spark.createDataFrame(rows, "symbol string, t long, rn long, open double, high double, low double, close double, volume double")
    one = R.recursive(bars, WANTED).orderBy("rn").toPandas()
    many = R.recursive(bars, WANTED, block=block, halo=halo).orderBy("rn").toPandas()
    assert len(many) == n
    for c in one.columns[8:]:
        assert np.allclose(one[c], many[c], rtol=0, atol=1e-6, equal_nan=True), c


#: Windows and averages that a short halo holds.
SHORT = Params(cloud=(3, 2, 4, 1), mmh_std=5, mmh_period=6, rma_short=3, rma_long=4)


def test_a_level_that_never_meets(spark):
    rows = [("a", 900 * i, i + 1, 100.0, 100.0, 100.0, 100.0, 1.0) for i in range(300)] + [("b", 900 * i, i + 1, 50.0 + i % 2, 52.0, 49.0, 50.0 + i % 3, 1.0) for i in range(300)]
    bars = spark.createDataFrame(rows, "symbol string, t long, rn long, open double, high double, low double, close double, volume double")
    one = R.recursive(bars, ["worm", "filter_1"], SHORT).orderBy("symbol", "rn").collect()
    many = R.recursive(bars, ["worm", "filter_1"], SHORT, block=64, halo=32).orderBy("symbol", "rn").collect()
    assert [(r["symbol"], r["rn"], round(r["worm"], 9)) for r in one] == [(r["symbol"], r["rn"], round(r["worm"], 9)) for r in many]


def test_short_and_empty_series(spark):
    schema = "symbol string, t long, rn long, open double, high double, low double, close double, volume double"
    bars = spark.createDataFrame([("a", 0, 1, 1.0, 1.0, 1.0, 1.0, 0.0)], schema)
    r = R.recursive(bars, ["ppo", "rsi", "rma", "atr_l", "mmh", "cloud_up", "vwap"]).first()
    assert (r["ppo"], r["rsi"], r["rma"], r["atr_l"], r["mmh"], r["cloud_up"], r["vwap"]) == (0.0, 50.0, 0.0, None, None, 0.0, 1.0)
    assert R.recursive(bars.where(F.lit(False)), ["ppo"]).count() == 0


def test_a_day_longer_than_the_halo(spark):
    rows = [("a", 60 * i, i + 1, 10.0, 11.0, 9.0, 10.0 + i % 5, 1.0 + i % 3) for i in range(3000)]
    bars = spark.createDataFrame(rows, "symbol string, t long, rn long, open double, high double, low double, close double, volume double")
    one = [r["vwap"] for r in R.recursive(bars, ["vwap"]).orderBy("rn").collect()]
    many = [r["vwap"] for r in R.recursive(bars, ["vwap"], block=700, halo=300).orderBy("rn").collect()]
    assert many == pytest.approx(one)


def test_prices_beyond_a_block_s_runs(spark):
    """A level that comes from prices which no block's rows show: the price fell to a hundredth and stays there."""
    rows = [("a", 900 * i, i + 1, *([100.0] * 4 if i < 40 else [1.0] * 4), 1.0) for i in range(400)]
    bars = spark.createDataFrame(rows, "symbol string, t long, rn long, open double, high double, low double, close double, volume double")
    one = [(r["worm"], r["filter_1"]) for r in R.recursive(bars, ["worm", "filter_1"], SHORT).orderBy("rn").collect()]
    many = [(r["worm"], r["filter_1"]) for r in R.recursive(bars, ["worm", "filter_1"], SHORT, block=64, halo=32).orderBy("rn").collect()]
    assert many == [pytest.approx(x, rel=1e-12) for x in one]


SCHEMA = "symbol string, t long, rn long, open double, high double, low double, close double, volume double"


def wild(n, seed):
    """Prices that rise fourfold, stand still for long, jump, and rest for days."""
    rng = np.random.default_rng(seed)
    steps = rng.normal(0.002, 0.01, n) * (rng.random(n) < 0.7) * np.repeat(rng.random(-(-n // 170)) < 0.5, 170)[:n]
    steps[rng.integers(0, n, 4)] += 0.7
    return 50 * np.exp(np.cumsum(steps))


HELD = ["filter_1", "filter_2", "trend", "cloud_up", "worm", "mmh", "mmh'2", "vwap", "vwap'1"]


@pytest.mark.parametrize(("block", "halo", "seed"), [(300, 260, 1), (280, 280, 2), (900, 600, 3)])
def test_states_are_handed_on_exactly(spark, block, halo, seed):
    """Short halos: many blocks do not settle in them, as prices stand still for long or jump."""
    p = SHORT
    rows = [(s, 700 * i, i + 1, *[float(c)] * 4, 1.0 + i % 7) for k, s in enumerate("abc") for i, c in enumerate(wild(1500 - 300 * k, seed + 10 * k))]
    rows += [("d", 700 * i, i + 1, *[100.0] * 4, 1.0) for i in range(900)] + [("e", 0, 1, *[1.0] * 4, 1.0)]
    bars = spark.createDataFrame(rows, SCHEMA)
    one = R.recursive(bars, HELD, p).orderBy("symbol", "rn").toPandas()
    many = R.recursive(bars, HELD, p, block=block, halo=halo).orderBy("symbol", "rn").toPandas()
    assert len(many) == len(one)
    for c in one.columns[8:]:
        assert np.allclose(one[c], many[c], rtol=1e-9, atol=1e-7, equal_nan=True), c


def test_prices_that_rise_fourfold_need_no_second_run(spark, monkeypatch):
    from emberline.operators import handover

    left = []
    real = handover.unsettled
    monkeypatch.setattr(handover, "unsettled", lambda *a: left.append(real(*a).count()) or real(*a))
    n = 20_000
    rng = np.random.default_rng(8)
    close = 100 * np.exp(np.linspace(0, np.log(4), n) + np.cumsum(rng.normal(0, 1e-4, n)))
    bars = spark.createDataFrame([("a", 60 * i, i + 1, float(c), float(c * 1.001), float(c * 0.999), float(c), 1.0) for i, c in enumerate(close)], SCHEMA)
    for wanted in (["ema"], ["worm"], ["mmh", "trend"]):
        one = R.recursive(bars, wanted).orderBy("rn").toPandas()
        many = R.recursive(bars, wanted, block=4096, halo=3500).orderBy("rn").toPandas()
        for c in one.columns[8:]:
            assert np.allclose(one[c], many[c], rtol=1e-9, atol=1e-7, equal_nan=True), c
    assert left == [0, 0]  # none for the average, which needs no states


def test_the_map_of_a_follower():
    from emberline.operators import handover

    rng = np.random.default_rng(2)
    for k in range(60):
        x, step = rng.normal(0, 3, 40), rng.uniform(0, 0.3, 40) * (rng.random(40) < 0.8)
        way = handover.follow(x, step, -9.0, 9.0)
        for y in rng.uniform(-9, 9, 20):
            z = y
            for v, w in zip(x, step, strict=True):
                z += min(max(v - z, -w), w)
            assert handover.through(way, y, True) == pytest.approx(z, abs=1e-9), k


@pytest.mark.parametrize("gone", [(), (150,), (0, 1, 2), (3, 4, 20, 21, 22, 140, 299), tuple(range(0, 300, 3)), tuple(range(290))])
def test_rsi_with_missing_closes_row_by_row(gone):
    rng = np.random.default_rng(6)
    close = 100 + np.cumsum(rng.normal(0, 1, 300))
    close[list(gone)] = NAN
    period, n = 21, 300
    known = [i for i in range(n) if close[i] == close[i]]
    change, want = {}, [50.0] * n
    for a, b in zip(known, known[1:], strict=False):
        change[b] = close[b] - close[a]
    first = known[0]
    up, down = (sum(max(s * change.get(i, 0.0), 0.0) for i in range(first + 1, min(first + period + 1, n))) / period for s in (1, -1))
    for i in range(first + period, n):
        if close[i] == close[i]:
            up, down = (max(s * change[i], 0.0) / period + avg * (1 - 1 / period) for s, avg in ((1, up), (-1, down)))
        want[i] = (100.0 if up > 0 else 50.0) if down == 0 else 100 - 100 / (1 + up / down)
    assert R.rsi(*one(close), period, YES) == pytest.approx(want, abs=1e-9)
