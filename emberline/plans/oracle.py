"""DuckDB SQL of the same definitions, as named common table expressions."""

from __future__ import annotations

from emberline.operators.signals import DOWN_LEVELS, LEVELS, RATIOS, UP_LEVELS
from emberline.params import DEFAULT

P = DEFAULT
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, body: str, *needs: str) -> None:
    VIEWS[name] = (needs, body)


def sql(body: str, *needs: str) -> str:
    """body after the common table expressions that it needs."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for n in VIEWS[name][0]:
                add(n)
            order.append(name)

    for n in needs:
        add(n)
    return "with recursive " + ",\n".join(f"{n} as ({VIEWS[n][1]})" for n in order) + "\n" + body


view("ev", "select event_id, ts, floor(epoch(ts))::bigint as t, user_id, event_type as symbol, value, props from events")
view(
    "ticks",
    """select symbol, event_id, ts, t, cents, (10000000 + s)::double / 1000 as px, (10000000 + s - (cents - 5000))::double / 1000 as px_before
    from (select *, sum(cents - 5000) over (partition by symbol order by ts, event_id rows unbounded preceding)::bigint as s from (select *, round(value * 100)::bigint as cents from ev))""",
    "ev",
)
for name, m in (("b5", 5), ("b15", 15), ("b1d", 1440)):
    view(
        name,
        f"""select *, row_number() over (partition by symbol order by t) as rn, count(*) over (partition by symbol) as n from (
        select symbol, t // {m * 60} * {m * 60} as t, arg_min(px_before, (ts, event_id)) as open, max(greatest(px_before, px)) as high, min(least(px_before, px)) as low, arg_max(px, (ts, event_id)) as close, sum(cents)::double / 100 as volume
        from ticks group by 1, 2)""",
        "ticks",
    )
view("vb15", "select symbol, t // 900 * 900 as t, arg_min(value, (ts, event_id)) as open, max(value) as high, min(value) as low, arg_max(value, (ts, event_id)) as close, count(*)::double as volume from ev group by 1, 2", "ev")


def recursion(name: str, source: str, first: str, step: str, *more: str) -> None:
    """y by row number: first from row s, then step from row s and the value before, r.y."""
    view(name, f"select s.symbol, s.rn, ({first})::double as y from {source} s where s.rn = 1 union all select s.symbol, s.rn, ({step})::double from {source} s join {name} r on s.symbol = r.symbol and s.rn = r.rn + 1", source, *more)


def ema(name: str, source: str, x: str, period: float) -> None:
    a = 2 / (period + 1)
    recursion(name, source, f"s.{x}", f"{a!r} * s.{x} + {1 - a!r} * r.y")


def rma(name: str, source: str, x: str, period: int) -> None:
    """source needs n; the seed is the mean of the first values, also for all of these."""
    view(f"{name}_s", f"select symbol, rn, n, {x} as x, avg(case when rn <= {period} then {x} end) over (partition by symbol) as seed from {source}", source)
    a = 1 / period
    recursion(name, f"{name}_s", f"case when s.n < {period} then s.x else s.seed end", f"case when s.n >= {period} and s.rn <= {period} then s.seed else {a!r} * s.x + {1 - a!r} * r.y end")


ema("fast", "b15", "close", P.ppo_fast)
ema("slow", "b15", "close", P.ppo_slow)
view("ppo", f"select f.symbol, f.rn, case when b.n < {max(P.ppo_fast, P.ppo_slow)} then 0 when s.y <> 0 then (f.y - s.y) / s.y * 100 else 0 end as x from fast f join slow s using (symbol, rn) join b15 b using (symbol, rn)", "fast", "slow", "b15")
ema("sig", "ppo", "x", P.ppo_signal)
view(
    "gl",
    f"""select symbol, rn, n, gain, loss, sum(case when rn between 2 and {P.rsi_len + 1} then gain end) over (partition by symbol) / {P.rsi_len} as g0, sum(case when rn between 2 and {P.rsi_len + 1} then loss end) over (partition by symbol) / {P.rsi_len} as l0
    from (select symbol, rn, n, greatest(close - lag(close) over w, 0) as gain, greatest(lag(close) over w - close, 0) as loss from b15 window w as (partition by symbol order by rn))""",
    "b15",
)
for side, col in (("gain", "g0"), ("loss", "l0")):
    a = 1 / P.rsi_len
    recursion(f"avg_{side}", "gl", f"s.{col}", f"case when s.rn <= {P.rsi_len} then s.{col} else s.{side} * {a!r} + r.y * {1 - a!r} end")
view("rsi", f"select g.symbol, g.rn, case when b.n <= {P.rsi_len} or g.rn <= {P.rsi_len} then 50 when l.y = 0 then case when g.y > 0 then 100 else 50 end else 100 - 100 / (1 + g.y / l.y) end::double as x from avg_gain g join avg_loss l using (symbol, rn) join b15 b using (symbol, rn)", "avg_gain", "avg_loss", "b15")


def kalman(name: str, source: str, x: str) -> None:
    noise, drift = P.kalman_r * P.kalman_len, P.kalman_q / P.kalman_len
    view(
        name,
        f"""select symbol, rn, {x}::double as y, (1 - 1 / (1 + {noise!r})) * 1 + {drift!r} as e from {source} where rn = 1
        union all select s.symbol, s.rn, r.y + r.e / (r.e + {noise!r}) * (s.{x} - r.y), (1 - r.e / (r.e + {noise!r})) * r.e + {drift!r} from {source} s join {name} r on s.symbol = r.symbol and s.rn = r.rn + 1""",
        source,
    )


kalman("kal_close", "b15", "close")
kalman("kal_rsi", "rsi", "x")
ema("srsi_e", "kal_rsi", "y", P.srsi_ema)
view("srsi", f"select e.symbol, e.rn, case when b.n < {P.rsi_len + P.kalman_len} then 50 else e.y end as x from srsi_e e join b15 b using (symbol, rn)", "srsi_e", "b15")
view("tr", "select symbol, rn, n, case when rn = 1 then high - low else greatest(high - low, abs(high - c1), abs(low - c1)) end as x from (select *, lag(close) over (partition by symbol order by rn) as c1 from b15)", "b15")
rma("atr_s", "tr", "x", P.atr_short)
rma("atr_l", "tr", "x", P.atr_long)
rma("rma50", "b15", "close", P.rma_short)
rma("rma200", "b5", "close", P.rma_long)
view("dc", "select symbol, rn, n, close, coalesce(abs(close - lag(close) over (partition by symbol order by rn)), 0) as d from b15", "b15")
for k, (t, f) in enumerate(((P.cloud[0], P.cloud[1]), (P.cloud[2], P.cloud[3])), 1):
    ema(f"av{k}", "dc", "d", t)
    ema(f"sr{k}_", f"av{k}", "y", 2 * t - 1)
    view(f"sr{k}", f"select s.symbol, s.rn, s.y * {f} as r, b.close as x from sr{k}_ s join b15 b using (symbol, rn)", f"sr{k}_", "b15")
    recursion(f"rf{k}", f"sr{k}", "s.x", "least(greatest(r.y, s.x - s.r), s.x + s.r)")
view("trend", "select symbol, rn, coalesce(last_value(case when a.y < b.y then 1 when a.y > b.y then 0 end ignore nulls) over (partition by symbol order by rn rows unbounded preceding), 1) as up from rf1 a join rf2 b using (symbol, rn)", "rf1", "rf2")
view("cloud", f"select symbol, rn, case when n < {max(P.cloud[0], P.cloud[2])} then 0 else up end as up, case when n < {max(P.cloud[0], P.cloud[2])} then 0 else 1 - up end as down from trend join b15 using (symbol, rn)", "trend", "b15")
view("sd", f"select symbol, rn, close as x, case when rn >= {P.mmh_std} then stddev_pop(close) over (partition by symbol order by rn rows {P.mmh_std - 1} preceding) * {P.mmh_response} else 0 end as s, case when rn >= {P.mmh_period} then avg(close) over (partition by symbol order by rn rows {P.mmh_period - 1} preceding) end as ma from b15", "b15")
recursion("worm", "sd", "s.x", "r.y + case when abs(s.x - r.y) > s.s then sign(s.x - r.y) * s.s else s.x - r.y end")
view("mraw", "select symbol, rn, case when abs(w.y) >= 1e-10 then (w.y - sd.ma) / w.y end as raw from worm w join sd using (symbol, rn)", "worm", "sd")
view(
    "mt",
    f"""select symbol, rn, raw, case when k = {P.mmh_period} and abs(hi - lo) >= 1e-10 then (raw - lo) / (hi - lo) end as x from (
    select *, count(raw) over w as k, min(raw) over w as lo, max(raw) over w as hi from mraw window w as (partition by symbol order by rn rows {P.mmh_period - 1} preceding))""",
    "mraw",
)
recursion("mval", "mt", "case when s.x is not null then greatest(least(s.x - 0.5, 0.9999), -0.9999) end", "case when s.x is not null then greatest(least(s.x - 0.5 + 0.5 * coalesce(r.y, 0), 0.9999), -0.9999) end")
view("mmom", "select symbol, rn, case when y is not null then 0.25 * ln((1 + y) / (1 - y)) end as x from mval", "mval")
recursion("mmh", "mmom", "s.x", "s.x + 0.5 * coalesce(r.y, 0)")
view(
    "vwap",
    """select symbol, rn, t, case when v <> 0 then pv / v else price end as x from (
    select symbol, rn, t, (high + low + close) / 3 as price, sum((high + low + close) / 3 * volume) over w as pv, sum(volume) over w as v from b15 window w as (partition by symbol, t // 86400 order by t rows unbounded preceding))""",
    "b15",
)
_rng = "(high - low)"
_levels = {"P": "(high + low + close) / 3"} | {f"R{k}": f"(high + low + close) / 3 + {_rng} * {r}" for k, r in RATIOS.items()} | {f"S{k}": f"(high + low + close) / 3 - {_rng} * {r}" for k, r in RATIOS.items()}
view("piv", "select symbol, t // 86400 + 1 as day, " + ", ".join(f"case when {_rng} >= 1e-8 and {_levels[n]} > 0 then {_levels[n]} else 0 end as {n}" for n in LEVELS) + " from b1d", "b1d")
view("r5", f"select symbol, b.rn as rn5, t, close as close5, case when b.n < {P.rma_long} then 0 else y end as rma200v from b5 b join rma200 using (symbol, rn)", "b5", "rma200")
view(
    "al",
    "select b.symbol, b.t, coalesce(r.close5, f.close5) as close5, coalesce(r.rma200v, f.rma200v) as rma200v, coalesce(r.rn5, f.rn5) as rn5 from b15 b asof left join r5 r on b.symbol = r.symbol and b.t >= r.t left join (select * from r5 where rn5 = 1) f on b.symbol = f.symbol",
    "b15", "r5",
)
_L = {"ppo": "p.x", "sig": "sg.y", "srsi": "sr.x", "mmh": "m.y", "vwap": "v.x"}
view(
    "ft0",
    f"""select b.symbol, b.t, b.rn, b.open, b.high, b.low, b.close, b.volume, b.n, p.x as ppo, sg.y as sig, sr.x as srsi, m.y as mmh, v.x as vwap,
    case when b.n < {P.rma_short} then 0 else r50.y end as rma, case when b.n >= {P.atr_short} then a.y end as atr_s, case when b.n >= {P.atr_long} then al_.y end as atr_l, c.up as cloud_up, c.down as cloud_down,
    al.close5, al.rma200v as rma200, al.rn5, (b.t + 900 + {P.lag}) // 86400 as eval_day
    from b15 b join ppo p using (symbol, rn) join sig sg using (symbol, rn) join srsi sr using (symbol, rn) join mmh m using (symbol, rn) join vwap v using (symbol, rn)
    join rma50 r50 using (symbol, rn) join atr_s a using (symbol, rn) join atr_l al_ using (symbol, rn) join cloud c using (symbol, rn) join al on b.symbol = al.symbol and b.t = al.t""",
    "b15", "ppo", "sig", "srsi", "mmh", "vwap", "rma50", "atr_s", "atr_l", "cloud", "al",
)
view("ft1", "select *, " + ", ".join(f"lag({c}, {k}) over w as {c}_lag{k}" for c, ks in (("close", (1,)), ("ppo", (1,)), ("sig", (1,)), ("srsi", (1,)), ("vwap", (1,)), ("mmh", (1, 2, 3))) for k in ks) + " from ft0 window w as (partition by symbol order by rn)", "ft0")
_wick = {True: ("high - close", "close > open"), False: ("close - low", "close < open")}
view(
    "ft",
    f"""select f.*, {", ".join(f"coalesce(piv.{n}, 0)::double as {n}" for n in LEVELS)},
    coalesce(rma < close and rma200 < close5 and mmh > 0 and cloud_up = 1 and cloud_down = 0, false) as buy_trend,
    coalesce(rma > close and rma200 > close5 and mmh < 0 and cloud_down = 1 and cloud_up = 0, false) as sell_trend,
    {", ".join(f"coalesce(atr_s > atr_l * {P.rvol_threshold} and high - low > 1e-9 and {colour} and {tail} >= 0 and ({tail}) / (high - low) < {P.min_wick}, false) as {name}" for name, (tail, colour) in (("buy_candle", _wick[True]), ("sell_candle", _wick[False])))}
    from ft1 f left join piv on f.symbol = piv.symbol and f.eval_day = piv.day""",
    "ft1", "piv",
)
_warm = f"(rn - 1 >= {P.mmh_first_bar} and mmh is not null and mmh_lag1 is not null and mmh_lag2 is not null and mmh_lag3 is not null)"
view(
    "gt",
    f"""select *, buy_trend and buy_candle as buy, sell_trend and sell_candle as sell, {_warm} as mmh_ok,
    coalesce(buy_trend and buy_candle and {_warm} and mmh > 0 and mmh_lag3 > mmh_lag2 and mmh_lag2 > mmh_lag1 and mmh > mmh_lag1, false) as mmh_up,
    coalesce(sell_trend and sell_candle and {_warm} and mmh < 0 and mmh_lag3 < mmh_lag2 and mmh_lag2 < mmh_lag1 and mmh < mmh_lag1, false) as mmh_down from ft""",
    "ft",
)
# on ticks' candles only the jump can fail: the rest holds by their making
view("evd", f"select * from gt where close <> open and rn >= 5 and rn5 >= 3 and not coalesce(abs(close - close_lag1) / nullif(close_lag1, 0) * 100 > {P.max_jump}, false)", "gt")


def cross(x1: str, y1: str, x: str, y: str, up: bool) -> str:
    return f"{x1} <= {y1} and {x} > {y}" if up else f"{x1} >= {y1} and {x} < {y}"


def undo(x1: str, y1: str, x: str, y: str, up: bool) -> str:
    return f"({x1} > {y1} and {x} <= {y})" if up else f"({x1} < {y1} and {x} >= {y})"


def rules() -> list[tuple[str, str, str, str, bool]]:
    """key, title, trigger, reset, daily."""
    lv, b, g = P.ppo_level, P.ppo_cross_bound, P.ppo_rsi_guard
    on = "coalesce(vwap > 0 and vwap_lag1 > 0, false)"
    out = []
    for up in (True, False):
        gate, s = ("buy", "") if up else ("sell", "-")
        word, icon, way = ("up", "🟢", "above") if up else ("down", "🔴", "below")
        sign = "<" if up else ">"
        out.append([
            (f"ppo_signal_{word}", f"{icon} PPO cross {way} signal", f"{gate} and {cross('ppo_lag1', 'sig_lag1', 'ppo', 'sig', up)} and ppo {sign} {s}{b}", f"{undo('ppo_lag1', 'sig_lag1', 'ppo', 'sig', up)} or not {gate}", False),
            (f"ppo_zero_{word}", f"{icon} PPO cross {way} 0", f"{gate} and {cross('ppo_lag1', '0', 'ppo', '0', up)}", f"{undo('ppo_lag1', '0', 'ppo', '0', up)} or not {gate}", False),
            (f"ppo_011_{word}", f"{icon} PPO cross {way} {s}0.11", f"{gate} and {cross('ppo_lag1', f'{s}{lv}', 'ppo', f'{s}{lv}', up)}", f"{undo('ppo_lag1', f'{s}{lv}', 'ppo', f'{s}{lv}', up)} or not {gate}", False),
            (f"rsi_50_{word}", f"{icon} RSI cross {way} 50 (PPO {sign} {s}0.30)", f"{gate} and {cross('srsi_lag1', '50', 'srsi', '50', up)} and ppo {sign} {s}{g}", f"{undo('srsi_lag1', '50', 'srsi', '50', up)} or not {gate} or ppo {'>=' if up else '<='} {s}{g}", False),
            (f"vwap_{word}", "🔵▲ Price cross above VWAP" if up else "🟣▼ Price cross below VWAP", f"{on} and {gate} and {cross('close_lag1', 'vwap_lag1', 'close', 'vwap', up)}", f"{on} and ({undo('close_lag1', 'vwap_lag1', 'close', 'vwap', up)} or not {gate})", True),
            ("mmh_buy" if up else "mmh_sell", "🔵⬆️ MMH Reversal BUY" if up else "🟣⬇️ MMH Reversal SELL", f"mmh_{word}", "mmh_ok and mmh > 0 and mmh <= mmh_lag1" if up else "mmh_ok and mmh < 0 and mmh >= mmh_lag1", False),
        ])
    base = [x for pair in zip(*out, strict=True) for x in pair]
    for up, names in ((True, UP_LEVELS), (False, DOWN_LEVELS)):
        gate = "buy" if up else "sell"
        for n in names:
            base.append((f"pivot_{'up' if up else 'down'}_{n}", f"{'🟢⬆️ Cross above' if up else '🔴⬇️ Cross below'} {n}", f"{gate} and {n} > 0 and {cross('close_lag1', n, 'close', n, up)} and abs({n} - close) / nullif({n}, 0) * 100 <= {P.pivot_distance}", f"{undo('close_lag1', n, 'close', n, up)} or not {gate}", True))
    return base


_two = lambda x: f"round(({x})::decimal(28,10), 2)::decimal(38,2)::varchar"
_money = lambda x: f"format('{{:t,}}', floor(round(({x})::decimal(28,10), 2))::bigint) || '.' || lpad(((round(({x})::decimal(28,10), 2)::decimal(38,2) * 100)::bigint % 100)::varchar, 2, '0')"
_wr = {True: "case when high - low <= 1e-9 then 1.0 else (high - close) / (high - low) end", False: "case when high - low <= 1e-9 then 1.0 else (close - low) / (high - low) end"}
_wt = lambda up: f"'Wick ' || round((({_wr[up]}) * 100)::decimal(28,10), 1)::decimal(28,1)::varchar || '%'"
_mm = f"'MMH (' || coalesce({_two('mmh')}, 'nan') || ')'"


def text(key: str) -> str:
    up = "up" in key or "buy" in key
    if key.startswith("ppo_signal"):
        return f"'PPO ' || {_two('ppo')} || ' vs Sig ' || {_two('sig')} || ' | ' || {_wt(up)} || ' | ' || {_mm}"
    if key.startswith("ppo"):
        return f"'PPO ' || {_two('ppo')} || ' | ' || {_wt(up)} || ' | ' || {_mm}"
    if key.startswith("rsi"):
        return f"'RSI ' || {_two('srsi')} || ' | PPO ' || {_two('ppo')} || ' | ' || {_wt(up)} || ' | ' || {_mm}"
    if key.startswith("vwap"):
        return f"'VWAP ' || {_two('vwap')} || ' | ' || {_wt(up)} || ' | ' || {_mm}"
    if key.startswith("mmh"):
        return f"{_mm} || ' | ' || {_wt(up)}"
    n = key.rpartition("_")[2]
    return f"'$' || {_money(n)} || ' | ' || {_mm} || ' [Dist: ' || {_two(f'abs({n} - close) / close * 100')} || '%]'"


view(
    "la",
    " union all ".join(
        f"select symbol, t, eval_day, close, {i} as ord, '{key}' as key, '{title}' as title, coalesce({trigger}, false) as trigger, coalesce({reset}, false) as reset, case when coalesce({trigger}, false) then {text(key)} end as text, {str(daily).lower()} as daily from evd"
        for i, (key, title, trigger, reset, daily) in enumerate(rules())
    ),
    "evd",
)
view("lat", "select * from (select *, lag(trigger) over (partition by symbol, key, case when daily then eval_day end order by t) as was from la where trigger or reset) where trigger and not coalesce(was, false)", "la")
view("cap8", f"select * from (select *, row_number() over (partition by symbol, t order by ord) as k from lat) where k <= {P.cap_symbol}", "lat")
view(
    "cap3",
    f"""select *, row_number() over (partition by symbol, t order by case when many > {P.cap_pivots} and is_piv then 1 else 0 end, ord) as rank from (
    select *, key like 'pivot\\_%' escape '\\' as is_piv, sum((key like 'pivot\\_%' escape '\\')::int) over (partition by symbol, t) as many, row_number() over (partition by symbol, t, key like 'pivot\\_%' escape '\\' order by ord) as j from cap8)
    where not is_piv or many <= {P.cap_pivots} or j <= {P.cap_pivots}""",
    "cap8",
)
