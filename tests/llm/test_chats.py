from __future__ import annotations

import json

from pyspark.sql import functions as F

from emberline.llm import chats, queries

CALL = "conv_id long, turn long, call_id string, name string, arguments string, after array<string>, level string, json int"
RESULT = "conv_id long, call_id string, turn long, content string"
SCHEMAS = {"f": {"n": chats.Parameter("integer", True, 1), "s": chats.Parameter("string", False, None, ("a", "b"))}}


def run(spark, calls, results=()):
    out = chats.link_calls(spark.createDataFrame([(*c, "x", 1) for c in calls], CALL), spark.createDataFrame(list(results), RESULT), SCHEMAS)
    return {r["call_id"]: r for r in out.collect()}


def test_against_sql(agrees):
    agrees(queries.op8_chats, chats.ORACLE, "sf0.001")
    agrees(queries.op8_chats, chats.ORACLE, "sf0.01")


def test_order_by_use(spark):
    call = lambda i, *after: (1, 0, i, "f", '{"n": 1}', list(after))
    got = run(spark, [call("a"), call("b", "a", "nowhere"), call("c", "a", "b"), call("d", "e"), call("e", "d"), call("g", "e"), call("h", "c", "c")])
    assert {k: r["level"] for k, r in got.items()} == {"a": 0, "b": 1, "c": 2, "d": None, "e": None, "g": None, "h": 3}


def test_results(spark):
    got = run(spark, [(1, 0, "a", "f", '{"n": 1}', []), (1, 2, "b", "f", '{"n": 1}', None)], [(1, "a", 5, "late"), (1, "a", 3, "soon"), (1, None, 1, "x"), (1, "z", 1, "y"), (None, "a", 1, "w")])
    assert (got["a"]["n_results"], got["a"]["result_turn"], json.loads(got["a"]["json"])["result"]) == (2, 3, "soon")
    assert (got["b"]["n_results"], got["b"]["result_turn"]) == (0, None)


def test_problems_and_canonical_text(spark):
    cases = {
        "ok": ("f", '{"s": "a", "n": 2}', ""),
        "type": ("f", '{"n": "2"}', "n: not of type integer"),
        "least": ("f", '{"n": 0, "s": "c"}', "n: less than 1; s: not a choice"),
        "missing": ("f", '{"z": 1}', "n: missing; z: unexpected"),
        "bad": ("f", "{", "arguments are no JSON object"),
        "twice": ("f", '{"n": 1, "n": 2}', "arguments repeat a key or are too long"),
        "list": ("f", "[1]", "arguments are no JSON object"),
        "null": ("f", None, "arguments are no JSON object"),
        "tool": ("g", "{}", "unknown tool"),
        "none": (None, "{}", "unknown tool"),
    }
    got = run(spark, [(1, 0, k, name, arguments, []) for k, (name, arguments, _) in cases.items()])
    assert {k: r["problems"] for k, r in got.items()} == {k: v[2] for k, v in cases.items()}
    assert got["ok"]["json"] == '{"arguments":{"n":2,"s":"a"},"id":"ok","name":"f"}' and got["ok"]["valid"] and not got["bad"]["valid"]


def test_odd_rows(spark):
    rows = [(None, None, None, None, None, None)] * 2 + [(1, 0, "a", "f", '{"n": 1}', ["a"])] * 3
    out = chats.link_calls(spark.createDataFrame([(*c, "x", 1) for c in rows], CALL), spark.createDataFrame([(1, "a", 1, None)] * 2, RESULT), SCHEMAS).collect()
    assert len(out) == 5 and {r["n_results"] for r in out if r["call_id"]} == {2}
    assert {r["level"] for r in out if r["call_id"] is None} == {0} and {r["level"] for r in out if r["call_id"]} == {None}
    empty = spark.createDataFrame([], CALL), spark.createDataFrame([], RESULT)
    assert chats.link_calls(*empty, SCHEMAS).count() == 0


def test_identifiers_belong_to_their_conversation(spark):
    calls = [(c, 0, "call_1", "f", '{"n": 1}', []) for c in (1, 2)] + [(2, 2, "call_2", "f", '{"n": 1}', ["call_1"]), (1, 2, "call_2", "f", '{"n": 1}', ["call_9"])]
    out = chats.link_calls(spark.createDataFrame([(*c, "x", 1) for c in calls], CALL), spark.createDataFrame([(1, "call_1", 1, "one"), (2, "call_1", 1, "two")], RESULT), SCHEMAS)
    got = {(r["conv_id"], r["call_id"]): (r["n_results"], json.loads(r["json"]).get("result"), r["level"]) for r in out.collect()}
    assert got == {(1, "call_1"): (1, "one", 0), (2, "call_1"): (1, "two", 0), (2, "call_2"): (0, None, 1), (1, "call_2"): (0, None, 0)}


def slow_levels(after):
    """Longest paths by repeated passes; None in and behind circles."""
    level: dict = {}
    while True:
        new = {k: 1 + max((level[p] for p in ps), default=-1) for k, ps in after.items() if k not in level and all(p in level for p in ps)}
        if not new:
            return {k: level.get(k) for k in after}
        level |= new


def test_long_chains(spark):
    def call(i, after):
        return (1, int(i[1:]), i, "f", "{}", after)

    n = 2000
    one = [call(f"a{i}", [f"a{i - 1}"]) for i in range(n)]
    two = [call(f"b{i}", [f"b{i - 1}", f"b{i - 2}"]) for i in range(300)]
    every = [call(f"c{i}", [f"c{j}" for j in range(i)]) for i in range(60)]
    circle = [call(f"d{i}", [f"d{(i + 1) % 50}"]) for i in range(50)] + [call("e1", ["d3"]), call("e2", ["e1", "a5"])]
    fork = [call(f"g{i}", [f"a{i * 7}", f"b{i}"]) for i in range(40)]
    calls = one + two + every + circle + fork
    ids = {c[2] for c in calls}
    want = slow_levels({c[2]: [p for p in c[5] if p in ids] for c in calls})
    got = {r["call_id"]: r["level"] for r in chats.levels(spark.createDataFrame([(*c, "x", 1) for c in calls], CALL)).collect()}
    assert got == want and got["a1999"] == 1999 and got["b299"] == 299 and got["d0"] is None


def test_numbers_are_canonical(spark):
    cases = {"1": "1", "1.0": "1", "1e0": "1", "1e2": "100", "-0.0": "0", "1.50": "1.5", "0.001": "0.001", "1E-7": "0.0000001", "12345678901234567890": "12345678901234567890", "123456789.125": "123456789.125", "1.25e1": "12.5", "1e30": "1e30", "100": "100", "2.5e-9": "0.0000000025", "2.50e-30": "2.5e-30", "-3e3": "-3000"}
    rows = spark.createDataFrame([(k, f'{{"x": {k}, "s": "1.0, a: 2.50 \\\\\\" 3.0 \\\\", "t": [{k}, {{"u": {k}}}]}}') for k in cases], "k string, j string")
    for r in rows.select("k", chats.canonical(F.to_json(F.try_parse_json("j"))).alias("c")).collect():
        v = cases[r["k"]]
        assert r["c"] == f'{{"s":"1.0, a: 2.50 \\\\\\" 3.0 \\\\","t":[{v},{{"u":{v}}}],"x":{v}}}', r["k"]


def test_very_long_arguments_and_equal_turns(spark):
    long = json.dumps({"n": 1, "s": 'a"\\ 1.0 ' * 200_000})
    got = run(spark, [(1, 0, "a", "f", long, [])], [(1, "a", 3, "b"), (1, "a", 3, "a")])["a"]
    assert got["problems"] == "s: not a choice" and json.loads(got["json"]) == {"arguments": json.loads(long), "id": "a", "name": "f", "result": "a"}


def test_a_deep_conversation_whose_calls_wait_for_two(spark, monkeypatch):
    """A thousand calls, each of which uses the one before it and the one before that one's."""
    saved = []
    real = chats.materialize
    monkeypatch.setattr(chats, "materialize", lambda df: saved.append(1) or real(df))
    calls = [(1, i, f"c{i}", "f", "{}", [f"c{i - 1}", f"c{max(i - 3, 0)}"] if i else []) for i in range(1000)]
    got = {r["call_id"]: r["level"] for r in chats.levels(spark.createDataFrame([(*c, "x", 1) for c in calls], CALL)).collect()}
    assert got == {f"c{i}": i for i in range(1000)}
    assert len(saved) < 10


def test_folding_and_rounds_agree(spark, monkeypatch):
    import random

    rng = random.Random(9)
    calls = [(c, rng.randrange(6), f"c{i}", "f", "{}", [f"c{rng.randrange(14)}" if c % 4 == 0 else f"c{rng.randrange(i)}" for _ in range(rng.randrange(4)) if i]) for c in range(30) for i in range(12)]
    rows = spark.createDataFrame([(*c, "x", 1) for c in calls], CALL)
    plain = lambda: sorted(map(tuple, chats.levels(rows).collect()), key=str)
    both = plain()
    monkeypatch.setattr(chats, "FOLD", 0)
    assert plain() == both


def test_a_null_argument_stays(spark):
    got = run(spark, [(1, 0, "a", "f", '{"s": null, "n": 1}', None)])
    assert json.loads(got["a"]["json"])["arguments"] == {"n": 1, "s": None}
