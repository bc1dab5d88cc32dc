from __future__ import annotations

from collections import defaultdict

from pyspark.sql import functions as F

from emberline.llm import mixing, queries


def test_against_sql(agrees):
    agrees(queries.op3_mixing, mixing.ORACLE, "sf0.001")
    agrees(queries.op3_mixing, mixing.ORACLE, "sf0.01")


def test_sources_come_near_their_targets(spark):
    rows = mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    taken, goal, largest = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        taken[r["source"]] += r["taken"]
        goal[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - goal[s]) <= largest[s] / 2 + 1 for s in goal)
    assert abs(sum(goal.values()) - sum(r["size"] for r in rows)) < 1e-3


def test_caps_are_shared_anew(docs):
    # a, b, c weigh 1, 2, 3; c has little and stops at three times its words
    rows = docs(*[(i, "w " * 100, "a") for i in range(6)], *[(i, "w " * 100, "b") for i in range(10, 14)], (20, "w " * 10, "c"))
    goal = {r["source"]: r["target"] for r in mixing.mix(rows).collect()}
    assert goal["c"] == 30.0
    assert goal["a"] * 2 == goal["b"] and abs(sum(goal.values()) - 1010) < 1e-6


def test_odd_rows_and_reruns(odd):
    a, b = mixing.mix(odd).collect(), mixing.mix(odd).collect()
    assert sorted(map(str, a)) == sorted(map(str, b)) and len(a) == 10
    assert {r["size"] for r in a if r["doc_id"] in (1, 2, 3)} == {0}
    assert mixing.mix(odd.where(F.lit(False))).count() == 0
    only_empty = mixing.mix(odd.where("doc_id < 4")).collect()
    assert {(r["target"], r["taken"]) for r in only_empty} == {(0.0, 0)}


def test_documents_are_repeated_as_taken(spark, documents):
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(documents).collect() if r["size"]}
    got = mixing.take_mix(documents)
    assert got.columns == documents.columns
    assert {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()} == {k: v for k, v in taken.items() if v}


def test_clashing_names_and_repeated_ids(spark):
    schema = "doc_id long, text string, source string, _id string, _n int, _source string, _taken int, _c0 string, size int, h string"
    rows = [(i % 7, "w " * (10 + i), "ab"[i % 2], "x", 1, "y", 2, "z", 3, "q") for i in range(40)] + [(None, "w w", None, None, None, None, None, None, None, None)] * 3
    docs = spark.createDataFrame(rows, schema)
    want, got = defaultdict(int), defaultdict(int)
    for r in mixing.mix(docs).collect():
        want[r["doc_id"], r["source"], r["size"]] += r["taken"]
    taken = mixing.take_mix(docs)
    assert taken.columns == docs.columns
    for r in taken.collect():
        n = len(r["text"].split())
        got[r["doc_id"], r["source"], n] += n
    assert dict(got) == {k: v for k, v in want.items() if v}


def test_an_id_in_two_sources(docs):
    rows = docs(*[(i, "w " * 10, "a") for i in range(20)], *[(i, "w " * 10, "b") for i in range(5)])
    want = {(r["doc_id"], r["source"]): r["taken"] // 10 for r in mixing.mix(rows).collect()}
    got = {(r["doc_id"], r["source"]): r["count"] for r in mixing.take_mix(rows).groupBy("doc_id", "source").count().collect()}
    assert got == {k: v for k, v in want.items() if v}
