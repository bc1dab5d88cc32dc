from __future__ import annotations

import uuid
from itertools import combinations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from emberline.llm import graph, queries, simhash, similar
from emberline.llm.graph import components
from emberline.storage import NUMBERS, compact

SF = "/root/testdata/sf0.01"


def shingle_set(text: str | None) -> frozenset[bytes]:
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def kept_by_brute_force(rows: dict[int, str | None]) -> set[int]:
    sets, root = {i: shingle_set(t) for i, t in rows.items()}, {i: i for i in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(rows, 2):
        n, m = len(sets[a]), len(sets[b])
        if 5 * min(n, m) >= 4 * max(n, m) and 9 * len(sets[a] & sets[b]) >= 4 * (n + m):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i for i in rows if find(i) == i}


def test_near_copies_against_brute_force(spark):
    docs = corpus_pipeline.no_exact_copies(spark, queries.table(spark, SF, "documents"), SF)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = kept_by_brute_force(rows)
    assert len(rows) - len(want) >= 5
    assert {r["doc_id"] for r in corpus_pipeline.no_near_copies(spark, docs, SF).collect()} == want


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_a_large_group_and_clean_documents(docs, monkeypatch, rounds):
    monkeypatch.setattr(similar, "ROUNDS", rounds)
    base = [f"word{i}" for i in range(80)]
    rows = [(0, " ".join(base))]
    for i in range(1, 40):  # each replaces some words of the base
        words = list(base)
        for k in range(i % 4):
            words[(i * 7 + k * 29) % 80] = f"other{i}_{k}"
        rows.append((100 - i, " ".join(words)))
    rows += [(200 + i, " ".join(f"clean{i}_{j}" if j % 3 == 0 else base[j] for j in range(80))) for i in range(5)]
    rows += [(300, None), (301, ""), (302, "Two words"), (303, "two  WORDS"), (304, "two words more")]
    got = {r["doc_id"] for r in simhash.drop_near_copies(docs(*rows)).collect()}
    assert got == kept_by_brute_force(dict(rows)) and {200, 201, 202, 203, 204, 300, 302, 304} <= got


def test_odd_rows_and_no_rows(odd):
    kept = simhash.drop_near_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 5, 6, 7, 8]  # one of the repeated rows of 5
    groups = {(r["doc_id"], r["component_id"]) for r in simhash.near_groups(odd, width=5, similarity=0.8).collect()}
    assert {(1, 1), (2, 1), (3, 1), (5, 5), (None, 5), (None, 1)} <= groups
    assert simhash.drop_near_copies(odd.where(F.lit(False))).count() == 0
    alone = odd.where("doc_id is null and text is not null")
    assert simhash.drop_near_copies(alone.union(alone)).count() == 1


@pytest.mark.parametrize("share", [0.5, 0.9])
def test_any_similarity(docs, share):
    rows = [(i, " ".join(f"w{(j * j + (j % (i + 2) == 0) * i) % 97}" for j in range(60))) for i in range(12)]
    sets = {i: shingle_set(t) for i, t in rows}
    linked = {(i, j) for i, j in combinations(sets, 2) if len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j])}
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs(*rows), width=5, similarity=share).collect()}
    assert all(got[i] == got[j] for i, j in linked) and len(set(got.values())) >= len(rows) - len(linked)


def test_text_ids(spark):
    rows = spark.createDataFrame([("b", "one two three"), ("a", "one two three"), ("c", "other words here")], "doc_id string, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in simhash.near_groups(rows).collect()) == [("a", "a"), ("b", "a"), ("c", "c")]
    assert sorted(r["doc_id"] for r in simhash.drop_near_copies(rows).collect()) == ["a", "c"]


def test_beyond_the_bounds_of_broadcasts(docs, odd, monkeypatch):
    monkeypatch.setattr(similar, "NODES", 0)
    assert sorted(r["doc_id"] for r in simhash.drop_near_copies(odd).collect()) == [1, 5, 6, 7, 8]


def test_a_passage_that_different_texts_share_makes_no_pairs(docs, monkeypatch):
    """Texts of 21 common words and 3 of their own: 17 of 20 shingles are shared, similarity 0.74."""
    asked = []
    real = similar.Search.verified
    monkeypatch.setattr(similar.Search, "verified", lambda self, pairs: asked.append(pairs.count()) or real(self, pairs))
    rows = [(i, " ".join([f"common{k}" for k in range(21)] + [f"own{i}_{k}" for k in range(3)])) for i in range(1500)]
    rows += [(5000, " ".join([f"common{k}" for k in range(21)] + ["own7_0", "own7_1", "another"]))]
    got = {r["doc_id"] for r in simhash.drop_near_copies(docs(*rows)).collect()}
    assert got == set(range(1500))
    assert sum(asked) < 5 * len(rows)


def test_bands_cover_all_sizes_of_similar_sets(spark):
    from fractions import Fraction

    rows = spark.range(1, 400).select(F.col("id").cast("int").alias("n")).withColumn("i", F.lit(0))
    search = similar.Search.__new__(similar.Search)
    search.share = Fraction(4, 5)
    found = search.partners(rows).groupBy("n").agg(F.collect_set("band").alias("bands"))
    bands = {r["n"]: r["band"] for r in rows.select("n", similar.band(F.col("n")).alias("band")).collect()}
    for r in found.collect():
        assert {bands[m] for m in bands if 5 * min(m, r["n"]) >= 4 * max(m, r["n"])} <= set(r["bands"])


def tasks_of(spark, run) -> int:
    """Tasks of all stages of what run does."""
    sc, group = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, "counted")
    try:
        run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    told = sc.statusTracker()
    stages = {s for j in told.getJobIdsForGroup(group) for s in told.getJobInfo(j).stageIds}
    return sum(i.numCompletedTasks for s in stages if (i := told.getStageInfo(s)))


def test_small_tables_take_few_tasks_however_many_partitions_shuffles_have(spark, monkeypatch):
    held = {"spark.sql.shuffle.partitions": "101", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 103), (101, 103), (102, 100)], "u long, v long").repartition(50)
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = {}
        assert tasks_of(spark, lambda: got.update((r["node"], r["root"]) for r in components(edges).collect())) < 500
        assert got == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100, 103: 100}
        monkeypatch.setattr(graph, "NUMBERS", 64)  # now they don't fit into one task
        assert {r["node"]: r["root"] for r in components(edges).collect()} == got
        table, rows = compact(edges.distinct())
        assert (rows, table.count(), table.rdd.getNumPartitions()) == (43, 43, 1)
        assert compact(edges, F.lit(NUMBERS))[0].rdd.getNumPartitions() == 44
        assert compact(edges.where("u < 0"))[1] == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
