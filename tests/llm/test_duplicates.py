from __future__ import annotations

import hashlib
from collections import defaultdict
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from emberline.llm import exact_dedup, graph, queries, simhash


def brute_fingerprint(text: str | None, width: int) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints: dict[int, int], radius: int) -> dict[int, int]:
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(prints, 2):
        if bin(prints[a] ^ prints[b]).count("1") <= radius:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in prints}


@pytest.mark.parametrize("width", [3, 5])
def test_groups_equal_all_pairs(spark, documents, width):
    rows = documents.select("doc_id", "text").collect()
    prints = {r["doc_id"]: brute_fingerprint(r["text"], width) for r in rows}
    want = brute_components(prints, 2)
    got = simhash.near_groups(documents, width=width).collect()
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in got} == prints
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert len(set(want.values())) < len(want)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_links_connect_all_within_any_radius(spark, radius):
    prints = {i: (0x0123456789ABCDEF ^ m) for i, m in enumerate([0, 1, 3, 7, 0xF0, 0xF1, 1 << 63, (1 << 63) | 5, 0xFFFF << 20, 0xFFFE << 20])}
    signed = {i: x - (1 << 64) if x >> 63 else x for i, x in prints.items()}
    links = simhash.links(spark.createDataFrame([(x,) for x in set(signed.values())], "fp long"), radius)
    roots = {r["node"]: r["root"] for r in graph.components(links).collect()}
    want, group = brute_components(prints, radius), defaultdict(set)
    for i, x in signed.items():
        group[roots.get(x, x)].add(i)
    assert {frozenset(v) for v in group.values()} == {frozenset(i for i in want if want[i] == r) for r in set(want.values())}
    assert all(bin((r["u"] ^ r["v"]) & (1 << 64) - 1).count("1") <= radius for r in links.collect())


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, i) for i in range(1001, 1300)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(path + star + [(5, 5)], "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and all(got[i] == 1000 for i in range(1001, 1300)) and len(got) == 499


def test_simhash_of_odd_rows(odd):
    got = [tuple(r) for r in simhash.near_groups(odd).collect()]
    assert len(got) == 10
    by = defaultdict(set)
    for i, fp, c in got:
        by[i].add((fp, c))
    assert by[1] == by[2] == by[3] == {("0" * 16, 1)}
    assert by[5] == {(f"{brute_fingerprint('Hello world again', 3):016x}", 5)}
    assert simhash.near_groups(odd.where(F.lit(False))).count() == 0
    assert simhash.drop_near_copies(odd).columns == odd.columns


def test_exact_against_sql(agrees):
    agrees(queries.op9_exact_dedup, exact_dedup.ORACLE, "sf0.001")
    agrees(queries.op9_exact_dedup, exact_dedup.ORACLE, "sf0.01")


def test_exact_of_odd_rows(odd):
    got = [r.asDict() for r in exact_dedup.exact_groups(odd).collect()]
    assert len(got) == 10
    empty = [r for r in got if r["text_sha256"] == hashlib.sha256(b"").hexdigest()]
    assert {(r["keep_id"], r["group_size"]) for r in empty} == {(3, 4)}  # the longest original text
    hello = [r for r in got if r["text_sha256"] == hashlib.sha256(b"Helloworldagain").hexdigest()]
    assert {(r["keep_id"], r["group_size"]) for r in hello} == {(5, 3)}
    assert sorted(r["kept"] for r in hello) == [False, False, True]
    assert exact_dedup.exact_groups(odd.where(F.lit(False))).count() == 0
    kept = exact_dedup.drop_exact_copies(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 5, 6, 7, 8]


def test_ties_go_to_the_smallest_id(docs):
    got = exact_dedup.exact_groups(docs((9, "a b"), (4, "ab "), (-3, "ab"), (2**63 - 1, "a  b"))).collect()
    assert {r["keep_id"] for r in got} == {2**63 - 1}
    got = exact_dedup.exact_groups(docs((9, "a b"), (-4, "ab "), (-2**63, "ba"))).collect()
    assert {r["doc_id"]: r["keep_id"] for r in got} == {9: -4, -4: -4, -(2**63): -(2**63)}


def test_texts_that_share_a_digest_stay_apart(docs):
    rows = docs((1, "aa"), (2, "bb"), (3, "a a"), (4, "ccc"), (5, "b b"))
    got = exact_dedup.exact_groups(rows, digest=lambda norm: F.char_length(norm).cast("string")).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in got} == {1: (3, 2), 3: (3, 2), 2: (5, 2), 5: (5, 2), 4: (4, 1)}


def test_each_group_keeps_one_row(docs):
    rows = docs((1, "a b"), (1, "ab"), (1, "a b"), (None, "lone"), (None, "lone"), (None, "l one"), (2, "x"), (2, "y"))
    got = [(r["doc_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(rows).collect()]
    assert sorted(x for x in got if x[2] and x[0]) == [(1, 3, True), (2, 1, True), (2, 1, True)] and sum(x[2] for x in got if x[0] is None) == 1
    kept = exact_dedup.drop_exact_copies(rows).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == [("1", "a b"), ("2", "x"), ("2", "y"), ("None", "l one")]
