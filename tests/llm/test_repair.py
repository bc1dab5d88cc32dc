from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from emberline.llm import repair
from emberline.llm.queries import op12_repair

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
WHITE = "\x20\t\n\x0b\x0c\r"
TURNS = "conv_id long, turn long, role string, text string, n long, digest string, code int, audit string"


def edits(rows):
    """All least (cost, audit, repaired rows), by a table over prefixes and what the roles read so far."""
    best = {"": (0, "", [])}

    def offer(table, key, value):
        if key not in table or value[:2] < table[key][:2]:
            table[key] = value

    def state(key, initial):
        word = key + initial
        return word if re.fullmatch(r"s?(ua)*u?", word) else None


    def inserted(table):
        for _ in range(3):
            for key, (cost, audit, out) in list(table.items()):
                for i, role in (("u", "user"), ("a", "assistant")):
                    if (to := state(key, i)) is not None:
                        offer(table, tail(to), (cost + 2, audit + "I", [*out, f"{role}:"]))
        return table

    def tail(word):
        """Words that may be followed by the same."""
        body = word.removeprefix("s")
        return ("s" if word.startswith("s") and not body else "") + ("" if not body else "ua"[: 2 - len(body) % 2])

    best = inserted(best)
    for role, text, fault in rows:
        table = {}
        for key, (cost, audit, out) in best.items():
            offer(table, key, (cost + 3, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            more = fault == "truncated"
            for i, name in (("u", "user"), ("a", "assistant")):
                if (to := state(key, i)) is not None:
                    offer(table, tail(to), (cost + 2 + more, audit + "R", [*out, f"{name}:{text}"]))
            if role and (to := state(key, role[0])) is not None:
                offer(table, tail(to), (cost + more, audit + "K", [*out, f"{role}:{text}"]))
        best = inserted(table)
    return min(v for k, v in best.items() if k in ("", "ua"))


def brute(turns):
    out = []
    for conv in {t[0] for t in turns}:
        rows = []
        for c, turn, role, text, *_ in sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or " ", hashlib.sha256((t[3] or " ").encode()).hexdigest())):
            role, text = " " if role is None else role, " " if text is None else text
            way = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
            role = "user" if way == 4 else role
            rows += [(turn, role, text)] * (0 if way == 0 else 2 if way == 3 else 1)
        # rows of one turn have no order of their own: by role and digest
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        seen, faulty = set(), []
        for _, role, text in rows:
            end = text.rstrip(WHITE)
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else ""
            seen.add((role, text))
            faulty.append((role, text, fault))
        numbers = [t for t, _, _ in rows if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        count = lambda f: sum(x[2] == f for x in faulty)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:], strict=False))
        cost, audit, repaired = edits(faulty)
        out.append((conv, gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest()))
    return sorted(out, key=str)


def test_query_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    turns = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = op12_repair(spark, sf_dir)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == brute(turns)


def test_odd_rows(spark):
    rng = random.Random(3)
    texts = ["Hi there.", "Hi there.", "cut off", None, "", " \t", "Why?", "é!\n", "x" * 3000 + "."]
    roles = ["user", "assistant", "system", "user", "assistant", None, "tool", "uncle", ""]
    rows = [(rng.choice([None, 1, 2, 3, 4, 5]), rng.choice([None, 0, 1, 2, 3, 7, 7, 900]), rng.choice(roles), rng.choice(texts), 1, "d", 5, "a") for _ in range(120)]
    rows += [(10 + k, t, rng.choice(roles), rng.choice(texts), 1, "d", 5, "a") for k in range(60) for t in range(rng.randrange(1, 7))]
    got = repair.repaired(spark.createDataFrame(rows, TURNS))
    assert sorted(map(tuple, got.select(COLUMNS).collect()), key=str) == brute(rows)


def test_conversations_without_rows_and_without_anything(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = spark.createDataFrame([(gone, 0, "user", "x.", 1, "d", 5, "a")], TURNS)
    assert [tuple(r) for r in repair.repaired(rows).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair.repaired(rows.limit(0)).collect() == []


def test_a_long_conversation_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(repair, "PIECE", 7)
    rng = random.Random(4)
    rows = [(1, t // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", f"c{t}.", f"d{t}", ""]), 1, "d", 5, "a") for t in range(400)]
    got = repair.applied(spark.createDataFrame(rows, TURNS), repair.damaged(spark.createDataFrame(rows, TURNS)))
    assert [tuple(r) for r in got.collect()] == brute(rows)


@pytest.mark.parametrize("longest", [9, 40])
def test_pieces_give_what_one_search_gives(monkeypatch, longest):
    rng = random.Random(longest)
    for _ in range(150):
        codes = bytes(rng.choice([0, 1, 2, 1, 2, 3, 5, 6, 9, 10, 8]) for _ in range(rng.randrange(longest)))
        whole = repair.cheapest(codes, repair.EMPTY, repair.FINAL)
        monkeypatch.setattr(repair, "PIECE", 4)
        assert repair.repair(codes) == whole
        monkeypatch.undo()
