"""Structure repair of conversations: the cheapest edits after which roles read system?, then user and assistant in turn.

Rows are faulty if blank, repeated or cut off. A conversation becomes a row of small codes, one for each of its rows, and the
edits are a cheapest way through the lattice of (rows used, state), found by Dijkstra's search from both ends. The
two heaps go on until nothing cheaper or as cheap can be left; of all crossings of least cost the one with the least
concatenated audit wins. An audit determines its cost, so that least prefixes and suffixes make least audits.

Long conversations are cut into pieces of a few hundred rows. Each is searched from each state to each state, and neighbours
are joined two by two. Rows stream through a task in sorted order: what it holds of a conversation is a letter a row, as
much as the audit that is returned; texts are hashed as they pass.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space of the word definition.
SPACE = "\x20\t\n\x0b\x0c\r"
#: States: nothing yet, behind the system row, behind a user row, behind an assistant row.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: Where a kept row of each initial leads from each state.
KEEP = {("s", EMPTY): SYSTEM, ("u", EMPTY): USER, ("u", SYSTEM): USER, ("a", USER): ASSISTANT, ("u", ASSISTANT): USER}
#: Where the next role leads from each state.
NEXT = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: States in which a conversation may end.
FINAL = (EMPTY, ASSISTANT)
#: Costs of the edits; what a cut-off row costs that isn't deleted.
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
#: Codes of rows: their initial's place here, and these flags.
INITIALS = "sua?"
MUST_GO, TRUNCATED = 4, 8
#: Rows of a piece; rows that a task sends on at once.
PIECE, OUT = 128, 4096
LEGAL = {"su", "ua", "au"}


def steps(codes: bytes, i: int, state: int) -> Iterator[tuple[str, int, int, int]]:
    """Edits at a node of the lattice: letter, cost, and the node that each leads to."""
    yield "I", INSERT, i, NEXT[state]
    if i < len(codes):
        code = codes[i]
        yield "D", DELETE, i + 1, state
        if not code & MUST_GO:
            more = CUT_OFF if code & TRUNCATED else 0
            yield "R", REROLE + more, i + 1, NEXT[state]
            if (to := KEEP.get((INITIALS[code & 3], state))) is not None:
                yield "K", more, i + 1, to


def steps_back(codes: bytes, i: int, state: int) -> Iterator[tuple[str, int, int, int]]:
    """Edits that lead to a node: letter, cost, and the node that each comes from."""
    for s in range(4):
        for j in (i, i - 1) if i else (i,):
            for letter, cost, at, to in steps(codes, j, s):
                if (at, to) == (i, state):
                    yield letter, cost, j, s


@lru_cache(1 << 14)
def cheapest(codes: bytes, start: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """Cost and least audit of the cheapest way from `start` before the first row to one of `ends` behind the last; None if there is none.

    The reverse heap takes later rows first, since keeping costs nothing: a node's suffixes are all there when it is settled.
    """
    n = len(codes)
    ahead: list[tuple[int, str, int, int]] = [(0, "", 0, start)]
    behind: list[tuple[int, int, str, int]] = [(0, -n, "", s) for s in ends]
    done: dict[tuple[int, int], tuple[int, str]] = {}
    left: dict[tuple[int, int], tuple[int, str]] = {}
    best: tuple[int, str] | None = None

    def offer(cost: int, audit: str) -> None:
        nonlocal best
        if best is None or (cost, audit) < best:
            best = cost, audit

    while ahead and behind and (best is None or ahead[0][0] + behind[0][0] <= best[0]):
        if ahead[0][0] <= behind[0][0]:
            cost, audit, i, state = heapq.heappop(ahead)
            if (i, state) in done:
                continue
            done[i, state] = cost, audit
            if rest := left.get((i, state)):
                offer(cost + rest[0], audit + rest[1])
            for letter, more, j, to in steps(codes, i, state):
                if rest := left.get((j, to)):  # a crossing between two settled nodes
                    offer(cost + more + rest[0], audit + letter + rest[1])
                if (j, to) not in done:
                    heapq.heappush(ahead, (cost + more, audit + letter, j, to))
        else:
            cost, back, audit, state = heapq.heappop(behind)
            i = -back
            if (i, state) in left:
                continue
            left[i, state] = cost, audit
            if before := done.get((i, state)):
                offer(before[0] + cost, before[1] + audit)
            for letter, more, j, frm in steps_back(codes, i, state):
                if before := done.get((j, frm)):
                    offer(before[0] + more + cost, before[1] + letter + audit)
                if (j, frm) not in left:
                    heapq.heappush(behind, (cost + more, -j, letter + audit, frm))
    return best


def repair(codes: bytes) -> tuple[int, str]:
    """Cost and audit of a conversation of these codes. One without rows stays as it is."""
    if len(codes) <= PIECE:
        return cheapest(codes, EMPTY, FINAL)
    pieces = [codes[i : i + PIECE] for i in range(0, len(codes), PIECE)]
    ways = [{(a, b): w for a in ((EMPTY,) if k == 0 else range(4)) for b in (FINAL if k == len(pieces) - 1 else range(4)) if (w := cheapest(p, a, (b,)))} for k, p in enumerate(pieces)]
    while len(ways) > 1:
        ways = [joined(*ways[i : i + 2]) if i + 1 < len(ways) else ways[i] for i in range(0, len(ways), 2)]
    return min(ways[0].values())


def joined(first: dict, second: dict) -> dict:
    """The cheapest ways through two neighbouring pieces; audits are joined only where costs are least."""
    out = {}
    for a in range(4):
        for c in range(4):
            costs = {b: first[a, b][0] + second[b, c][0] for b in range(4) if (a, b) in first and (b, c) in second}
            if costs:
                least = min(costs.values())
                out[a, c] = least, min(first[a, b][1] + second[b, c][1] for b, cost in costs.items() if cost == least)
    return out


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of rows after damage by crc32(`conv_id:turn`) % 20; nulls are one space in the hash, in roles and in texts."""
    kinds = turns.select("conv_id", "turn", "role", "text")
    or_blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.crc32(F.concat(or_blank("conv_id"), F.lit(":"), or_blank("turn")).cast("binary")) % 20
    rows = kinds.select("conv_id", "turn", or_blank("role").alias("role"), or_blank("text").alias("text"), way.alias("_way")).where("_way != 0")
    text = F.when(F.col("_way") == 1, "").when(F.col("_way") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("_way") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("_way") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def coded(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, n, code, first: a row for each group of equal rows of a turn.

    first: whether no row of the same role and text comes earlier. Equal rows are counted before they are moved, and the first turn of
    each role and text is a minimum over what is left.
    """
    last = F.regexp_extract("text", "([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*\\z", 1)
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    flags = F.when(last == "", MUST_GO).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(0)
    of = rows.select("conv_id", "turn", "role", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), (code + flags).cast("int").alias("code"))
    groups = of.groupBy("conv_id", "turn", "role", "digest", "code").agg(F.count(F.lit(1)).alias("n"))
    same = lambda a, b: F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id")) & (F.col(f"{a}.role") == F.col(f"{b}.role")) & (F.col(f"{a}.digest") == F.col(f"{b}.digest"))
    firsts = groups.groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull(), F.col("turn"))).alias("_first"))
    met = groups.alias("g").join(firsts.alias("f"), same("g", "f"))
    return met.select("g.*", F.col("turn").eqNullSafe(F.col("f._first.turn")).alias("first"))


def sorted_by(rows: DataFrame, *more: str) -> DataFrame:
    """Rows of a conversation one behind the other in one task, by turn (nulls first), then by role and text digest."""
    order = ["conv_id", *more, "turn", "role", "digest"]
    return rows.repartition("conv_id").sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation that has rows; rows as coded() gives them."""
    kind = rows.select("conv_id").schema[0].dataType.simpleString()
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    class Seen:
        def __init__(self, conv: object) -> None:
            self.conv, self.codes, self.counts, self.before = conv, bytearray(), [0, 0, 0, 0], ""
            self.low = self.high = None
            self.turns = 0

        def add(self, turn: int | None, role: str, code: int, n: int, first: bool) -> None:
            if turn is not None:
                self.low = turn if self.low is None else self.low
                self.turns += turn != self.high
                self.high = turn
            initial = role[:1]
            for k in range(n):
                if code & MUST_GO:
                    self.counts[0] += 1
                elif not first or k:
                    self.counts[1] += 1
                elif code & TRUNCATED:
                    self.counts[2] += 1
                again = not code & MUST_GO and (not first or k > 0)
                self.codes.append((code & 3) | MUST_GO if again else code)
                self.counts[3] += len(self.codes) > 1 and self.before + initial not in LEGAL
                self.before = initial

        def row(self) -> tuple:
            cost, audit = repair(bytes(self.codes))
            gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
            return (self.conv, gaps, *self.counts, cost, audit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Seen | None = None
        out: list[tuple] = []
        for batch in batches:
            for conv, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now is None or conv != now.conv:
                    if now:
                        out.append(now.row())
                    now = Seen(conv)
                now.add(*row)
            if len(out) >= OUT:
                yield made(out)
                out = []
        yield made([*out, *([now.row()] if now else [])])

    def made(out: list[tuple]) -> pa.RecordBatch:
        kinds = [None, *[pa.int64()] * 6, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(names), kinds, strict=True)], names=names)

    dealt = sorted_by(rows).select("conv_id", "turn", "role", "code", "n", "first")
    return dealt.mapInArrow(run, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


class Hashed:
    """The repaired rows of a conversation, hashed as they pass."""

    def __init__(self, audit: str) -> None:
        self.letters, self.at, self.state, self.hash, self.any = audit, 0, EMPTY, hashlib.sha256(), False

    def put(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.any else "") + role + ":").encode())
        self.hash.update(text.encode())
        self.any = True

    def role(self) -> str:
        self.state = NEXT[self.state]
        return "user" if self.state == USER else "assistant"

    def inserted(self) -> None:
        while self.at < len(self.letters) and self.letters[self.at] == "I":
            self.at += 1
            self.put(self.role(), "")

    def add(self, role: str, text: str) -> None:
        self.inserted()
        letter = self.letters[self.at]
        self.at += 1
        if letter == "K":
            self.state = KEEP[role[:1], self.state]
            self.put(role, text)
        elif letter == "R":
            self.put(self.role(), text)

    def hexdigest(self) -> str:
        self.inserted()
        return self.hash.hexdigest()


def repaired(turns: DataFrame) -> DataFrame:
    """Each conv_id of turns (conv_id, turn, role, text) once, null included, with its faults after damage and its repair.

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Nulls count as one space. Rows of one
    turn, which have no order, are taken by role and text digest; a role that is empty or begins otherwise than s, u, a
    can't be kept. A conversation without rows after damage has zeros, an empty audit and the hash of the empty text. Repeated rows are duplicates.
    Extra columns are ignored; an empty table gives no rows.
    """
    return applied(turns, damaged(turns))


def applied(turns: DataFrame, rows: DataFrame) -> DataFrame:
    """As repaired, of the rows that are left of turns."""
    kinds = dict(turns.select("conv_id", "turn").dtypes)
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    none = {"turn": F.lit(None).cast(kinds["turn"]), "role": F.lit(""), "digest": F.lit(""), "text": F.lit(""), **{n: F.lit(0).cast("long") for n in numbers}, "audit": F.lit("")}

    def side(df: DataFrame, kind: int, **given: Column) -> DataFrame:
        return df.select("conv_id", F.lit(kind).alias("_kind"), *[(given.get(c, x)).alias(c) for c, x in none.items()])

    every = side(turns.select("conv_id").distinct(), 0)
    heads = side(audits(coded(rows)), 1, **{n: F.col(n) for n in [*numbers, "audit"]})
    texts = side(rows, 2, turn=F.col("turn"), role=F.col("role"), digest=F.sha2(F.col("text").cast("binary"), 256), text=F.col("text"))
    names = ["conv_id", *numbers, "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A conversation's rows come as: itself, its audit if it has rows, its rows."""
        head, hashed, out = None, Hashed(""), []
        for batch in batches:
            for conv, kind, role, text, *values in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if kind == 0 and head is not None:
                    out.append((*head, hashed.hexdigest()))
                if kind < 2:
                    head, hashed = (conv, *values), Hashed(values[-1])
                else:
                    hashed.add(role, text)
            if len(out) >= OUT:
                yield made(out)
                out = []
        yield made([*out, *([(*head, hashed.hexdigest())] if head is not None else [])])

    def made(out: list[tuple]) -> pa.RecordBatch:
        arrow = [None, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(names), arrow, strict=True)], names=names)

    dealt = sorted_by(every.unionByName(heads).unionByName(texts), "_kind").select("conv_id", "_kind", "role", "text", *numbers, "audit")
    return dealt.mapInArrow(run, f"conv_id {kinds['conv_id']}, {', '.join(f'{n} long' for n in numbers)}, audit string, repaired_sha256 string")
