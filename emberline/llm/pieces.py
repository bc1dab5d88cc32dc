"""SentencePiece encoding and decoding by suffix arrays, for BPE models.

The distinct words of a batch are joined to one text and its suffixes are sorted (by 16 bytes; suffixes that share these are
told apart where a piece is longer). Each
piece of the vocabulary finds its occurrences as one range of the suffix array by binary
search, a piece of over 16 bytes as the true places of such a range. The occurrences are edges of a lattice. It is cut where no edge
crosses a place: no merge can cross it either, so that text without blanks falls into short parts. The edges are sorted by the place where they end in their part, and are
relaxed in that order over all parts at once: a place is reached by the one edge whose
piece may follow the piece before it.

Why this is BPE: a row of pieces is the encoding of a text exactly if each neighbouring
pair, encoded on its own, gives that pair again. So the last piece of each prefix is
unique. Whether a pair may stand is found by merging its two pieces once, and remembered.
Pieces have a blank only at their start, so words encode on their own. Runs of blanks, whose
pieces have equal scores, are merged one by one instead.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import give_back, map_columns

BLANK = "▁"
#: Words and pairs remembered by a Python worker; slots of its cache of pairs.
REMEMBERED, PAIRS, SLOTS = 150_000, 200_000, 1 << 20
#: Characters of text that a task encodes, and ids that it decodes, at once.
AT_ONCE = 1 << 19


class Vocabulary:
    """Pieces by id, with their kinds and scores."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str]) -> None:
        """kinds: n normal, b byte, c control, u unknown."""
        self.pieces, self.kinds = pieces, kinds
        self.ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == "n"}
        self.scores = scores
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == "b"}
        if any(BLANK in p.lstrip(BLANK) for p in self.ids):
            raise ValueError("a piece has a blank after its first letter")

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        return cls([m.id_to_piece(i) for i in range(n)], [m.get_score(i) for i in range(n)], ["b" if m.is_byte(i) else "c" if m.is_control(i) else "u" if m.is_unknown(i) else "n" for i in range(n)])

    def merge(self, text: str) -> list[str]:
        """BPE as defined: again and again the neighbours whose joined piece has the best score, the leftmost first."""
        part: list[str | None] = list(text)
        n = len(part)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if (i := self.ids.get(both := part[a] + part[b])) is not None:
                heapq.heappush(heap, (-self.scores[i], a, b, both))

        for a in range(n - 1):
            offer(a, a + 1)
        while heap:
            _, a, b, both = heapq.heappop(heap)
            if part[a] is None or part[b] is None or right[a] != b or part[a] + part[b] != both:
                continue
            part[a], part[b] = both, None
            right[a] = right[b]
            if right[a] < n:
                left[right[a]] = a
                offer(a, right[a])
            if left[a] >= 0:
                offer(left[a], a)
        return [p for p in part if p is not None]

    def to_ids(self, parts: list[str]) -> list[int]:
        """Ids of pieces; an unknown character gives its bytes, or the unknown id where the model has no bytes."""
        out: list[int] = []
        for p in parts:
            if (i := self.ids.get(p)) is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode()]
            else:
                out.append(self.kinds.index("u"))
        return out

    @cached_property
    def shapes(self) -> tuple[np.ndarray, ...]:
        """Ids of pieces that encode as themselves, their first 16 bytes as two big-endian numbers, their lengths in bytes and in characters, and all their bytes."""
        own = [(p, i) for p, i in self.ids.items() if self.merge(p) == [p]]
        raw = [p.encode() for p, _ in own]
        first = np.frombuffer(b"".join(r[:16].ljust(16, b"\0") for r in raw), ">u8").reshape(-1, 2).astype(np.uint64)
        return np.array([i for _, i in own], np.int64), first[:, 0], first[:, 1], np.array([len(r) for r in raw]), np.array([len(p) for p, _ in own]), raw

    def tail(self, n: int) -> np.ndarray:
        """Ones in all but the first n bytes of eight."""
        return np.where(n <= 0, ~np.uint64(0), (np.uint64(1) << ((8 - np.clip(n, 1, 8)) * 8).astype(np.uint64)) - np.uint64(1))


def occurrences(data: bytes, at: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Places of `at` (byte offsets in data) where pieces stand, and the row in vocabulary.shapes of each, found in the sorted suffixes."""
    _, high, low, size, _, raw = vocabulary.shapes
    x = np.frombuffer(data + bytes(16), np.uint8)
    keys = []
    for shift in (0, 8):
        k = np.zeros(len(at), np.uint64)
        for i in range(8):
            k = (k << np.uint64(8)) | x[at + shift + i]
        keys.append(k)
    order = np.lexsort((keys[1], keys[0]))
    a, b = keys[0][order], keys[1][order]
    last = vocabulary.tail(size)
    start, end = np.searchsorted(a, high, "left"), np.searchsorted(a, high | last, "right")
    more = np.flatnonzero((size > 8) & (start < end))
    upper = low[more] | vocabulary.tail(size[more] - 8)

    def search(value: np.ndarray, above: bool) -> np.ndarray:
        lo, hi = start[more].copy(), end[more].copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            v = b[np.minimum(mid, len(b) - 1)]
            right = open_ & ((v <= value) if above else (v < value))
            lo, hi = np.where(right, mid + 1, lo), np.where(open_ & ~right, mid, hi)
        return lo

    if len(more):
        start[more], end[more] = search(low[more], False), search(upper, True)
    long, true = np.flatnonzero((size > 16) & (start < end)), []
    for p in long.tolist():  # few pieces are so long: compare the rest; places between two true ones may share the 16 bytes only
        places = order[start[p] : end[p]]
        true.append(places[[data[at[q] : at[q] + size[p]] == raw[p] for q in places.tolist()]])
    start[long] = end[long] = 0
    n = end - start
    which = np.concatenate((np.repeat(np.arange(len(n)), n), np.repeat(long, [len(t) for t in true])))
    return np.concatenate((order[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())], *true)), which


class Encoder:
    """Encodes texts of one vocabulary and remembers words and pairs."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.unknown = len(vocabulary.pieces)  # stands for any unknown character in the lattice
        self.known_pairs: dict[int, bool] = {}
        self.slots = np.full(SLOTS, -1, np.int64)
        self.forget()

    def forget(self) -> None:
        self.words = _Numbers()
        self.flat, self.begin, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def may_follow(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether the two pieces stay apart when encoded together. -1 before: the start of a word."""
        out = (before == -1) | (before == self.unknown) | (piece == self.unknown)
        ask = np.flatnonzero(~out)
        pair = before[ask].astype(np.int64) * (self.unknown + 1) + piece[ask]
        slot = slots(pair)
        found = self.slots[slot]
        hit = (found >> 1) == pair
        for k in np.unique(pair[~hit]).tolist():
            if (ok := self.known_pairs.get(k)) is None:
                a, b = self.v.pieces[k // (self.unknown + 1)], self.v.pieces[k % (self.unknown + 1)]
                ok = self.known_pairs[k] = self.v.merge(a + b) == [a, b]
            self.slots[slots(np.array([k]))] = (k << 1) | ok
        found = self.slots[slot]
        late = np.flatnonzero((found >> 1) != pair)  # pairs that share a slot
        good = (found & 1).astype(bool)
        good[late] = [self.known_pairs[k] for k in pair[late].tolist()]
        out[ask] = good
        return out

    def lattice(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and the number of ids of each. Words have a blank at the start only."""
        data = "\0".join(words).encode() + b"\0"
        x = np.frombuffer(data, np.uint8)
        at = np.flatnonzero((x & 0xC0) != 0x80)  # starts of characters and the ends of words
        ends = np.flatnonzero(x[at] == 0)
        if len(ends) != len(words):
            raise ValueError("a word holds a zero byte")
        starts = np.concatenate(([0], ends[:-1] + 1))
        ids, _, _, _, chars, _ = self.v.shapes
        src, which = occurrences(data, at, self.v)
        src, piece, width = src.astype(np.int32), ids[which].astype(np.int32), chars[which].astype(np.int32)
        del which
        covered = np.zeros(len(at), bool)
        covered[src[width == 1]] = True
        covered[ends] = True
        lone = np.flatnonzero(~covered)
        wide = width > 1  # from the place behind its first letter to its last letter, an edge crosses
        crossed = np.cumsum(np.bincount(src[wide] + 1, minlength=len(at) + 1) - np.bincount(src[wide] + width[wide], minlength=len(at) + 1))[: len(at)] > 0
        begins = ~crossed
        begins[ends] = False
        first = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))  # where each place's part begins
        src, piece, width = np.concatenate((src, lone.astype(np.int32))), np.concatenate((piece, np.full(len(lone), self.unknown, np.int32))), np.concatenate((width, np.ones(len(lone), np.int32)))
        end = (src - first[src]).astype(np.int32) + width  # place of its end in the part
        by_end = np.argsort(end, kind="stable")
        src, piece, width, end = src[by_end], piece[by_end], width[by_end], end[by_end]
        del by_end
        cuts = np.searchsorted(end, np.arange(1, int(end[-1]) + 2 if len(end) else 1))
        last, back = np.full(len(at), -2, np.int32), np.zeros(len(at), np.int32)
        for i, j in zip(cuts, cuts[1:], strict=False):
            s, p = src[i:j], piece[i:j]
            before = np.where(begins[s], -1, last[s])
            live = before != -2
            s, p, w, before = s[live], p[live], width[i:j][live], before[live]
            fits = self.may_follow(before, p)
            last[s[fits] + w[fits]], back[s[fits] + w[fits]] = p[fits], s[fits]
        node = np.concatenate((np.flatnonzero(begins), ends))  # the ends of parts
        node = node[~np.isin(node, starts)]
        rows = [(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        while len(node):
            if (last[node] == -2).any():
                raise AssertionError("a word has no encoding")
            rows.append((last[node], at[node], at[back[node]]))
            node = back[node]
            node = node[~begins[node]]
        tokens, to, frm = (np.concatenate(c) for c in zip(*rows, strict=True))
        order = np.argsort(frm)
        tokens, to, frm = tokens[order], to[order], frm[order]
        owner = np.searchsorted(at[ends], frm)
        n = np.ones(len(tokens), np.int64)
        odd = tokens == self.unknown
        if odd.any():
            byte_ids = np.array([self.v.bytes.get(i, -1) for i in range(256)]) if self.v.bytes else None
            if byte_ids is None:
                tokens[odd] = self.v.kinds.index("u")
            else:
                n[odd] = (to - frm)[odd]
                at_byte = np.repeat(frm, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                tokens = np.where(np.repeat(odd, n), byte_ids[x[at_byte]], np.repeat(tokens, n))
        return tokens.astype(np.int32), np.bincount(owner, weights=n, minlength=len(words)).astype(np.int64)

    def learn(self, new: list[str]) -> None:
        """Encode words that are not known yet, in the order of their numbers."""
        plain = np.array([w != "" and w[1:2] != BLANK and "\0" not in w for w in new], bool)
        begin, size = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        flat = np.zeros(0, np.int32)
        if plain.any():
            flat, size[plain] = self.lattice([w for w, ok in zip(new, plain.tolist(), strict=True) if ok])
        odd = [self.v.to_ids(self.v.merge(new[i])) for i in np.flatnonzero(~plain).tolist()]
        size[~plain] = [len(x) for x in odd]
        ends = np.cumsum(np.concatenate((size[plain], size[~plain])))
        begin[plain], begin[~plain] = np.split(ends - np.concatenate((size[plain], size[~plain])), [int(plain.sum())])
        self.begin, self.size = np.concatenate((self.begin, begin + len(self.flat))), np.concatenate((self.size, size))
        self.flat = np.concatenate([self.flat, flat, *[np.array(x, np.int32) for x in odd]])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each."""
        if len(self.words) > REMEMBERED:
            self.forget()
        if len(self.known_pairs) > PAIRS:
            self.known_pairs.clear()
            self.slots.fill(-1)
        rows = []
        for t in texts:
            units = units_of(t or "")
            rows.append(np.fromiter(map(self.words.__getitem__, units), np.int64, len(units)))
        if new := self.words.new:
            self.learn(new)
            self.words.new = []
        w = np.concatenate([np.zeros(0, np.int64), *rows])
        n = self.size[w]
        ids = self.flat[np.repeat(self.begin[w] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        ends = np.concatenate(([0], np.cumsum(n)))
        return ids, np.diff(ends[np.cumsum([0, *map(len, rows)])])


class _Numbers(dict):
    """Numbers words as they come; new: the words that came since it was emptied."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


def slots(pair: np.ndarray) -> np.ndarray:
    """Places of pairs in the cache."""
    return ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


def units_of(text: str) -> list[str]:
    """Words with the blank before them. Blanks in a row are kept with the word that follows."""
    if not text:
        return []
    words = text.replace(BLANK, " ").split(" ")
    if "" not in words:
        return [BLANK + w for w in words]
    units, blanks = [], ""
    for w in words:
        blanks += BLANK
        if w:
            units.append(blanks + w)
            blanks = ""
    return units + [blanks] * bool(blanks)


@cache
def vocabulary(path: str) -> Vocabulary:
    """This process's vocabulary of the model file."""
    return Vocabulary.load(path)


@cache
def encoder(path: str) -> Encoder:
    """This process's encoder of the model file."""
    return Encoder(vocabulary(path))


def runs(sizes: np.ndarray, most: int = AT_ONCE) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows that hold `most` in all, or a single row."""
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        held += n
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def encode(docs: DataFrame, path: str, carry: list[Column], text: str = "text", with_decoded: bool = False) -> DataFrame:
    """The carried columns and ids (array<int>); with_decoded also the text that these ids decode to, from the same Python worker.

    path: the model file, at the same place on every executor. A null text has no ids and decodes to the empty text.
    """
    kept = docs.select(*carry).schema
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            for a, b in runs(pc.fill_null(pc.utf8_length(batch.column(0)), 0).to_numpy(zero_copy_only=False)):
                some = batch.slice(a, b - a)
                ids, n = e.encode(some.column(0).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(ids, pa.int32()))
                more = [pa.array(decoded(ids, n, e.v), pa.string())] if with_decoded else []
                yield pa.RecordBatch.from_arrays([*some.columns[1:], lists, *more], names=[*names, "ids", *["decoded"] * with_decoded])
        e.forget()  # the worker may wait long for its next task
        give_back()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.select(F.col(text), *carry).mapInArrow(run, f"{schema}, ids array<int>" + ", decoded string" * with_decoded)


def decoded(ids: np.ndarray, n: np.ndarray, v: Vocabulary) -> list[str]:
    """Texts of rows of ids: the pieces' bytes in a row, blanks for their marks, without the first blank."""
    raw = [bytes([int(p[3:5], 16)]) if k == "b" else b"" if k == "c" else p.encode() for p, k in zip(v.pieces, v.kinds, strict=True)]
    size = np.array([len(r) for r in raw])
    start = np.cumsum(size) - size
    pool = np.frombuffer(b"".join(raw), np.uint8)
    many = size[ids]
    data = pool[np.repeat(start[ids] - (np.cumsum(many) - many), many) + np.arange(many.sum())].tobytes()
    ends = np.concatenate(([0], np.cumsum(many)))[np.concatenate(([0], np.cumsum(n)))].tolist()
    texts = (data[a:b].decode("utf-8", "replace").replace(BLANK, " ") for a, b in zip(ends, ends[1:], strict=False))
    return [t[1:] if t.startswith(" ") else t for t in texts]


def decode(encoded: DataFrame, path: str, carry: list[Column], ids: str = "ids") -> DataFrame:
    """The carried columns and decoded (string)."""
    kept = encoded.select(*carry).schema
    names = [f.name for f in kept]

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for a, b in runs(np.diff(batch.column(0).offsets.to_numpy())):
            some = batch.slice(a, b - a)
            lists = some.column(0)
            flat, n = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
            yield pa.RecordBatch.from_arrays([*some.columns[1:], pa.array(decoded(flat, n, v), pa.string())], names=[*names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return map_columns(encoded, [F.col(ids), *carry], f"{schema}, decoded string", step)


def encode_and_decode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids, decoded and round_trip (whether decoding gives the text; U+2581 comes back as a blank).

    A null or empty text has no ids and decodes to the empty text. Rows may repeat;
    other columns are neither read nor returned. An empty table gives no rows.
    """
    rows = encode(docs, path, [F.col(doc_id).alias("doc_id"), F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("_sha")], text, with_decoded=True)
    return rows.select("doc_id", "ids", "decoded", (F.sha2(F.col("decoded").cast("binary"), 256) == F.col("_sha")).alias("round_trip"))
