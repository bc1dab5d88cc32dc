"""Alignment of two tokenizers' tokens over the same bytes, and how well their ids correspond over all documents.

Both encodings of a text are complete before they are compared. Where tokens of both end at the same byte and the next tokens
begin with a blank, the text is cut: between two such anchors lies a window, a row of ids on either side. What a window
aligns to depends on its ids alone, so it is worked out once, with all new windows of a batch, and remembered by the tuple of its ids.

Over the corpus each id pair is counted by the documents that link it. Counts are added up within tasks before they are
moved. For a document's sums the commonest pairs, a bounded number, are sent to all tasks; the others, none of which is in
more documents than these, meet their counts by a shuffle. Both ways give the same sums.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm import bpe, pieces
from emberline.llm.common import map_columns, materialize
from emberline.storage import scratch

#: Bytes of text that a task aligns at once; windows that a Python worker remembers.
AT_ONCE, WINDOWS = 1 << 20, 150_000
#: Pairs that are broadcast at most (some 20 MB), and steps of a factor of two in which their least count is chosen.
HOT, FINE = 1 << 18, 8
ID_BITS = 20
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


@contextmanager
def uncollected() -> Iterator[None]:
    """Without the cycle collector: hundreds of thousands of remembered tuples hold no cycles, but are searched for them again and again, a tenth of the time."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class Windows(dict):
    """Alignments of windows by their ids: (ids of A, ids of B) as bytes gives a window's number."""

    def __init__(self, a_size: np.ndarray, b_size: np.ndarray) -> None:
        super().__init__()
        self.a_size, self.b_size = a_size, b_size
        self.decimal = bpe.Offsets([b"%d," % i for i in range(max(len(a_size), len(b_size)))])
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[tuple[bytes, bytes]] = []
        self.texts: list[str] = []
        self.groups, self.links, self.sizes, self.pairs, self.many = (np.zeros(0, np.int64) for _ in range(5))
        self.uses = np.zeros(0, np.int64)

    def used(self, found: np.ndarray) -> None:
        self.uses = np.bincount(found, minlength=len(self.texts)) + np.pad(self.uses, (0, len(self.texts) - len(self.uses)))

    def trim(self, most: int) -> None:
        """Keep the windows used most, half of `most`, and halve what their uses count."""
        if len(self.texts) <= most:
            return
        at = np.sort(np.argsort(-self.uses, kind="stable")[: most // 2])
        keys = list(self)  # in the order of their numbers
        size = self.sizes
        k = size[at]
        flat = np.repeat((np.cumsum(size) - size)[at] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        keys, texts, uses = [keys[i] for i in at.tolist()], [self.texts[i] for i in at.tolist()], self.uses[at] // 2
        self.clear()
        self.update(zip(keys, range(len(keys)), strict=True))
        self.texts, self.uses = texts, uses
        self.groups, self.links, self.sizes, self.pairs, self.many = self.groups[at], self.links[at], k, self.pairs[flat], self.many[flat]

    def __missing__(self, key: tuple[bytes, bytes]) -> int:
        """Number a new window; learn() aligns it."""
        n = self[key] = len(self)
        self.new.append(key)
        return n

    def learn(self) -> None:
        """Cut the new windows, all at once, where tokens of both sides end together, and link all tokens within a cut."""
        if not self.new:
            return
        a, b = (np.frombuffer(b"".join([k[side] for k in self.new]), np.int32) for side in (0, 1))
        n_b = np.array([len(k[1]) // 4 for k in self.new])
        self.new = []
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        ends = np.zeros(b_end[-1] + 1, np.uint8)
        ends[a_end] = 1
        ends[b_end] |= 2
        shared = np.cumsum(ends == 3)
        a_group, b_group = shared[a_end - 1], shared[b_end - 1]
        in_a, in_b = np.bincount(a_group), np.bincount(b_group)
        a_to, b_to = np.cumsum(in_a), np.cumsum(in_b)
        window_end = np.cumsum(n_b)  # of the tokens of B
        group_to = b_group[window_end - 1] + 1
        groups = np.diff(group_to, prepend=0)
        # the ids of a group, A's before B's, each with the mark behind it
        ids = np.empty(len(a) + len(b), np.int64)
        ids[np.arange(len(a)) + (b_to - in_b)[a_group]] = a
        ids[np.arange(len(b)) + a_to[b_group]] = b
        spelled = np.frombuffer(bytearray(self.decimal.joined(ids)), np.uint8)
        to = np.cumsum(self.decimal.size[ids])
        spelled[to[a_to + b_to - in_b - 1] - 1] = ord("|")
        spelled[to[a_to + b_to - 1] - 1] = ord(";")
        text, to = spelled.tobytes().decode(), to[(a_to + b_to)[group_to - 1] - 1].tolist()
        self.texts += [text[i : j - 1] for i, j in zip([0, *to], to, strict=False)]
        # distinct pairs of each window
        k = in_b[a_group]
        right = np.repeat((b_to - in_b)[a_group] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        pair = np.repeat(a.astype(np.int64), k) << ID_BITS | b[right]
        window = np.repeat(np.arange(len(n_b)), groups)[np.repeat(a_group, k)]
        by = np.lexsort((pair, window))
        pair, window = pair[by], window[by]
        first = np.flatnonzero((np.diff(pair, prepend=-1) != 0) | (np.diff(window, prepend=-1) != 0))
        made = groups, np.bincount(window), np.bincount(window[first]), pair[first], np.diff(first, append=len(pair))
        self.groups, self.links, self.sizes, self.pairs, self.many = (np.concatenate(x) for x in zip((self.groups, self.links, self.sizes, self.pairs, self.many), made, strict=True))


class Bytes(bpe.Tokenizer):
    """Side A: units of text, each encoded once by a library. Ids of merged tokens must rise in the order of merges."""

    def __init__(self, path: str) -> None:
        import tiktoken

        super().__init__(path, specials=False)
        if self.raw is None:
            raise ValueError("side A must be a byte-level vocabulary without marks of word ends")
        vocab = self.model["vocab"]
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in self.model["merges"]]
        if made != sorted(made) or min(made, default=256) < 256:
            raise ValueError("ids of side A don't rise in the order of merges")
        ranks = {t.translate(self.back).encode("latin-1"): i for t, i in vocab.items()}
        self.fast = tiktoken.Encoding("side A", pat_str=self.pattern.pattern, mergeable_ranks=ranks, special_tokens={})
        self.model = {}

    def encode_unit(self, unit: str) -> list[int]:
        return self.fast.encode_ordinary(unit)

    def by_library(self, text: str) -> list[int]:
        self.library.encode_special_tokens = True
        return self.library.encode(text, add_special_tokens=False).ids


class Units(pieces.Encoder):
    """Side B: words with the blanks before them, each encoded once by the library; neighbouring words encode on their own."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        super().__init__(pieces.vocabulary(path))
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def learn(self, new: list[str]) -> None:
        rows = self.model.encode([w[1:] for w in new], num_threads=1)  # the library puts a blank before a text, unless it is empty
        rows = [r if len(w) > 1 else self.v.to_ids([w]) for w, r in zip(new, rows, strict=True)]
        size = np.array([len(r) for r in rows], np.int64)
        self.begin, self.size = np.concatenate((self.begin, len(self.flat) + np.cumsum(size) - size)), np.concatenate((self.size, size))
        self.flat = np.concatenate([self.flat, np.fromiter((i for r in rows for i in r), np.int32, int(size.sum()))])


class Aligner:
    """Encodes and aligns texts. side A: a byte-level BPE of a tokenizers file over blank + text; side B: a SentencePiece model, which adds the blank."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.a, self.b = Bytes(a_path), Units(b_path)
        v = self.b.v
        raw = [bytes([int(p[3:5], 16)]) if k == "b" else b"" if k == "c" else p.replace(pieces.BLANK, " ").encode() for p, k in zip(v.pieces, v.kinds, strict=True)]
        self.a_bytes, self.b_bytes = bpe.Offsets(self.a.raw), bpe.Offsets(raw)
        if max(len(self.a.raw), len(raw)) > 1 << ID_BITS:
            raise ValueError("a vocabulary has too many ids")
        self.windows = Windows(self.a_bytes.size, self.b_bytes.size)

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """Ids of both sides in a row, and how many each text has: none where the joined bytes of a side aren't blank + text."""
        a, n_a = self.a.encode([" " + t if t else "" for t in texts])
        b, n_b = self.b.encode(texts)
        whole = [(" " + t).encode() if t else b"" for t in texts]
        lossless = np.ones(len(texts), bool)
        for ids, n, table in ((a, n_a, self.a_bytes), (b, n_b, self.b_bytes)):
            if table.joined(ids) != b"".join(whole):
                lossless &= np.array([x == y for x, y in zip(table.texts(ids, n), whole, strict=True)], bool)
        if not lossless.all():
            a, b = a[np.repeat(lossless, n_a)], b[np.repeat(lossless, n_b)]
            n_a, n_b = n_a * lossless, n_b * lossless
            whole = [w if ok else b"" for w, ok in zip(whole, lossless.tolist(), strict=True)]
        return a.astype(np.int32), n_a, b.astype(np.int32), n_b, np.frombuffer(b"".join(whole), np.uint8), np.array([len(w) for w in whole])

    def cut(self, a: np.ndarray, b: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where windows end: places in a, places in b, and bytes."""
        a_end, b_end = np.cumsum(self.a_bytes.size[a]), np.cumsum(self.b_bytes.size[b])
        ends = np.zeros(len(data) + 1, np.uint8)
        ends[a_end] = 1
        ends[b_end] |= 2
        anchor = (ends == 3) & np.append(data == 0x20, False)
        anchor[np.cumsum(sizes)] = True  # texts end; those without tokens end where the one before does
        anchor[0] = False
        at = np.flatnonzero(anchor)
        return np.searchsorted(a_end, at, "right"), np.searchsorted(b_end, at, "right"), at

    @uncollected()
    def align(self, texts: list[str]) -> dict[str, list | np.ndarray]:
        """Of each text: counts, the digest of its groups, and its distinct pairs with how many links each has."""
        w = self.windows
        w.trim(WINDOWS)
        a, n_a, b, n_b, data, sizes = self.tokens(texts)
        a_at, b_at, at = self.cut(a, b, data, sizes)
        raw_a, raw_b = a.tobytes(), b.tobytes()
        a_to, b_to = (4 * a_at).tolist(), (4 * b_at).tolist()
        found = np.fromiter((w[raw_a[i:j], raw_b[k:m]] for i, j, k, m in zip([0, *a_to], a_to, [0, *b_to], b_to, strict=False)), np.int64, len(at))
        w.learn()
        w.used(found)
        last = np.searchsorted(at, np.cumsum(sizes), "right")  # windows up to each text's end
        first = np.concatenate(([0], last[:-1]))
        owner = np.repeat(np.arange(len(texts)), last - first)
        total = lambda x: np.bincount(owner, weights=x[found], minlength=len(texts)).astype(np.int64)
        spelled = [w.texts[i] for i in found.tolist()]
        shas = [hashlib.sha256(";".join(spelled[i:j]).encode()).hexdigest() if j > i else "" for i, j in zip(first.tolist(), last.tolist(), strict=True)]
        # distinct windows of each text, then their pairs
        keys, many = np.unique(owner << 32 | found, return_counts=True)
        doc, win = keys >> 32, keys & 0xFFFFFFFF
        size = w.sizes
        begin = (np.cumsum(size) - size)[win]
        k = size[win]
        flat = np.repeat(begin - (np.cumsum(k) - k), k) + np.arange(k.sum())
        pair = w.pairs[flat]
        links = w.many[flat] * np.repeat(many, k)
        by = np.lexsort((pair, doc := np.repeat(doc, k)))
        pair, doc, links = pair[by], doc[by], links[by]
        new = np.flatnonzero(np.concatenate(([True], (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])))) if len(pair) else np.zeros(0, np.int64)
        sums = np.add.reduceat(links, new) if len(new) else links
        return {"n_a": n_a, "n_b": n_b, "n_groups": total(w.groups), "n_links": total(w.links), "groups_sha256": shas, "pair": pair[new], "links": sums, "n_pairs": np.bincount(doc[new], minlength=len(texts))}


@cache
def aligner(a_path: str, b_path: str) -> Aligner:
    """This process's aligner of the two files."""
    return Aligner(a_path, b_path)


def aligned(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and pairs (array of a, b, n: distinct id pairs and their links) of each row.

    row tells rows apart; it holds for this table only, so write it before it is used twice.
    """
    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    names = ["row", "doc_id", *COUNTS, "groups_sha256", "pairs"]
    struct = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int32())])

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, j in pieces.runs(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False), AT_ONCE):
            out = aligner(a_path, b_path).align([t or "" for t in batch.column(2).slice(i, j - i).to_pylist()])
            values = [out["pair"] >> ID_BITS, out["pair"] & ((1 << ID_BITS) - 1), out["links"]]
            flat = pa.StructArray.from_arrays([pa.array(v, pa.int32()) for v in values], fields=list(struct))
            pairs = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(out["n_pairs"]))), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *[pa.array(out[c], pa.int64()) for c in COUNTS], pa.array(out["groups_sha256"], pa.string()), pairs], names=names)

    schema = f"row long, doc_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string, pairs array<struct<a:int,b:int,n:int>>"
    return map_columns(docs, [F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text")], schema, step)


def pair_counts(links: DataFrame) -> DataFrame:
    """a, b, count (rows of links, one for each document and pair) and best: whether a has no pair of a higher count."""
    counts = materialize(links.groupBy("a", "b").agg(F.count(F.lit(1)).alias("count")))
    highest = counts.groupBy("a").agg(F.max("count").alias("_most"))  # a row for each id of A: as many as its vocabulary has at most
    return counts.join(F.broadcast(highest), "a").select("a", "b", "count", (F.col("count") == F.col("_most")).alias("best"))


def hot_from(counts: DataFrame, most: int) -> int:
    """The least count from which on no more than `most` pairs are; from a histogram of counts in fine steps."""
    step = F.floor(FINE * F.log2("count")).cast("int")
    seen = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("count").alias("least")).collect()  # a few hundred rows
    least, held = None, 0
    for r in sorted(seen, key=lambda r: -r["step"]):
        held += r["n"]
        if held > most:
            break
        least = r["least"]
    return least if least is not None else 1 << 62


def correspondence(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row.

    A pair's count is the number of rows that link it; n_best are a row's links whose count is the highest that their A id has, count_sum
    the sum of counts over its links. A text that is null, empty, or that a side doesn't give back byte for byte has zeros and an
    empty digest. Rows may repeat, also with the same id, and each counts; other columns are neither read nor returned. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "alignment")
    aligned(docs, a_path, b_path, doc_id, text).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    links = rows.select("row", F.inline("pairs"))
    pair_counts(links).write.parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts")
    least = hot_from(counts, hot)
    common, rare = F.broadcast(counts.where(F.col("count") >= least)), counts.where(F.col("count") < least)
    sums = [F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum")]
    by_all = links.join(common, ["a", "b"]).groupBy("row").agg(*sums)
    by_shuffle = links.join(common, ["a", "b"], "left_anti").join(rare, ["a", "b"]).groupBy("row").agg(*sums)
    both = by_all.unionByName(by_shuffle).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = rows.drop("pairs").join(both, "row", "left")
    return out.select("doc_id", *COUNTS, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")], "groups_sha256")
