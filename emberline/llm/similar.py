"""Texts whose sets of word shingles have a given Jaccard similarity: all pairs, exactly, without comparing all pairs.

Shingles are ordered, common ones last (by a table of counts over all documents; any order is exact, this one is fast). Two
sets of similarity 0.8 share a shingle within the first fifth of both, their prefixes, so that only
texts that share a bucket (a shingle of their prefixes) can be linked. A bucket is first compared with one centre, in a
few rounds with other centres, and then only texts that aren't connected yet, so
that a large group of near copies doesn't cost all its pairs. The first centre is the set most of whose prefix others
share, which is the common original where there is one. A pair's prefixes are compared before its sets
are. Sets are known by a 64-bit hash, their key; equal sets are one node.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import as_bytes, compact, map_columns, parts, small, text_of
from emberline.llm.graph import components
from emberline.llm.shingles import SEED, fingerprints, hashes

#: Counters of shingles, the slices in which tasks send them, and the bits of a shingle's hash by which buckets are formed (the rest decides nothing there: sets are compared whole).
SLOTS, SLICES, BITS = 1 << 20, 64, 48
#: Rounds with a centre for each bucket; bytes of text that a task hashes at once; rows of a number or two that may be broadcast.
ROUNDS, AT_ONCE, NODES = 1, 1 << 22, 500_000


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def slot(h: np.ndarray) -> np.ndarray:
    return (h.view(np.uint64) % np.uint64(SLOTS)).astype(np.int64)


def commonness(docs: DataFrame, text: str, width: int) -> np.ndarray:
    """By slot: four times the binary logarithm of how often shingles of that slot occur in all documents, each text counted once.

    Each task adds up its texts' counters and sends them in slices; a slice is added up in one stream. What comes to the
    driver is SLOTS numbers, whatever the input.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SLOTS, np.uint32)
        for batch in batches:
            texts = as_bytes(batch.column(0))
            for a, b in parts(texts, AT_ONCE):
                n += np.bincount(slot(np.concatenate([np.unique(hashes(t, width)) for t in texts[a:b]])), minlength=SLOTS).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([x.tobytes() for x in np.split(n, SLICES)], pa.binary())], names=["slice", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(n, np.uint32).astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["slice", "n"])

    counted = docs.select(text_of(text)).mapInArrow(count, "slice int, n binary").repartition(SLICES, "slice").mapInArrow(add, "slice int, n binary")
    out = np.zeros((SLICES, SLOTS // SLICES))
    for r in counted.collect():  # SLICES rows
        out[r["slice"]] = np.frombuffer(r["n"], np.uint64)
    return np.floor(4 * np.log2(out.ravel() + 1)).astype(np.uint8)


def lists(sets: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))


def key_of(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), SEED)


def keys_of(sets: list[np.ndarray]) -> pa.Array:
    return pa.array(np.array([key_of(s) for s in sets], np.uint64).view(np.int64))


def print_table(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """doc_id, text_hash, fp and key of each row."""
    kind = docs.select(doc_id).schema[0].dataType.simpleString()

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = as_bytes(batch.column(2))
        for a, b in parts(texts, AT_ONCE):
            every = [hashes(t, width) for t in texts[a:b]]
            columns = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(fingerprints(every, len(every))), keys_of([np.unique(h.view(np.int64)) for h in every])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "fp", "key"])

    return map_columns(docs, [F.col(doc_id).alias("doc_id"), text_hash(F.col(text)).alias("text_hash"), F.col(text).alias("text")], f"doc_id {kind}, text_hash long, fp long, key long", step)


def prefix_table(docs: DataFrame, text: str, width: int, share: Fraction, common: np.ndarray) -> DataFrame:
    """key, n (shingles) and prefix of each row's set, by the order of commonness()."""

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = as_bytes(batch.column(0))
        for a, b in parts(texts, AT_ONCE):
            sets = [np.unique(hashes(t, width).view(np.int64)) for t in texts[a:b]]
            first = [s[np.argsort(common[slot(s)], kind="stable")[: len(s) - needed(len(s), share) + 1]] & ((1 << BITS) - 1) if len(s) else s for s in sets]
            yield pa.RecordBatch.from_arrays([keys_of(sets), pa.array([len(s) for s in sets], pa.int32()), lists(first)], names=["key", "n", "prefix"])

    return map_columns(docs, [F.col(text)], "key long, n int, prefix array<long>", step)


def needed(n: int | Column, share: Fraction) -> int | Column:
    """Shingles that a set of n has at least in common with another of that similarity."""
    up = n * share.numerator + share.denominator - 1
    return F.floor(up / share.denominator).cast("int") if isinstance(n, Column) else up // share.denominator


def band(n: Column) -> Column:
    """A number that grows with the size n: the sizes up to 16 one by one, then in steps of a tenth."""
    return F.when(n <= 16, n).otherwise(17 + F.floor(F.log(n / 16) / F.log(F.lit(1.1)))).cast("int")


def rooted(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return rows.withColumn("root", F.col("node"))
    return rows.join(small(roots, roots.count(), NODES), "node", "left").withColumn("root", F.coalesce("root", "node"))


class Search:
    """The search for all links of one table. prints: doc_id, text_hash, fp and node of each row; points: a row for each distinct set."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str, width: int, share: Fraction) -> None:
        self.docs, self.text, self.width, self.share = docs, text, width, share
        rows, _ = compact(print_table(docs, doc_id, text, width))
        self.points, self.many = compact(self.distinct_sets(rows).withColumn("node", F.monotonically_increasing_id()), F.size("prefix") + 3)
        placed = rows.groupBy("key").agg(F.min("text_hash").alias("text_hash"), F.min("fp").alias("fp")).join(self.points.select("key", "node", "n"), "key")
        self.places, _ = compact(placed)
        self.prints = rows.join(self.places.select("key", "node"), "key").drop("key")

    def distinct_sets(self, rows: DataFrame) -> DataFrame:
        """key, n and prefix of each distinct set. Only sets that several rows have are shuffled, unless their texts are too many for a broadcast."""
        common = commonness(self.docs, self.text, self.width)
        again = rows.groupBy("key").count().where("count > 1").select("key")
        texts, n = compact(rows.join(again, "key", "left_semi").select("text_hash").distinct())
        one = lambda docs: prefix_table(docs, self.text, self.width, self.share, common).groupBy("key").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
        if n > NODES:
            return one(self.docs)
        named = self.docs.select(text_hash(F.col(self.text)).alias("text_hash"), F.col(self.text))
        alone = prefix_table(named.join(small(texts, n, NODES), "text_hash", "left_anti"), self.text, self.width, self.share, common)
        return alone.unionByName(one(named.join(small(texts, n, NODES), "text_hash", "left_semi"))) if n else alone

    def reaches(self, both: Column, n: Column, m: Column) -> Column:
        """Whether sets of n and m shingles with `both` in common are as similar."""
        return both * (self.share.numerator + self.share.denominator) >= (n + m) * self.share.numerator

    def alike(self, n: Column, m: Column) -> Column:
        """Whether the sizes allow it."""
        return F.least(n, m) * self.share.denominator >= F.greatest(n, m) * self.share.numerator

    def may_reach(self, shared: Column, n: Column, m: Column) -> Column:
        """Whether sets with so many shingles in both prefixes can be: the others in common lie behind one of the two prefixes."""
        return self.reaches(shared + needed(F.greatest(n, m), self.share) - 1, n, m)

    def sets(self, nodes: DataFrame) -> DataFrame:
        """node and set of these nodes, from one text of each."""
        width = self.width
        nodes, n = compact(nodes.distinct())
        wanted, n = compact(self.places.join(small(nodes, n, NODES), "node", "left_semi").select("key", "node", "text_hash"))
        texts = self.docs.select(text_hash(F.col(self.text)).alias("text_hash"), F.col(self.text).alias("text"))

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts = as_bytes(batch.column(0))
            for a, b in parts(texts, AT_ONCE):
                sets = [np.unique(hashes(t, width).view(np.int64)) for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays([keys_of(sets), lists(sets)], names=["key", "set"])

        made = map_columns(texts.join(small(wanted.select("text_hash"), n, NODES), "text_hash", "left_semi"), [F.col("text")], "key long, set array<long>", step)
        return compact(made.join(small(wanted.select("key", "node"), n, NODES), "key").select("node", "set").dropDuplicates(["node"]), F.size("set") + 2)[0]

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs of nodes u, v that are similar, as links. Prefixes are compared first; only sets of pairs that pass are made and moved."""
        pairs, n_pairs = compact(pairs.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        if not n_pairs:
            return pairs

        def sides(table: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
            return tuple(table.select(F.col("node").alias(c), *[F.col(x).alias(f"_{x}_{c}") for x in columns]) for c in "uv")

        nodes, n_nodes = compact(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct())
        a, b = sides(self.points.join(small(nodes, n_nodes, NODES), "node", "left_semi"), ["n", "prefix"])
        n, m = F.col("_n_u"), F.col("_n_v")
        near = pairs.repartition("u").join(a, "u").join(b, "v").where(self.alike(n, m)).where(self.may_reach(F.size(F.array_intersect("_prefix_u", "_prefix_v")), n, m))
        near, n_near = compact(near.select("u", "v"))
        if not n_near:
            return near
        a, b = sides(self.sets(near.select(F.explode(F.array("u", "v")).alias("node"))), ["set"])
        both = near.repartition("u").join(a, "u").join(b, "v")
        return compact(both.where(self.reaches(F.size(F.array_intersect("_set_u", "_set_v")), F.size("_set_u"), F.size("_set_v"))).select("u", "v"))[0]

    def leads(self, i: Column, n: Column, both: Column) -> Column:
        """Whether place i of a set of n lies in what must share a shingle with a set that has `both` - n: two sets that are similar share one within n less the shingles that they need in common, and one more."""
        up = both * self.share.numerator + (self.share.numerator + self.share.denominator - 1)
        return i <= n - F.floor(up / (self.share.numerator + self.share.denominator))

    def partners(self, rows: DataFrame) -> DataFrame:
        """Rows (n, i) for each band of sizes that a similar set can have whose first common shingle is this one; none if it lies too far behind."""
        n, d = self.share.numerator, self.share.denominator
        most = F.least(F.floor(F.col("n") * d / n), F.floor((F.col("n") - F.col("i")) * (n + d) / n) - F.col("n"))
        low, high = band(needed(F.col("n"), self.share)), band(most)
        return rows.where(most >= needed(F.col("n"), self.share)).withColumn("band", F.explode(F.sequence(low, high)))

    def buckets(self) -> DataFrame:
        """h, node, i, n and lone: the shingles of prefixes that several nodes have, and their places in them; lone is the share of the node's prefix that no other has."""
        first = self.points.select("node", F.posexplode("prefix").alias("i", "h"))
        shared = first.groupBy("h").count().where("count > 1").select("h")
        met, _ = compact(first.join(shared, "h").select("h", "node", "i"))
        held = met.groupBy("node").count().join(self.points.select("node", "n", F.size("prefix").alias("_p")), "node").select("node", "n", (1 - F.col("count") / F.col("_p")).cast("float").alias("lone"))
        return compact(met.join(small(held, self.many, NODES), "node"))[0]

    def complete(self, links: DataFrame) -> DataFrame:
        """node and root, for every node that isn't the smallest of those it is connected with; links has links that are known."""
        met = self.buckets()
        roots = components(links) if not links.isEmpty() else None
        for k in range(ROUNDS + 1):
            rows = rooted(met, roots)
            place = F.struct(F.col("lone") if k == 0 else F.lit(0), F.xxhash64("node", F.lit(k)))
            centres = rows.groupBy("h").agg(F.min_by(F.struct("node", "n", "root"), place).alias("_c"))
            rows = rows.join(centres.select("h", F.col("_c.node").alias("c"), F.col("_c.n").alias("c_n"), F.col("_c.root").alias("c_root")), "h")
            apart = rows.where("root != c_root")
            n, m = F.col("n"), F.col("m")
            if k < ROUNDS:  # one centre for a node: the one of most of its buckets
                votes = apart.where(self.alike(n, F.col("c_n"))).groupBy("node", "c").count()
                found = votes.groupBy("node").agg(F.max_by("c", F.struct("count", "c")).alias("v")).select(F.col("node").alias("u"), "v")
            else:  # all that aren't connected yet; at least one of the two isn't connected with the centre
                other = rows.select("h", band(F.col("n")).alias("band"), F.col("node").alias("v"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("root").alias("_root"), (F.col("root") == F.col("c_root")).alias("_near"))
                pair = self.partners(apart).join(other, ["h", "band"]).where((F.col("root") != F.col("_root")) & (F.col("_near") | (F.col("node") < F.col("v"))))
                found = pair.where(self.alike(n, m) & self.leads(F.col("i"), n, n + m) & self.leads(F.col("j"), m, n + m)).select(F.col("node").alias("u"), "v")
            new = self.verified(found)
            if not new.isEmpty():
                links = links.union(new)
                roots = components(links)
        return roots if roots is not None else links.select(F.col("u").alias("node"), F.col("v").alias("root"))
