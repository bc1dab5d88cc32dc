"""SimHash near duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the radius. Two fingerprints
within the radius meet at a variant; a variant has at most as many fingerprints as a
ball has points (65 for radius 2), so no group grows with the data. Copies of a text share a
fingerprint and are one node.

With a similarity, fingerprints only propose: a pair is linked if its sets of shingles have that Jaccard
similarity, and the pairs that lie beyond the radius (at a similarity of 0.8 nearly all do: ten bits of 64 differ, and the
balls of that radius can't be listed) are completed by an exact search, see similar.py.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberline.llm import similar
from emberline.llm.common import as_bytes, compact, map_columns, materialize, small
from emberline.llm.graph import components
from emberline.llm.shingles import fingerprints, hashes


def fingerprint_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """doc_id and fp (long)."""
    kind = docs.select(doc_id).schema[0].dataType.simpleString()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = as_bytes(batch.column(1))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints((hashes(t, width) for t in texts), len(texts)))], names=["doc_id", "fp"])

    return map_columns(docs, [F.col(doc_id).alias("doc_id"), F.col(text).alias("text")], f"doc_id {kind}, fp long", step)


def balls(radius: int) -> list[int]:
    """Masks of at most radius bits, as signed integers."""
    masks = [sum(1 << i for i in c) for n in range(radius + 1) for c in combinations(range(64), n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(points: DataFrame, radius: int = 2) -> DataFrame:
    """Links u, v between distinct fingerprints (column fp) that connect all pairs within radius.

    At each variant, all fingerprints of its ball are linked to one centre that is within the
    smaller half of the radius, so that each link is a pair within radius and all pairs are connected.
    """
    outer, inner = (radius + 1) // 2, radius // 2
    masks = F.array(*[F.lit(m).cast("long") for m in balls(outer)])
    spread = points.select("fp", F.explode(masks).alias("_mask")).select("fp", F.col("fp").bitwiseXOR(F.col("_mask")).alias("_variant"))
    close = F.when(F.bit_count(F.col("fp").bitwiseXOR(F.col("_variant"))) <= inner, F.col("fp"))
    met = spread.withColumn("_centre", F.min(close).over(Window.partitionBy("_variant")))
    met = met.where((F.col("_centre") != F.col("fp")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("_centre"))) <= radius))
    return met.select(F.col("fp").alias("u"), F.col("_centre").alias("v")).distinct()


def fingerprint_groups(docs: DataFrame, doc_id: str, text: str, radius: int, width: int) -> DataFrame:
    """doc_id, fp and component_id, linked by fingerprints alone."""
    prints = materialize(fingerprint_table(docs, doc_id, text, width))
    points = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("_least")))
    roots = components(links(points, radius))
    placed = points.join(roots, points["fp"] == roots["node"], "left").select("fp", "_least", F.coalesce("root", "fp").alias("_root"))
    least = placed.groupBy("_root").agg(F.min("_least").alias("component_id"))
    return prints.join(placed.join(least, "_root").select("fp", "component_id"), "fp", "left")


def similar_groups(docs: DataFrame, doc_id: str, text: str, radius: int, width: int, similarity: float) -> DataFrame:
    """doc_id, fp, root (a hash that a group shares) and text_hash of each row, linked by similarity."""
    s = similar.Search(docs, doc_id, text, width, Fraction(similarity).limit_denominator(1000))
    by_print = s.places.groupBy("fp").agg(F.min("node").alias("first"))
    u, v = (by_print.select(F.col("fp").alias(c), F.col("first").alias(f"_{c}")) for c in "uv")
    near = links(s.places.select("fp").repartition("fp").distinct(), radius).join(u, "u").join(v, "v").select(F.col("_u").alias("u"), F.col("_v").alias("v"))
    same = s.places.join(by_print, "fp").where("node != first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    return similar.rooted(s.prints, s.complete(s.verified(near.union(same))))


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 2, width: int = 3, similarity: float | None = None) -> DataFrame:
    """For every row: doc_id, fingerprint (16 hex digits), component_id.

    A text without words (null, empty, white space) has fingerprint zero, linked like any
    other; one with fewer words than the width is a single shingle. component_id is the
    smallest id that is reachable over links; ids that are null don't count, and a group with none but those has null. Rows may repeat.
    Other columns are neither read nor returned. An empty table gives no rows. Ids may be numbers or texts.

    Without a similarity, fingerprints link if at most radius bits differ. With one, texts link if the Jaccard similarity of their sets of
    shingles is as high or higher, exactly; texts without words are one group.
    """
    if similarity is None:
        rows = fingerprint_groups(docs, doc_id, text, radius, width)
    else:
        rows = materialize(similar_groups(docs, doc_id, text, radius, width, similarity))
        rows = rows.join(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root")
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 2, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group that near_groups finds by similarity, with all its columns: that of the smallest id.

    Of rows that repeat the smallest id, and of a group without any id, the one whose columns have the least hash. docs is read
    several times and must give the same texts each time.
    """
    key = ["_id", "_t"]
    groups, _ = compact(similar_groups(docs, doc_id, text, radius, width, similarity).select("root", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_t")))
    best = groups.groupBy("root").agg(F.min(F.struct(F.col("_id").isNull(), *key)).alias("_k"))
    stays = F.col("_id").eqNullSafe(F.col("_k._id")) & (F.col("_t") == F.col("_k._t"))
    told, _ = compact(groups.join(best, "root").groupBy(*key).agg(F.min(stays).alias("_stays"), F.count(F.lit(1)).alias("_n")).where("not _stays or _n > 1"))
    gone, again = told.where("not _stays").select(*key), told.where("_stays").select(*key)

    columns = docs.columns
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(columns)])
    at = {c: rows[f"_c{i}"] for i, c in enumerate(columns)}
    same = similar.text_hash(at[text]).eqNullSafe(F.col("_t")) & at[doc_id].eqNullSafe(F.col("_id"))
    n, m = gone.count(), again.count()
    kept = rows.join(small(gone, n, similar.NODES), same, "left_anti")
    if m:  # rows that repeat an id and a text
        twice = kept.join(small(again, m, similar.NODES), same)
        held = rows.columns
        first = twice.groupBy(*key).agg(F.min_by(F.struct(*held), F.xxhash64(*held)).alias("_row")).select("_row.*")
        kept = kept.join(small(again, m, similar.NODES), same, "left_anti").unionByName(first)
    return kept.toDF(*columns)
