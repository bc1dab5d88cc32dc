"""Exact duplicates, found by Spark expressions alone.

Three merges, each of which groups by the digest and the whole normalised text:
within a task, within a salt (a salt is a set of tasks), and over all salts. A text
that a third of all rows share costs each task one row, and each salt at most a
salt's share of the tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import SPACE, materialize, one_of_each, text_of

#: A row's rank is length * 2**65 + (2**63 - id), or + 0 without an id: the larger rank stays.
#: As a decimal it is a fixed-width buffer, so that Spark aggregates by hash, not by sort.
SHIFT, HALF = Decimal(2**65), Decimal(2**63)


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", "")


def sha256_of(norm: Column) -> Column:
    return F.sha2(norm.cast("binary"), 256)


def winners(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = 16, digest: Callable[[Column], Column] = sha256_of, keep_text: bool = False) -> DataFrame:
    """A row for each distinct normalised text: _digest, keep_id, keep_chars (code points of the row that stays), group_size (and _norm)."""
    rank = F.char_length(text_of(text)).cast("decimal(12,0)") * F.lit(SHIFT) + F.coalesce(F.lit(HALF) - F.col(doc_id).cast("decimal(20,0)"), F.lit(Decimal(0)))
    rows = docs.select(normalised(F.col(text)).alias("_norm"), rank.cast("decimal(38,0)").alias("_rank"), (F.spark_partition_id() % salts).alias("_salt"))
    rows = rows.select(digest(F.col("_norm")).alias("_digest"), "*")
    salted = rows.groupBy("_digest", "_norm", "_salt").agg(F.max("_rank").alias("_rank"), F.count(F.lit(1)).alias("_n"))
    merged = salted.groupBy("_digest", "_norm").agg(F.max("_rank").alias("_rank"), F.sum("_n").alias("group_size"))
    behind = F.col("_rank") % F.lit(SHIFT)
    keep_id = F.when(behind > 0, (F.lit(HALF) - behind).cast("long"))
    return merged.select("_digest", keep_id.alias("keep_id"), F.expr(f"_rank div {SHIFT}BD").alias("keep_chars"), "group_size", *["_norm"] * keep_text)


def with_winner(rows: DataFrame, docs: DataFrame, doc_id: str, text: str, salts: int, digest: Callable[[Column], Column]) -> DataFrame:
    """rows (with _norm and _digest) of docs with what winners() says of their group. Should two texts ever share a digest, their rows find their group by full text."""
    won = materialize(winners(docs, doc_id, text, salts, digest))
    shared = won.groupBy("_digest").count().where("count > 1").select("_digest")
    if shared.isEmpty():
        return rows.drop("_norm").join(won, "_digest").withColumn("_group", F.col("_digest"))
    alone = rows.drop("_norm").join(won.join(shared, "_digest", "left_anti"), "_digest").withColumn("_group", F.col("_digest"))
    full = winners(docs, doc_id, text, salts, digest, keep_text=True).join(shared, "_digest", "left_semi")
    return alone.unionByName(rows.join(full, ["_digest", "_norm"]).withColumn("_group", F.concat("_digest", F.lit(" "), "_norm")).drop("_norm"))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = 16, digest: Callable[[Column], Column] = sha256_of) -> DataFrame:
    """For every row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical without white space (null is empty). Of a
    group, the row with the most code points of original text stays, then the smallest
    id (a whole number); a row without an id comes last. Of rows that also repeat the id and the length one stays, so that each group keeps exactly one row.
    Other columns are neither read nor returned, so
    their names can't clash. An empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.char_length(text_of(text)).alias("_chars"), normalised(F.col(text)).alias("_norm"))
    rows = rows.select("doc_id", "_chars", digest(F.col("_norm")).alias("_digest"), sha256_of(F.col("_norm")).alias("text_sha256"), "_norm")
    best = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_chars") == F.col("keep_chars"))
    out = with_winner(rows, docs, doc_id, text, salts, digest)
    out = materialize(out.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "keep_id", "group_size", "text_sha256", best.alias("_best"), F.when(best, F.col("_group")).alias("_group")))
    ties = materialize(out.where("_best").groupBy("_group").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"))
    kept = F.col("_best")
    if not ties.isEmpty():
        out, kept = out.join(ties, "_group", "left"), kept & F.coalesce(F.col("_row") == F.col("_first"), F.lit(True))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = 16) -> DataFrame:
    """The row of each group that exact_groups keeps, with all its columns; of rows that tie, see one_of_each."""
    columns = docs.columns
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(columns)])
    at = {c: F.col(f"_c{i}") for i, c in enumerate(columns)}
    held = [f"_c{i}" for i in range(len(columns))]
    rows = rows.select(*held, normalised(at[text]).alias("_norm"), F.char_length(F.coalesce(at[text], F.lit(""))).alias("_chars"))
    rows = with_winner(rows.withColumn("_digest", sha256_of(F.col("_norm"))), docs, doc_id, text, salts, sha256_of)
    best = rows.where(at[doc_id].eqNullSafe(F.col("keep_id")) & (F.col("_chars") == F.col("keep_chars")))
    return one_of_each(best, F.col("_group"), held).toDF(*columns)


ORACLE = r"""
with t as (
  select doc_id, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256 from documents
), w as (
  select *, first_value(doc_id) over (partition by text_sha256 order by n desc, doc_id nulls last) as keep_id, count(*) over (partition by text_sha256) as group_size from t
)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, text_sha256 from w
"""
