"""Mix sources to target weights by hash thresholds.

Each document has a fixed 60-bit hash. A source takes every document a whole number
of times, and those under its threshold once more. The threshold comes from
histograms: words by source and hash bucket, a running sum over at most 4096 buckets a
source, and then the same again inside the one bucket that holds the boundary. No
document is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberline.llm.common import WORD, materialize, small

HASH_BITS, LEVEL_BITS = 60, 12
#: No source and no document is taken more often than this.
MOST = 3


def sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size in words, and the hash of the id, which md5 spreads evenly."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words_in(F.col(text)).alias("size"), place_of(F.col(doc_id)).alias("h"))


def words_in(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def place_of(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """sources with their rank from 0 by code point, null last: sorted by ranges, each range numbered on its own."""
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(sources.repartitionByRange(n, F.asc_nulls_last("source")).sortWithinPartitions(F.asc_nulls_last("source")).withColumn("_at", F.monotonically_increasing_id()))
    part, low = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit(2**33 - 1))
    before, held = [], 0
    for row in rows.groupBy(part.alias("p")).count().orderBy("p").collect():  # a row for each shuffle partition
        before += [F.lit(row["p"]), F.lit(held)]
        held += row["count"]
    return rows.withColumn("_rank", (F.element_at(F.create_map(*before), part) if before else F.lit(0)) + low).drop("_at")


def targets(sized: DataFrame, weights: Column | None = None) -> DataFrame:
    """source, source_size, target. Weights are 1, 2, 3 by rank unless a Column over _rank and source gives others."""
    table = ranked(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = weights if weights is not None else F.col("_rank") % 3 + 1
    table = materialize(table.select("source", "source_size", weight.cast("long").alias("_w"), (F.col("source_size") * MOST).alias("_cap")))
    capped, last, total = F.lit(False), -1, None
    while True:
        row = table.agg(F.sum("source_size"), F.sum("_w"), F.sum(F.when(capped, F.col("_cap"))), F.sum(F.when(capped, F.col("_w"))), F.count(F.when(capped, 1))).first()
        total, weight_sum, full, full_weight, n = (x or 0 for x in row)
        if n == last or total == 0 or weight_sum == full_weight:
            break
        last, left = n, (total - full, weight_sum - full_weight)
        share = (F.col("_w") * F.lit(left[0])).cast("double") / F.lit(float(left[1]))
        capped = capped | (share > F.col("_cap"))
    if not total:
        return table.select("source", "source_size", F.lit(0.0).alias("target"))
    return table.select("source", "source_size", F.when(capped, F.col("_cap").cast("double")).otherwise(share).alias("target"))


def thresholds(sized: DataFrame, goals: DataFrame) -> tuple[DataFrame, int]:
    """For each source: _times, and _upto: documents whose hash is at most _upto are taken once more (-1: none). Also the number of sources."""
    goals = materialize(goals.withColumn("_times", F.coalesce(F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))), F.lit(0))).withColumn("_rest", F.col("target") - F.col("_times") * F.col("source_size")))
    n = goals.count()
    # open: sources whose boundary lies in the bucket of hashes that begin with _prefix; _below words lie under it
    found, opened = None, goals.where("_rest > 0").select(F.col("source").alias("_s"), "_rest", F.lit(0).cast("long").alias("_below"), F.lit(0).cast("long").alias("_prefix"))
    for level in range(1, HASH_BITS // LEVEL_BITS + 1):
        above = HASH_BITS - LEVEL_BITS * (level - 1)
        rows = sized.where("size > 0").join(small(opened, n), F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("h", above) == F.col("_prefix")))
        hist = rows.groupBy("_s", "_rest", "_below", F.shiftright("h", above - LEVEL_BITS).alias("_bucket")).agg(F.sum("size").alias("_words"), F.min("h").alias("_first"), F.max("h").alias("_last"))
        sums = hist.withColumn("_to", F.col("_below") + F.sum("_words").over(Window.partitionBy("_s").orderBy("_bucket")))
        cut = materialize(sums.where((F.col("_to") > F.col("_rest")) & (F.col("_to") - F.col("_words") <= F.col("_rest"))).withColumn("_below", F.col("_to") - F.col("_words")))
        one = cut.where("_first = _last")
        nearer = F.col("_to") - F.col("_rest") <= F.col("_rest") - F.col("_below")
        done = one.select("_s", F.when(nearer & (F.col("_rest") > F.col("_below")), F.col("_first")).otherwise(F.col("_first") - 1).alias("_upto"))
        found = done if found is None else found.unionByName(done)
        opened = cut.where("_first < _last").select("_s", "_rest", "_below", F.col("_bucket").alias("_prefix"))
        if opened.isEmpty():
            break
    return goals.join(small(found, n), F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "source_size", "target", "_times", F.coalesce("_upto", F.lit(-1).cast("long")).alias("_upto")), n


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Column | None = None) -> DataFrame:
    """For every row: doc_id, size, source_size, target, taken, source.

    A null text has no words; a null source is a source of its own, ranked last. Rows
    with the same id have the same hash and are taken together. A source's words taken
    differ from its target by half the words of one id at most. An empty table gives no
    rows; other columns are neither read nor returned.
    """
    sized = materialize(sizes(docs, doc_id, text, source))
    cuts, n = thresholds(sized, targets(sized, weights))
    cuts = cuts.withColumnRenamed("source", "_source")
    out = sized.join(small(cuts, n), F.col("source").eqNullSafe(F.col("_source")))
    taken = F.col("size") * (F.col("_times") + F.when(F.col("h") <= F.col("_upto"), 1).otherwise(0))
    return out.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source")


def take_mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Column | None = None) -> DataFrame:
    """docs as mixed, with all columns: a row that is taken n times comes n times, one that is not taken is left out.

    The rows are those of mix(): each is looked up by its source and hash, so that rows which repeat an id, in one source or in
    several, come as often as mix() says for each of them. A row without words is not taken. docs isn't shuffled unless
    there are too many sources for a broadcast.
    """
    sized = materialize(sizes(docs, doc_id, text, source))
    cuts, n = thresholds(sized, targets(sized, weights))
    cuts = small(cuts.select(F.col("source").alias("_source"), "_times", "_upto"), n)
    columns = docs.columns
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(columns)])
    at = {c: F.col(f"_c{i}") for i, c in enumerate(columns)}
    times = F.col("_times") + F.when(place_of(at[doc_id]) <= F.col("_upto"), 1).otherwise(0)
    rows = rows.join(cuts, at[source].eqNullSafe(F.col("_source"))).withColumn("_taken", F.when(words_in(at[text]) > 0, times).otherwise(0).cast("int")).where("_taken > 0")
    return rows.withColumn("_taken", F.explode(F.sequence(F.lit(1), F.col("_taken")))).select(*[at[c].alias(c) for c in columns])


ORACLE = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as h
  from documents
), s as (
  select source, sum(size)::bigint as source_size, (row_number() over (order by source nulls last) - 1) % 3 + 1 as w from d group by source
), o as (
  select *, sum(source_size) over () as t, sum(w) over () as ws,
         coalesce(sum(3 * source_size) over (order by 3 * source_size / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as c,
         coalesce(sum(w) over (order by 3 * source_size / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as v
  from s
), l as (
  select *, coalesce(bool_or(w * (t - c)::double / (ws - v) <= 3 * source_size) over (order by 3 * source_size / w, source nulls last rows between unbounded preceding and current row), false) as under from o
), f as (
  select min(c) filter (where under) as c, min(v) filter (where under) as v from l
), g as (
  select source, source_size, case when under then (w * (t - f.c))::bigint::double / (ws - f.v)::double else (3 * source_size)::double end as target from l, f
), k as (
  select *, coalesce(floor(target / nullif(source_size, 0)), 0) as times from g
), x as (
  select d.*, source_size, target, times, target - times * source_size as rest,
         sum(size) over (partition by d.source order by h) as upto,
         sum(size) over (partition by d.source, h) as own
  from d join k on d.source is not distinct from k.source
)
select doc_id, size::bigint as size, source_size, target,
       (size * (times + case when upto <= rest or (upto - own < rest and upto - rest <= rest - (upto - own)) then 1 else 0 end))::bigint as taken, source
from x
"""
