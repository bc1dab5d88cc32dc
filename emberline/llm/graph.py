"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import materialize, small
from emberline.storage import NUMBERS


def components(edges: DataFrame) -> DataFrame:
    """Of links u, v (long): node and root for every node that isn't its component's smallest.

    Each round points every node to the smallest of its neighbours, first towards larger
    nodes, then towards smaller ones; the rounds needed grow with the logarithm of the
    component. A node's neighbours are never gathered: their minimum is aggregated
    and joined back, and Spark can split such a join where one node has most links. Links that are few enough for a broadcast
    are not shuffled.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = materialize(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = state(now)
    while seen[0]:
        tasks = 4 * seen[0] // NUMBERS + 1  # no round makes links more
        both = now.coalesce(tasks).select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(small(least, 2 * seen[0]), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(small(least, 2 * seen[0]), "u")
        now = materialize(near.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).coalesce(tasks).distinct())
        before, seen = seen, state(now)
        if before == seen:
            break
    now = now.coalesce(4 * seen[0] // NUMBERS + 1)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
