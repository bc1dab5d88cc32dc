"""Ordered operations on many series without one task for each series.

Each series is cut into buckets of time (or of row numbers). Within a bucket a window does the work;
between buckets a small table with a row for each bucket carries what came before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DAY = 86_400


def day_of(t: Column) -> Column:
    return F.floor(t / DAY)


def running_sum(df: DataFrame, keys: list[str], bucket: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """df with the inclusive running sum of value by keys in the given order; bucket must not decrease in that order."""
    rows = df.withColumn("_b", bucket).withColumn("_v", value)
    sums = rows.groupBy(*keys, "_b").agg(F.sum("_v").alias("_s"))
    sums = sums.select(*keys, "_b", (F.sum("_s").over(Window.partitionBy(*keys).orderBy("_b")) - F.col("_s")).alias("_before"))
    within = F.sum("_v").over(Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(sums, [*keys, "_b"]).withColumn(name, F.col("_before") + within).drop("_b", "_v", "_before")


def numbered(df: DataFrame, keys: list[str] = ["symbol"], t: str = "t", name: str = "rn") -> DataFrame:  # noqa: B006
    """df with row numbers from 1 by keys in the order of t."""
    return running_sum(df, keys, day_of(F.col(t)), [t], F.lit(1).cast("long"), name)


def lagged(df: DataFrame, keys: list[str], bucket: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """df with the value of the row before, by keys in the given order."""
    rows = df.withColumn("_b", bucket).withColumn("_v", value)
    last = rows.groupBy(*keys, "_b").agg(F.max_by(F.struct(F.col("_v")), F.struct(*order)).alias("_l"))
    last = last.select(*keys, "_b", F.lag("_l").over(Window.partitionBy(*keys).orderBy("_b")).alias("_carry"))
    w = Window.partitionBy(*keys, "_b").orderBy(*order)
    rows = rows.join(last, [*keys, "_b"]).withColumn(name, F.coalesce(F.lag(F.struct("_v")).over(w), F.col("_carry"))["_v"])
    return rows.drop("_b", "_v", "_carry")


def last_known(df: DataFrame, keys: list[str], bucket: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """df with the last value that isn't null up to each row, by keys in the given order."""
    rows = df.withColumn("_b", bucket).withColumn("_v", value)
    last = rows.where("_v is not null").groupBy(*keys, "_b").agg(F.max_by("_v", F.struct(*order)).alias("_l"))
    every = rows.select(*keys, "_b").distinct().join(last, [*keys, "_b"], "left")
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    every = every.select(*keys, "_b", F.last("_l", ignorenulls=True).over(before).alias("_carry"))
    w = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(every, [*keys, "_b"]).withColumn(name, F.coalesce(F.last("_v", ignorenulls=True).over(w), F.col("_carry")))
    return rows.drop("_b", "_v", "_carry")


def blocked(df: DataFrame, size: int, halo: int) -> DataFrame:
    """Rows (with rn) dealt to blocks of `size` row numbers, each preceded by the last `halo` rows of the block before, which are marked."""
    own = F.floor((F.col("rn") - 1) / size)
    near_end = (F.col("rn") - 1) % size >= size - halo
    return df.withColumn("block", F.explode(F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own)))).withColumn("halo", F.col("block") > own)


def over_blocks(df: DataFrame, columns: dict[str, Column], longest: int, size: int = 4096) -> DataFrame:
    """df (with symbol, rn) with columns that are window expressions over `frame`, of at most `longest` rows. Blocks are eight times as long at least."""
    return blocked(df, max(size, 8 * longest), longest).withColumns(columns).where(~F.col("halo")).drop("block", "halo")


def frame(rows: int) -> Window:
    """The last `rows` rows of a symbol, for over_blocks."""
    return Window.partitionBy("symbol", "block").orderBy("rn").rowsBetween(1 - rows, 0)

