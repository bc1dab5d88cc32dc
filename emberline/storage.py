"""Intermediate tables in the shared checkpoint folder, and broadcasts of checked size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a lookup table of short rows may be broadcast (some MB).
BROADCAST_ROWS = 50_000
#: Numbers that a task reads of a compact table (2 MB).
NUMBERS = 1 << 18


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only in local mode without that setting."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder once and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def compact(df: DataFrame, numbers: Column | None = None) -> tuple[DataFrame, int]:
    """df, materialized, and its rows; as many partitions as its numbers fill (4 a row, unless told).

    A shuffle has a file and a log entry for each task, whatever it holds. Tables of pairs and nodes, cut into as many partitions as
    the documents, take more disk by these than by their rows.
    """
    df = materialize(df)
    rows, held = df.agg(F.count(F.lit(1)), F.sum(F.lit(4) if numbers is None else numbers)).first()
    return df.coalesce((held or 0) // NUMBERS + 1), rows


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the limit, else as it is."""
    return F.broadcast(df) if rows <= limit else df


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder. Whoever sets spark.checkpoint.dir clears it."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
