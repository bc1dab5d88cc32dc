"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.storage import compact, ensure_checkpoint_dir, materialize, small

#: The white space of the word definitions: blank and \x09 to \x0D.
SPACE = r"[\x20\x09-\x0D]"
#: A word by white space.
WORD = r"[^\x20\x09-\x0D]+"
__all__ = ["SPACE", "WORD", "as_bytes", "compact", "ensure_checkpoint_dir", "give_back", "is_held_out", "map_columns", "materialize", "one_of_each", "parts", "small", "text_of"]


def text_of(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def is_held_out(name: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 1 modulo 3; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding them."""
    large = pa.types.is_large_string(column.type)
    return column.cast(pa.large_binary() if large else pa.binary()).to_pylist()


def parts(items: list, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of items (None or bytes) that hold most_bytes or a single item."""
    start, held = 0, 0
    for i, x in enumerate(items):
        held += len(x or b"")
        if held >= most_bytes:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(items):
        yield start, len(items)


def give_back() -> None:
    """Return what this Python worker has freed to the machine: it may wait long for its next task, beside stages that need none."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library that has no such call
        pass


def map_columns(df: DataFrame, columns: list[Column], schema: str, step: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]]) -> DataFrame:
    """mapInArrow over just these columns; step turns a record batch into one or several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = step(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out
        give_back()

    return df.select(*columns).mapInArrow(run, schema)


def one_of_each(rows: DataFrame, group: Column, columns: list[str]) -> DataFrame:
    """One row of each group, with the given columns: of several the one whose columns have the least hash.

    Groups with several rows are looked for first. As a rule there are none, and nothing is moved; else a minimum is
    aggregated for these groups alone.
    """
    rows = rows.select(group.alias("_group"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(columns)])
    held = [f"_{i}" for i in range(len(columns))]
    many = materialize(rows.groupBy("_group").count().where("count > 1").select("_group"))
    if not many.isEmpty():
        rest = rows.join(many, "_group", "left_semi").groupBy("_group").agg(F.min_by(F.struct(*held), F.xxhash64(*held)).alias("_row")).select("_group", "_row.*")
        rows = rows.join(many, "_group", "left_anti").unionByName(rest)
    return rows.select(*[F.col(h).alias(c) for h, c in zip(held, columns, strict=True)])
