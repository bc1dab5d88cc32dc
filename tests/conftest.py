from __future__ import annotations

import os
import sys
import tempfile
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parent.parent))
DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("PYTHONPATH", str(Path(__file__).parent.parent))
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows_of(frame, columns: list[str]) -> list[tuple]:
    """Rows as comparable tuples: numbers as floats, missing values as None, in a fixed order."""

    def plain(x):
        if x is None or str(x) == "<NA>" or x != x:
            return None
        if isinstance(x, bool) or type(x).__name__ == "bool_":
            return bool(x)
        if hasattr(x, "__float__"):
            return float(x) + 0.0
        return str(x)

    return sorted((tuple(plain(x) for x in r) for r in frame[columns].itertuples(index=False)), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="session")
def agrees(spark):
    """Asserts that a query's rows equal its SQL's."""
    bases: dict[str, duckdb.DuckDBPyConnection] = {}

    def check(run, statement: str, sf: str) -> None:
        sf_dir = f"{DATA}/{sf}"
        con = bases.setdefault(sf, database(sf_dir))
        got, want = run(spark, sf_dir).toPandas(), con.execute(statement).df()
        assert sorted(got.columns) == sorted(want.columns)
        columns = sorted(want.columns)
        a, b = rows_of(got, columns), rows_of(want, columns)
        assert len(a) == len(b)
        assert [(x, y) for x, y in zip(a, b, strict=True) if x != y][:3] == []

    return check
