"""Every query with SQL against DuckDB."""

from __future__ import annotations

import pytest

from emberline.plans import catalog

#: Those that have rows only with longer series.
LONG = ("features", "alerts_latched", "cap_pivots", "suppression_reasons", "msg_batched", "msg_pack", "latch_ttl", "state_sink", "stream_alerts", "stream_caps", "stream_features", "stream_state")


@pytest.mark.parametrize("name", sorted(set(catalog.ORACLES) - set(LONG)))
def test_small(name, agrees):
    agrees(catalog.QUERIES[name], catalog.ORACLES[name], "sf0.001")


@pytest.mark.parametrize("name", LONG)
def test_long(name, agrees):
    agrees(catalog.QUERIES[name], catalog.ORACLES[name], "sf0.01")


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 960
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_latch_with_expiry_is_the_latch_while_nothing_expires(spark):
    a = catalog.QUERIES["latch_ttl"](spark, "/root/testdata/sf0.01")
    b = catalog.QUERIES["alerts_latched"](spark, "/root/testdata/sf0.01")
    assert sorted(map(tuple, a.select("symbol", "t", "key").collect())) == sorted(map(tuple, b.select("symbol", "t", "key").collect()))
