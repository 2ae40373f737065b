"""The registry: names, SQL for known queries, and the flagship."""

import __spark_entry__ as entry


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 60


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
