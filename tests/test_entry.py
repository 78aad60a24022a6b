"""The driver contract."""

import os

import pytest

import __spark_entry__ as entry


def test_names_and_oracles():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) > 150


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
def test_entry_runs(spark):
    found = entry.entry(spark)
    assert found.columns == ["split", "grp", "n", "mean", "sd"] and found.count() > 0
