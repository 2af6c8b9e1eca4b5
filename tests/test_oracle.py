"""Every registered query against its SQL, and the driver contract."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry_module
from bookwright.plans.oracle import oracles
from bookwright.plans.queries import all_queries
from tests.oracle_check import compare, connect

SF_DIR = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the test tables")


def test_every_query_has_sql():
    assert set(all_queries()) == set(oracles())
    assert set(all_queries()) <= set(entry_module.queries()) and set(oracles()) <= set(entry_module.oracle_sql())


@needs_data
@pytest.mark.parametrize("name", all_queries())
def test_query_matches_sql(spark, name):
    assert compare(spark, connect(SF_DIR), SF_DIR, name) is None


@needs_data
def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
