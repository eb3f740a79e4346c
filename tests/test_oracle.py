"""Every registered query with an oracle, on the smallest scale factor."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from check import compare, oracle_connection

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, oracle, name):
    verdict, _, _ = compare(spark, oracle, FOLDER, name)
    assert verdict == "ok"


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
