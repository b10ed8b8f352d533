"""Every registered query against its SQL, on the smallest data."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    assert compare(spark, duck, SF_DIR, QUERIES[name], ORACLES.get(name)) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["seq", "kind", "pos", "line"]
    assert df.count() > 0
