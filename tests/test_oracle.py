"""Every registered query against its SQL twin on the smallest tables."""

import os

import pytest

from compare import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

from legwise.catalog import load

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(load()[0]))
def test_query(spark, con, name):
    good, note = compare(spark, con, FOLDER, name, queries()[name], oracle_sql().get(name))
    assert good, note


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_twin_has_a_query():
    assert set(oracle_sql()) <= set(queries())
