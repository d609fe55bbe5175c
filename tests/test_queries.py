"""Every registered query against its SQL."""

import pytest
from oracle_check import compare, connect, types_differ

import __spark_entry__ as entry

from wattfold.plans.oracle import ORACLE as SQL
from wattfold.plans.queries import QUERIES


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_all_are_registered():
    assert set(QUERIES) <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, con, name):
    frame = QUERIES[name](spark, sf_dir)
    answer = con.sql(SQL[name])
    assert types_differ(frame, answer) == ""
    assert compare(frame.toPandas(), answer.df()) == ""


def test_entry(spark, sf_dir):
    assert entry.entry(spark).columns[0] == "bid"
