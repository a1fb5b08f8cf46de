"""Every registered query of the core runs, and agrees with its SQL where it has one."""

import importlib

import pytest

import __spark_entry__ as entry

from .compare import assert_same, database

MODULES = [importlib.import_module(m) for m in entry.MODULES]
QUERIES = {n: q for m in MODULES for n, q in m.QUERIES.items()}
ORACLES = {n: q for m in MODULES for n, q in m.ORACLES.items()}


@pytest.fixture(scope="module")
def db(data):
    return database(data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, data, db, name):
    assert_same(QUERIES[name](spark, data), db, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark, data):
    assert entry.entry(spark).columns


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
