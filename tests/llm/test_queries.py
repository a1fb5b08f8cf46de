"""The problems' queries run on the test tables, and agree with their SQL where they have one."""

import pytest

from voxelmill.llm import registry

from ..compare import assert_same, database

QUERIES = {n: q for m in registry.modules() for n, q in m.QUERIES.items()}
ORACLES = {n: q for m in registry.modules() for n, q in m.ORACLES.items()}


@pytest.fixture(scope="module")
def db(data):
    return database(data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, data, db, name):
    assert_same(QUERIES[name](spark, data), db, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0
