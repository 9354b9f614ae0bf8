import pytest

import __spark_entry__ as entry_points
from check import compare, connect
from hostguard.plans import registry

FOLDER = "/root/testdata/sf0.001"
registry.load()
QUERIES, ORACLES = registry.QUERIES, registry.ORACLES


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_sql(spark, connection, name):
    assert compare(spark, connection, FOLDER, QUERIES[name], ORACLES.get(name)) is None


def test_entry(spark):
    assert entry_points.entry(spark).count() == 17
