import os

import pytest

from checks.compare import compare, database
from checks.oracles import ORACLES
from checks.queries import QUERIES

SF = "/root/testdata/sf0.01"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not here")


@pytest.fixture(scope="module")
def con():
    return database(SF)


def test_oracles_name_queries():
    assert not ORACLES.keys() - QUERIES.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql(spark, con, name):
    assert compare(spark, con, name, SF) is None


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
