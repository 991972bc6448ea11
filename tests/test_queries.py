"""Every registered query against its SQL on the small fixture."""

import os

import pytest
from compare import DATA, compare, connect

from tarmac.queries import ORACLES, QUERIES

SF = f"{DATA}/{os.environ.get('TARMAC_TEST_SF', 'sf0.001')}"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    _, problem = compare(spark, con, name, SF, QUERIES, ORACLES)
    assert problem is None


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
