"""Every registered query against its SQL on the smallest test tables."""

import pytest

from dealtide.plans import ORACLES, QUERIES

from .compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    assert compare(spark, con, SF, name) in (None, "EMPTY")
