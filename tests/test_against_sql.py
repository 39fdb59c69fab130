"""Every named query against its SQL, on the smallest data set."""

from __future__ import annotations

import pytest
from conftest import SMALL

from revtide.catalog import QUERIES
from revtide.oracles import ORACLES
from tools.check import compare, connect


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ok, note = compare(name, spark, con, SMALL)
    assert ok, note


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
