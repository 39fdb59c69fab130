"""Queries of the subpackage that SQL can express, against that SQL."""

from __future__ import annotations

import pytest
from conftest import SMALL

from revtide.llm.queries import QUERIES
from revtide.llm.sql import ORACLES
from tools.check import connect


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_against_sql(spark, name):
    found = QUERIES[name](spark, SMALL)
    columns = sorted(found.columns)
    con = connect(SMALL)
    assert sorted(con.sql(ORACLES[name]).columns) == columns
    wanted = con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(wanted)
