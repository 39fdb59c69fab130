from __future__ import annotations

import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from revtide import schema  # noqa: E402
from revtide.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", 8)
    s.conf.set("spark.sql.shuffle.partitions", "4")
    s.sparkContext.setLogLevel("ERROR")
    return s


def ts(text: str) -> datetime:
    return datetime.fromisoformat(text)


@pytest.fixture(scope="session")
def make_revisions(spark):
    def make(rows):
        """(revno, time, author[, msg])"""
        full = [(r[0], ts(r[1]) if r[1] else None, r[2], r[3] if len(r) > 3 else "", 0, 0, 0) for r in rows]
        return spark.createDataFrame(full, schema.REVISIONS)

    return make


@pytest.fixture(scope="session")
def make_changes(spark):
    def make(rows):
        """(revno, path, type[, added, deleted[, copyfrompath, copyfromrev]])"""
        full = []
        for r in rows:
            r = list(r) + [0, 0, None, None][len(r) - 3 :]
            kind = "D" if r[1].endswith("/") else "F"
            full.append((r[0], r[1], r[2], r[5], r[6], kind, r[3], r[4], "Y", "R"))
        return spark.createDataFrame(full, schema.CHANGES)

    return make


def rows(df, *cols):
    d = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in d.collect()), key=lambda t: tuple((x is None, str(type(x)), x) for x in t))
