"""What the driver's entry adds: the queries of this package with their SQL."""

from __future__ import annotations

from revtide.llm.queries import QUERIES
from revtide.llm.sql import ORACLES

__all__ = ["ORACLES", "QUERIES"]
