"""All queries of the engine and the SQL that gives the same rows."""

from __future__ import annotations

from tracewell.queries import ORACLE, QUERIES, align

FLAGSHIP = align
__all__ = ["FLAGSHIP", "ORACLE", "QUERIES"]
