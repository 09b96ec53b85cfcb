"""Queries of the library, each with the SQL it must agree with."""

from __future__ import annotations

from kolumna.queries import extended, more, relational, scalar
from kolumna.queries.registry import QUERIES, SQL, Query

__all__ = ["all_queries", "all_sql", "extended", "more", "relational", "scalar"]


def all_queries() -> dict[str, Query]:
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    return dict(SQL)
