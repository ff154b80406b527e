"""All queries of the library, with the SQL that gives the same rows."""

from __future__ import annotations

from .plans import learning
from .plans import queries as plans


def queries() -> dict:
    return plans.queries() | learning.queries()


def oracle_sql() -> dict:
    return plans.oracle_sql() | learning.oracle_sql()
