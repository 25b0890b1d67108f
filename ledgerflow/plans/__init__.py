"""All registered queries."""

from . import logs, more, reports  # noqa: F401
from .registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
