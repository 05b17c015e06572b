"""All queries of the library, by name, with their SQL."""

from __future__ import annotations

from . import documents, more, records, rules, store, trees, work  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
