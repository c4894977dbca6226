"""Queries over the benchmark tables: each operator with the SQL that states the same result."""

from . import analytics, basics, operations, storage, streams  # noqa: F401  (imports register the queries)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
