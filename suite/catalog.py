"""All registered queries."""

from suite import basic, derived, stats  # noqa: F401
from suite.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
