"""Registry of queries: name -> Spark callable, and name -> equivalent SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from suite.views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: tuple = ()):
    """Register a query; ``sql`` may use the views and the further ``ctes``."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(*ctes) + sql
        return fn

    return register
