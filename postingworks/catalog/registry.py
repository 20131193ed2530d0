"""Named queries, each with the SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from postingworks.catalog.fixtures import with_fixtures
from postingworks.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None, **common: str):
    """Registers a query; `check` may name fixtures and the extra `common` tables."""
    def register(fn: Query) -> Query:
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        QUERIES[name] = run
        if check:
            CHECKS[name] = with_fixtures(check, **common)
        return fn
    return register
