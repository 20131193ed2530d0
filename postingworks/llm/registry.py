"""Named queries of this subpackage, each with the SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from postingworks.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def prepared(spark: SparkSession) -> SparkSession:
    """The session with Arrow batches bounded in bytes, so long texts don't add up in a worker, and with Python workers
    that look for the package where the driver found it, as spark.executorEnv.PYTHONPATH would say."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return spark


def query(name: str, check: str | None = None):
    def register(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(prepared(spark)), sf_dir)

        QUERIES[name] = run
        if check:
            CHECKS[name] = check
        return fn
    return register
