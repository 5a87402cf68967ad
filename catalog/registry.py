"""Names, functions and SQL of the registered queries."""

from __future__ import annotations

import functools
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from matchweave.sources.tables import shared_root

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, folder) under ``name``, with its SQL if there is any."""
    def register(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            if not shared_root(spark) and spark.sparkContext.master.startswith("local"):
                spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="matchweave-"))
            return fn(spark, folder)

        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql.strip()
        return run
    return register
