"""Named queries, each with the SQL that it must equal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenweave.sources.views import AS_OF

QUERIES: dict = {}
SQL: dict = {}

NOW_SQL = f"TIMESTAMP '{AS_OF}'"


def now() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def query(sql: str | None = None, name: str | None = None):
    """Registers f(spark, sf_dir) under its name."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql
        return f

    return add
