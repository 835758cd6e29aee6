"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or what setCheckpointDir was given; a local one is made only where neither is set, as on one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        sc = spark.sparkContext
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="lumenweave-"))
        where = sc._jsc.sc().getCheckpointDir().get()
    return where.rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def settle(df: DataFrame, kind: str = "table") -> DataFrame:
    """df written and read back: its lineage is cut, and any executor can be lost."""
    path = new_folder(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
