"""The corpus pipeline: each stage applies one operator to what the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenweave.llm import exact_dedup, minhash_dedup, mixing, packing, toxicity
from lumenweave.llm.common import settle, table

STAGES = [
    ("toxicity", toxicity.stage),
    ("exact dedup", exact_dedup.stage),
    ("minhash near-dedup", minhash_dedup.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: The model, the signatures and the packing search have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
