"""Records of what was generated: id, user_prompt, json_prompt, source, generated_file_path, created_at, updated_at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _known(generations: DataFrame, ids: DataFrame, key: str) -> None:
    lost = ids.select(key).join(generations.select(key), key, "left_anti").first()
    if lost is not None:
        raise ValueError(f"generation {lost[0]} not found")


def create(generations: DataFrame, new: DataFrame, at: Column) -> DataFrame:
    """new: id, user_prompt, json_prompt, source. Without a file yet."""
    rows = new.withColumns({"generated_file_path": F.lit(None).cast("string"), "created_at": at, "updated_at": at})
    return generations.unionByName(rows, allowMissingColumns=True)


def set_file_path(generations: DataFrame, paths: DataFrame, at: Column, key: str = "id") -> DataFrame:
    """paths: key, generated_file_path. A key that no record has is an error."""
    _known(generations, paths, key)
    p = paths.select(key, F.col("generated_file_path").alias("__path"), F.lit(True).alias("__hit"))
    out = generations.join(p, key, "left")
    hit = F.col("__hit").isNotNull()
    new = {"generated_file_path": F.when(hit, F.col("__path")).otherwise(F.col("generated_file_path")), "updated_at": F.when(hit, at).otherwise(F.col("updated_at"))}
    return out.withColumns(new).select(*generations.columns)


def delete(generations: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Without the records of ids; one that no record has is an error."""
    _known(generations, ids, key)
    return generations.join(ids.select(key), key, "left_anti")
