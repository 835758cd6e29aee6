"""Changes to tables of files: upserts and deletes as functions, and snapshots that are published at once."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def promote_json(rows: DataFrame, metadata: str = "metadata") -> DataFrame:
    """Sizes out of the JSON (also nested under dimensions): width, height 0; aspect_ratio 1.0; fs_size 0 where missing or not a number."""
    m = F.col(metadata)
    at = lambda path, kind: F.get_json_object(m, path).try_cast(kind)
    zero = F.lit(0).cast("long")
    return rows.withColumns({
        "width": F.coalesce(at("$.width", "long"), at("$.dimensions.width", "long"), zero), "height": F.coalesce(at("$.height", "long"), at("$.dimensions.height", "long"), zero),
        "aspect_ratio": F.coalesce(at("$.aspect_ratio", "double"), F.lit(1.0)), "fs_size": F.coalesce(at("$.file_size", "long"), zero),
    })


def check_width(rows: DataFrame, width: int, vector: str = "embedding") -> DataFrame:
    """Fails the job at a vector that is not so wide."""
    wrong = F.raise_error(F.concat(F.lit("a vector is "), F.size(vector).cast("string"), F.lit(f" wide, not {width}")))
    return rows.withColumn(vector, F.when(F.size(vector) == width, F.col(vector)).otherwise(wrong))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new, and those of old without a row of the same key in it."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_keys(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys), keys, "left_anti")


def delete_where(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows of which the condition is not true (unknown stays)."""
    return rows.where(~F.coalesce(condition, F.lit(False)))


def delete_transcript_chunks(chunks: DataFrame, path: str) -> DataFrame:
    return delete_where(chunks, (F.col("file_path") == path) & (F.get_json_object("metadata", "$.source_type") == "transcript_chunk"))


def replace_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of the files in new are replaced."""
    return upsert(old, new, ["file_path"])


def transcript_rollup(segments: DataFrame, keys: list[str], order: str = "seg_no") -> DataFrame:
    """One row a transcript: whole text, duration, number of segments, confidence of the first."""
    has = "confidence" in segments.columns
    held = segments.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, "text", "end_s", *(["confidence"] if has else [])))).alias("__s"))
    conf = F.get("__s", F.lit(0))["confidence"].cast("double") if has else F.lit(None).cast("double")
    words = F.array_join(F.transform("__s", lambda s: F.trim(s["text"])), " ")
    return held.select(*keys, words.alias("transcription_text"), F.array_max(F.transform("__s", lambda s: s["end_s"])).alias("duration_seconds"), F.size("__s").cast("long").alias("n_segments"), conf.alias("confidence_score"))


class Snapshots:
    """Numbered Parquet folders of one table and a list of published ones; a reader sees a whole snapshot or the one before.

    The list is a table of one row a publication, written last, so a job that dies publishes nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = f"{self.path}/_published"

    def current(self) -> str | None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.log)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return None
        return self.spark.read.schema("n long, folder string").json(self.log).orderBy(F.desc("n")).first()["folder"]

    def read(self) -> DataFrame | None:
        now = self.current()
        return self.spark.read.parquet(f"{self.path}/{now}") if now else None

    def clear(self) -> str | None:
        """Publishes an empty snapshot of the same columns; None where nothing was published."""
        rows = self.read()
        return self.publish(rows.limit(0)) if rows is not None else None

    def publish(self, rows: DataFrame) -> str:
        now = self.current()
        n = int(now.split("-")[1]) + 1 if now else 0
        folder = f"snapshot-{n}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        self.spark.createDataFrame([(n, folder)], "n long, folder string").coalesce(1).write.mode("append").json(self.log)
        return folder
