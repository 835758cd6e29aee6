"""Streams: listings of watched folders as they come, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenweave.operators.tables import Snapshots
from lumenweave.operators.watch import KEY, diff, upsert


def watch(listings: DataFrame, state: Snapshots, checkpoint: str, on_changed=None, **trigger) -> StreamingQuery:
    """listings: a stream of folder_id, file_path, content_sig. Each batch is compared with the stored state; new and changed files go to on_changed(rows, batch); then the state is published.

    Removals are not seen in a stream of files: compare whole listings for those.
    """

    def step(rows: DataFrame, batch: int) -> None:
        seen = rows.dropDuplicates(KEY).withColumn("last_index_job_id", F.lit(None).cast("string"))
        stored = state.read()
        if stored is None:
            stored = seen.limit(0)
        found = diff(seen, stored.join(seen.select(*KEY), KEY, "left_semi")).where("state IN ('new', 'changed')")
        if on_changed is not None:
            on_changed(found, batch)
        state.publish(upsert(stored, seen))

    return listings.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_listings(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema("folder_id string, file_path string, content_sig string")
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def event_counts(events: DataFrame, minutes: int = 5, late_minutes: int = 10) -> DataFrame:
    """Extra: tumbling counts of events (ts, event_type) with a watermark."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", f"{late_minutes} minutes")
    return at.groupBy(F.window("ts", f"{minutes} minutes"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select("window.start", "window.end", "event_type", "n", "value")


def drop_repeats(events: DataFrame, key: str = "event_id", late_minutes: int = 10) -> DataFrame:
    """Extra: one event a key, as far back as the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", f"{late_minutes} minutes").dropDuplicatesWithinWatermark([key])
