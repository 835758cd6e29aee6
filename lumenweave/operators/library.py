"""Listings and statistics of what is indexed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenweave.functions.text import chunk_count


def with_volume(items: DataFrame, volumes: DataFrame) -> DataFrame:
    """Each row with its volume's name, mount path and status, null without one."""
    v = volumes.select(F.col("uuid").alias("drive_uuid"), F.col("name").alias("drive_name"), F.col("mount_path").alias("drive_mount"), F.col("status").alias("drive_status"))
    return items.join(v, "drive_uuid", "left")


def first_chunk_per_file(chunks: DataFrame) -> DataFrame:
    """The chunks whose number is their file's least; ties stay."""
    least = chunks.groupBy("file_path").agg(F.min("chunk_index").alias("chunk_index"))
    return chunks.join(least, ["file_path", "chunk_index"])


def latest_per_path(*listings: DataFrame, path: str = "file_path", updated: str = "updated_s", key: str = "id") -> DataFrame:
    """One row per path: the last updated; of equal ones that of the earlier listing, then of the least key."""
    rows = None
    for n, listing in enumerate(listings):
        part = listing.withColumn("__n", F.lit(n))
        rows = part if rows is None else rows.unionByName(part)
    rank = Window.partitionBy(path).orderBy(F.desc(updated), "__n", key)
    return rows.withColumn("__r", F.row_number().over(rank)).where("__r = 1").drop("__r", "__n")


def group_frames(rows: DataFrame, key: Column | str = "item_no") -> DataFrame:
    """One row for the frames of each video (of the least key); other rows pass."""
    frame = F.coalesce(F.get_json_object("metadata", "$.source_type") == "video_frame", F.lit(False))
    first = Window.partitionBy("file_path", "__frame").orderBy(key)
    marked = rows.withColumn("__frame", frame)
    return marked.withColumn("__r", F.row_number().over(first)).where("NOT __frame OR __r = 1").drop("__r", "__frame")


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(max(0, offset)).limit(max(0, limit))


def page_with_total(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """A page with the total, the offset held within it, and whether more follows. The total is one row, joined by broadcast."""
    total = rows.agg(F.count("*").alias("total"))
    at = max(0, offset)
    shown = page(rows, order, at, limit).crossJoin(F.broadcast(total))
    return shown.withColumns({"page_offset": F.least(F.lit(at).cast("long"), F.col("total")), "has_more": F.lit(at + max(0, limit)) < F.col("total")})


def count_embedded(items: DataFrame) -> DataFrame:
    has = F.col("embedding").isNotNull()
    frame = F.coalesce(F.col("source_type") == "video_frame", F.lit(False))
    return items.agg(F.count_if(has).alias("embedded"), F.count_if(has & frame).alias("frames"), F.count_if(has & ~frame).alias("images"))


def distinct_media_counts(items: DataFrame) -> DataFrame:
    frame = F.coalesce(F.col("source_type") == "video_frame", F.lit(False))
    image = ~frame & (F.coalesce(F.col("mime_type").startswith("image/"), F.lit(False)) | F.coalesce(F.contains("metadata", F.lit('"width":')), F.lit(False)))
    video = frame | F.coalesce(F.col("mime_type").startswith("video/"), F.lit(False))
    n = items.agg(F.countDistinct(F.when(image, F.col("file_path"))).alias("unique_images"), F.countDistinct(F.when(video, F.col("file_path"))).alias("unique_videos"))
    return n.withColumn("total_unique_files", F.col("unique_images") + F.col("unique_videos"))


def distinct_paths(*listings: DataFrame) -> DataFrame:
    out = listings[0].select("file_path")
    for more in listings[1:]:
        out = out.union(more.select("file_path"))
    return out.distinct()


def frames_per_video(items: DataFrame) -> DataFrame:
    return items.where("source_type = 'video_frame'").groupBy("file_path").agg(F.count("*").alias("frames"))


def _item_stats(items: DataFrame) -> DataFrame:
    return items.agg(F.count("*").alias("items"), F.count_if(F.coalesce(F.col("source_type") == "video_frame", F.lit(False))).alias("frames"))


def document_stats(items: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """index_stats, without text_mb, of documents that are not cut yet: their chunks are counted by words, none is made."""
    both = _item_stats(items).crossJoin(docs.agg(F.coalesce(F.sum(chunk_count(F.col(text))), F.lit(0)).alias("chunks")))  # one row each
    return both.select("items", "frames", (F.col("items") - F.col("frames")).alias("regular"), "chunks")


def index_stats(items: DataFrame, chunks: DataFrame) -> DataFrame:
    a = _item_stats(items)
    b = chunks.agg(F.count("*").alias("chunks"), F.sum(F.octet_length("chunk_text")).alias("text_bytes"))
    both = a.crossJoin(b)  # one row each
    return both.select("items", "frames", (F.col("items") - F.col("frames")).alias("regular"), "chunks", F.round(F.coalesce("text_bytes", F.lit(0)) / F.lit(1048576.0), 6).alias("text_mb"))


def group_count_recent(rows: DataFrame, group: str, at: str, as_of: Column, days: int = 7) -> DataFrame:
    recent = F.col(at) >= as_of - F.make_dt_interval(F.lit(days))
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.count_if(recent).alias("recent"))


def recent_unique(rows: DataFrame, value: str, at: str, limit: int) -> DataFrame:
    return rows.groupBy(value).agg(F.max(at).alias("last_at")).orderBy(F.desc("last_at"), value).limit(limit)


def dirs_first(listing: DataFrame) -> DataFrame:
    return listing.orderBy(F.desc("is_dir"), "name")


def evict_oldest(cache: DataFrame, keep: int, at: str, key: str) -> DataFrame:
    """Rows beyond the keep last used: the keep newest are found by a bounded sort, the others by an anti-join."""
    held = cache.orderBy(F.desc(at), key).limit(keep).select(key)
    return cache.join(F.broadcast(held), key, "left_anti")
