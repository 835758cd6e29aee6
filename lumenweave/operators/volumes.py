"""Volumes: prefixes of paths, statistics, what came and went."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def on_volume(files: DataFrame, volumes: DataFrame, path: str = "file_path") -> DataFrame:
    """Each path with the volume of the longest mount path above it (or at it), null without one.

    A path's ancestors are its possible mounts, so an equality join finds them; a path has
    as many as it has parts. No prefix is compared with every row.
    """
    parts = F.split(F.col(path), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    paths = files.select(path).distinct().withColumn("__above", F.explode(above)).where("__above <> ''")
    v = volumes.select(F.regexp_replace("mount_path", "/+$", "").alias("__above"), F.col("uuid").alias("volume_uuid"))
    found = paths.join(v, "__above").groupBy(path).agg(F.max(F.struct(F.length("__above").alias("n"), F.col("volume_uuid"))).alias("__v"))
    return files.join(found.select(path, F.col("__v.volume_uuid").alias("volume_uuid")), path, "left")


def volume_stats(volumes: DataFrame, items: DataFrame) -> DataFrame:
    """Files and bytes of metadata per volume; 0 without any."""
    n = items.groupBy(F.col("drive_uuid").alias("uuid")).agg(F.countDistinct("file_path").alias("files"), F.sum(F.length("metadata")).cast("long").alias("metadata_length"))
    return volumes.join(n, "uuid", "left").select("uuid", "name", "status", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("metadata_length", F.lit(0)).alias("metadata_length"))


def deletable_volumes(volumes: DataFrame, items: DataFrame) -> DataFrame:
    """Volumes that no file refers to."""
    used = items.where(F.col("drive_uuid").isNotNull()).select(F.col("drive_uuid").alias("uuid"))
    return volumes.join(used, "uuid", "left_anti")


def sync_diff(connected: DataFrame, stored: DataFrame) -> DataFrame:
    """uuid and action: insert (new), reconnect, disconnect (gone), keep. Both have uuid; stored has status."""
    c = connected.select("uuid", F.lit(True).alias("__here"))
    s = stored.select("uuid", F.col("status").alias("__status"), F.lit(True).alias("__known"))
    action = (
        F.when(F.col("__known").isNull(), "insert").when(F.col("__here").isNull() & (F.col("__status") == "connected"), "disconnect")
        .when(F.col("__here").isNotNull() & (F.col("__status") != "connected"), "reconnect").otherwise("keep")
    )
    return c.join(s, "uuid", "full_outer").select("uuid", action.alias("action"))


def add_volume(volumes: DataFrame, mounts: DataFrame, uuid: str, name: str, mount_path: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """A new volume and its first mount; a known uuid is an error."""
    if volumes.where(F.col("uuid") == uuid).limit(1).count():
        raise ValueError(f"volume {uuid} is known")
    spark = volumes.sparkSession
    row = spark.range(1).select(F.lit(uuid).alias("uuid"), F.lit(name).alias("name"), F.lit(mount_path).alias("mount_path"), F.lit("connected").alias("status"))
    mount = spark.range(1).select(F.lit(uuid).alias("drive_uuid"), F.lit(mount_path).alias("mount_path"), at.alias("mounted_at"), F.lit(None).cast("timestamp").alias("unmounted_at"))
    return volumes.unionByName(row, allowMissingColumns=True), mounts.unionByName(mount, allowMissingColumns=True)


def set_status(volumes: DataFrame, updates: DataFrame) -> DataFrame:
    """updates: uuid, status, mount_path. Nulls overwrite; a volume that goes loses its mount path."""
    u = updates.select("uuid", F.col("status").alias("__s"), F.col("mount_path").alias("__m"), F.lit(True).alias("__u"))
    hit = F.col("__u").isNotNull()
    gone = F.when(F.col("__s") == "disconnected", F.lit(None)).otherwise(F.col("__m"))
    out = volumes.join(u, "uuid", "left").withColumns({"status": F.when(hit, F.col("__s")).otherwise(F.col("status")), "mount_path": F.when(hit, gone).otherwise(F.col("mount_path"))})
    return out.select(*volumes.columns)


def set_metadata(volumes: DataFrame, updates: DataFrame, at: Column) -> DataFrame:
    """updates: uuid, custom_name, physical_location. Nulls overwrite; last_seen becomes at."""
    u = updates.select("uuid", F.col("custom_name").alias("__c"), F.col("physical_location").alias("__l"), F.lit(True).alias("__u"))
    hit = F.col("__u").isNotNull()
    new = {"custom_name": F.col("__c"), "physical_location": F.col("__l"), "last_seen": at}
    out = volumes.join(u, "uuid", "left").withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()})
    return out.select(*volumes.columns)


def rank_by_status(rows: DataFrame, status: str, order: list, cap: dict[str, int] | int) -> DataFrame:
    """The first rows of each status, up to its cap: those of each of SALTS parts of a status, then of what they leave."""
    limit = F.lit(cap) if isinstance(cap, int) else F.coalesce(*(F.when(F.col(status) == k, v) for k, v in cap.items()), F.lit(0))
    part = Window.partitionBy(status, "__salt").orderBy(*order)
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)))
    rows = salted.withColumn("__r", F.row_number().over(part)).where(F.col("__r") <= limit).select(*rows.columns)
    rank = Window.partitionBy(status).orderBy(*order)
    return rows.withColumn("rank_in_status", F.row_number().over(rank).cast("long")).where(F.col("rank_in_status") <= limit)
