"""Watched folders: the difference of two listings, and what it does to the stored state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["folder_id", "file_path"]


def signature(size: Column, mtime_ms: Column) -> Column:
    return F.concat_ws(":", size.cast("string"), mtime_ms.cast("string"))


def diff(now: DataFrame, stored: DataFrame) -> DataFrame:
    """folder_id, file_path, content_sig (of now), last_index_job_id (stored) and state: new, changed, unchanged, removed."""
    n = now.select(*KEY, "content_sig", F.lit(True).alias("__now"))
    s = stored.select(*KEY, F.col("content_sig").alias("__old_sig"), "last_index_job_id", F.lit(True).alias("__old"))
    state = F.when(F.col("__old").isNull(), "new").when(F.col("__now").isNull(), "removed").when(F.col("content_sig").eqNullSafe(F.col("__old_sig")), "unchanged").otherwise("changed")
    return n.join(s, KEY, "full_outer").select(*KEY, "content_sig", "last_index_job_id", state.alias("state"))


def changed(now: DataFrame, stored: DataFrame) -> DataFrame:
    return diff(now, stored).where("state IN ('new', 'changed')").select(*KEY, "content_sig", "state")


def removed(now: DataFrame, stored: DataFrame) -> DataFrame:
    return stored.join(now.select(*KEY), KEY, "left_anti")


def upsert(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """Stored state after a scan saw rows (content_sig, last_index_job_id): a null job keeps the old one."""
    n = seen.select(*KEY, F.col("content_sig").alias("__sig"), F.col("last_index_job_id").alias("__job"), F.lit(True).alias("__n"))
    out = stored.select(*KEY, "content_sig", "last_index_job_id").join(n, KEY, "full_outer")
    return out.select(*KEY, F.when(F.col("__n").isNotNull(), F.col("__sig")).otherwise(F.col("content_sig")).alias("content_sig"), F.coalesce("__job", "last_index_job_id").alias("last_index_job_id"))


def summary(now: DataFrame, stored: DataFrame) -> DataFrame:
    """Counts of one scan, per folder."""
    d = diff(now, stored)
    is_ = lambda *s: F.count_if(F.col("state").isin(*s))
    return d.groupBy("folder_id").agg(is_("new", "changed", "unchanged").alias("scanned"), is_("new", "changed").alias("queued"), is_("unchanged").alias("unchanged"), is_("removed").alias("removed"))


def is_due(last_scan: Column, as_of: Column, seconds: int = 5) -> Column:
    """Never scanned, or so many seconds ago."""
    return last_scan.isNull() | (as_of - F.make_dt_interval(secs=F.lit(float(seconds))) >= last_scan)


def remove_folder(folders: DataFrame, state: DataFrame, folder_id: str) -> tuple[DataFrame, DataFrame]:
    """Without a folder and its state."""
    return folders.where(F.col("folder_id") != folder_id), state.where(F.col("folder_id") != folder_id)


def unindexed(found: DataFrame, *indexed: DataFrame) -> DataFrame:
    out = found
    for paths in indexed:
        out = out.join(paths.select("file_path"), "file_path", "left_anti")
    return out


def upsert_folder(folders: DataFrame, new: DataFrame) -> DataFrame:
    """new: path and settings. A known path keeps its folder_id and takes the new settings; nulls keep the old ones."""
    names = [c for c in folders.columns if c not in ("path", "folder_id")]
    n = new.select("path", F.col("folder_id").alias("__id"), *(F.col(c).alias(f"__{c}") for c in names))
    out = folders.join(n, "path", "full_outer")
    return out.select(F.coalesce("folder_id", "__id").alias("folder_id"), "path", *(F.coalesce(f"__{c}", c).alias(c) for c in names))


def set_scan(folders: DataFrame, folder_id: str, at: Column, status: Column) -> DataFrame:
    hit = F.col("folder_id") == folder_id
    return folders.withColumns({"last_scan_at": F.when(hit, at).otherwise(F.col("last_scan_at")), "status": F.when(hit, status).otherwise(F.col("status"))})


def set_enabled(folders: DataFrame, folder_id: str, enabled: bool, at: Column) -> DataFrame:
    """An enabled folder is watching, another paused."""
    hit = F.col("folder_id") == folder_id
    new = {"enabled": F.lit(enabled), "status": F.lit("watching" if enabled else "paused"), "updated_at": at}
    return folders.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()})
