"""The work queue as a table: each change of state is a function from table to table.

Times are columns or literals (as_of); nothing reads the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIVE, TERMINAL = ("pending", "running"), ("completed", "failed", "cancelled")
# Seconds before the first, second and later retries.
BACKOFF = (30, 120, 480)


def _ago(as_of: Column, seconds: int) -> Column:
    return as_of - F.make_dt_interval(secs=F.lit(float(seconds)))


def _claimed() -> Column:
    """A worker's marker; '_' stands for any character, and case does not count."""
    return F.coalesce(F.col("current_file").ilike("worker_%"), F.lit(False))


def due(as_of: Column) -> Column:
    return (F.col("status") == "pending") & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= as_of))


def queue_health(jobs: DataFrame, as_of: Column, stale_seconds: int) -> DataFrame:
    """Counts and ages in one pass."""
    is_ = lambda s: F.col("status") == s
    stale, hour = F.col("updated_at") < _ago(as_of, stale_seconds), F.col("completed_at") >= _ago(as_of, 3600)
    age = lambda c: F.greatest(F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(c.cast("timestamp")), F.lit(0).cast("long"))
    started = F.coalesce(F.col("started_at"), F.col("created_at")) if "started_at" in jobs.columns else F.col("created_at")
    return jobs.agg(
        F.count("*").alias("total"), *(F.count_if(is_(s)).alias(s) for s in (*ACTIVE, *TERMINAL)),
        F.count_if(is_("pending") & (F.col("next_retry_at") > as_of)).alias("retry_scheduled"), F.count_if(is_("pending") & (F.col("next_retry_at") <= as_of)).alias("retry_ready"),
        F.count_if(is_("running") & stale).alias("stale_running"), F.count_if(is_("pending") & _claimed() & stale).alias("orphaned_pending_claims"),
        F.count_if(is_("completed") & hour).alias("completed_last_hour"), F.count_if(is_("failed") & hour).alias("failed_last_hour"),
        age(F.min(F.when(is_("pending"), F.col("created_at")))).alias("oldest_pending_age_s"), age(F.min(F.when(is_("running"), started))).alias("longest_running_age_s"), age(F.max("updated_at")).alias("last_update_age_s"),
    )


def health_label(health: DataFrame) -> DataFrame:
    label = F.when((F.col("stale_running") > 0) | (F.col("orphaned_pending_claims") > 0), "Degraded").when((F.col("retry_scheduled") > 0) | (F.col("failed_last_hour") > 0), "Warning").otherwise("Healthy")
    return health.withColumn("health", label)


def create_jobs(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Those of wanted (job_type, target_path, ...) without an active job of the same type and path, once each."""
    active = jobs.where(F.col("status").isin(*ACTIVE)).select("job_type", "target_path")
    return wanted.dropDuplicates(["job_type", "target_path"]).join(active, ["job_type", "target_path"], "left_anti")


def apply_progress(jobs: DataFrame, updates: DataFrame, as_of: Column, key: str = "job_no") -> DataFrame:
    """updates: key, status and any of current_file, processed, errors, failed_files. Nulls keep what was there."""
    names = [c for c in updates.columns if c != key]
    u = updates.select(key, *(F.col(c).alias(f"__{c}") for c in names), F.lit(True).alias("__u"))
    out = jobs.join(u, key, "left")
    hit, status = F.col("__u").isNotNull(), F.coalesce(F.col("__status"), F.col("status"))
    new = {c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in names}
    if "started_at" in jobs.columns:
        new["started_at"] = F.when(hit & (status == "running"), F.coalesce("started_at", as_of)).otherwise(F.col("started_at"))
    new["completed_at"] = F.when(hit & status.isin(*TERMINAL), as_of).otherwise(F.col("completed_at"))
    new["updated_at"] = F.when(hit, as_of).otherwise(F.col("updated_at"))
    return out.withColumns(new).select(*jobs.columns)


def cancel_by_prefix(jobs: DataFrame, prefix: str, as_of: Column) -> DataFrame:
    """Pending jobs whose path begins so (case does not count) are cancelled."""
    plain = prefix.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    hit = (F.col("status") == "pending") & F.col("target_path").ilike(f"{plain}%")
    return jobs.withColumns({"completed_at": F.when(hit, as_of).otherwise(F.col("completed_at")), "updated_at": F.when(hit, as_of).otherwise(F.col("updated_at")), "status": F.when(hit, "cancelled").otherwise(F.col("status"))})


def cancel(jobs: DataFrame, keys: list, as_of: Column, key: str = "job_no") -> DataFrame:
    hit = F.col(key).isin(keys)
    return jobs.withColumns({"completed_at": F.when(hit, as_of).otherwise(F.col("completed_at")), "status": F.when(hit, "cancelled").otherwise(F.col("status"))})


def schedule_retry(jobs: DataFrame, failed: Column, message: Column, as_of: Column) -> DataFrame:
    """Rows of failed wait 30, 120, then 480 seconds; past max_retries they have failed. The message joins errors (array)."""
    n = F.col("retry_count") + 1
    again = n <= F.col("max_retries")
    wait = F.when(n == 1, BACKOFF[0]).when(n == 2, BACKOFF[1]).otherwise(BACKOFF[2])
    later = as_of + F.make_dt_interval(secs=wait.cast("double"))
    new = {
        "status": F.when(again, "pending").otherwise("failed"),
        "next_retry_at": F.when(again, later).otherwise(F.col("next_retry_at")),
        "completed_at": F.when(again, F.col("completed_at")).otherwise(as_of),
        "updated_at": as_of,
    }
    if "errors" in jobs.columns:
        said = F.when(again, message).otherwise(F.concat(F.lit("Failed after maximum retries: "), message))
        new["errors"] = F.array_append(F.coalesce("errors", F.array().cast("array<string>")), said)
    new["retry_count"] = F.when(again, n).otherwise(F.col("retry_count"))
    return jobs.withColumns({c: F.when(failed, v).otherwise(F.col(c)) for c, v in new.items()})


def manual_retry(jobs: DataFrame, keys: list, as_of: Column, key: str = "job_no") -> DataFrame:
    hit = F.col(key).isin(keys)
    new = {"status": F.lit("pending"), "retry_count": F.lit(0), "next_retry_at": F.lit(None), "updated_at": as_of}
    return jobs.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()})


def claim(jobs: DataFrame, worker: int, limit: int, as_of: Column, key: str = "job_no") -> DataFrame:
    """The oldest limit due jobs become running, marked with the worker. One writer at a time."""
    ids = jobs.where(due(as_of)).orderBy("created_at", key).limit(limit).select(key, F.lit(True).alias("__mine"))
    out = jobs.join(F.broadcast(ids), key, "left")  # limit rows
    hit = F.col("__mine").isNotNull()
    new = {"status": F.lit("running"), "current_file": F.lit(f"worker_{worker}"), "updated_at": as_of}
    if "started_at" in jobs.columns:
        new["started_at"] = F.coalesce("started_at", as_of)
    return out.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()}).select(*jobs.columns)


def recover_orphans(jobs: DataFrame, as_of: Column, timeout_seconds: int) -> DataFrame:
    """Running jobs, and pending ones with a worker's marker, not updated within the timeout, are pending again without marker."""
    old = F.col("updated_at").isNull() | (F.col("updated_at") < _ago(as_of, timeout_seconds))
    hit = F.coalesce(((F.col("status") == "running") | ((F.col("status") == "pending") & _claimed())) & old, F.lit(False))
    new = {"status": F.lit("pending"), "current_file": F.lit(None), "updated_at": as_of}
    return jobs.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()})


def retain(jobs: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Without terminal jobs that ended (or were last updated) before the cutoff."""
    cutoff = as_of - F.make_dt_interval(F.lit(days))
    old = F.col("status").isin(*TERMINAL) & (F.coalesce("completed_at", "updated_at") < cutoff)
    return jobs.where(~F.coalesce(old, F.lit(False)))


def clear_active(jobs: DataFrame) -> DataFrame:
    return jobs.where(~F.col("status").isin(*ACTIVE))


def clear_all(jobs: DataFrame) -> DataFrame:
    """No job is left; the columns stay."""
    return jobs.limit(0)


def recent(jobs: DataFrame, limit: int, status: str | None = None, key: str = "job_no") -> DataFrame:
    rows = jobs if status is None else jobs.where(F.col("status") == status)
    return rows.orderBy(F.desc("created_at"), F.desc(key)).limit(limit)


def pending_groups(jobs: DataFrame, by: Column, name: str, limit: int) -> DataFrame:
    """The largest groups of pending jobs."""
    return jobs.where("status = 'pending'").groupBy(by.alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name).limit(limit)


def excess(jobs: DataFrame, route: str, keep: int = 1, key: str = "job_no") -> DataFrame:
    """Claimed jobs of a route beyond the first keep, to be given back as pending."""
    mine = jobs.where(F.col("route") == route)
    return mine.join(mine.orderBy("created_at", key).limit(keep).select(key), key, "left_anti")


def attribute_errors(batch: DataFrame, errors: DataFrame) -> DataFrame:
    """Each job of a batch with the message that was reported for its path: status completed or failed, and category."""
    from lumenweave.functions.classify import categorize_error

    said = errors.groupBy(F.col("path").alias("target_path")).agg(F.min("message").alias("message"))
    out = batch.join(said, "target_path", "left")
    failed = F.col("message").isNotNull()
    return out.withColumns({"status": F.when(failed, "failed").otherwise("completed"), "category": F.when(failed, categorize_error(F.col("message")))})


def tally(results: DataFrame) -> DataFrame:
    """Counts of a batch's outcomes."""
    return results.agg(F.count_if(F.col("status") == "completed").alias("successful"), F.count_if(F.col("status") == "failed").alias("failed"), F.count("*").alias("total"))


def release(jobs: DataFrame, worker: int, as_of: Column) -> DataFrame:
    """What a paused worker had claimed is pending again."""
    hit = (F.col("status") == "running") & (F.col("current_file") == f"worker_{worker}")
    new = {"status": F.lit("pending"), "current_file": F.lit(None), "updated_at": as_of}
    return jobs.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()})
