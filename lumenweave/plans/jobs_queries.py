"""The work queue and watched folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.functions import classify as C
from lumenweave.operators import jobs as J
from lumenweave.operators import volumes as V
from lumenweave.operators import watch as W
from lumenweave.plans.base import NOW_SQL, now, query
from lumenweave.sources.views import ctes, view

_JOBS = ctes("jobs")


def _jobs(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "jobs")


_AGE = "greatest(CAST(floor(epoch({n})) AS BIGINT) - CAST(floor(epoch({c})) AS BIGINT), 0)"
_HEALTH = f"""h AS (SELECT count(*) AS total, {', '.join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in ('pending', 'running', 'completed', 'failed', 'cancelled'))},
count(*) FILTER (WHERE status = 'pending' AND next_retry_at > {NOW_SQL}) AS retry_scheduled, count(*) FILTER (WHERE status = 'pending' AND next_retry_at <= {NOW_SQL}) AS retry_ready,
count(*) FILTER (WHERE status = 'running' AND updated_at < {NOW_SQL} - INTERVAL 600 SECOND) AS stale_running, count(*) FILTER (WHERE status = 'pending' AND current_file LIKE 'worker_%' AND updated_at < {NOW_SQL} - INTERVAL 600 SECOND) AS orphaned_pending_claims,
count(*) FILTER (WHERE status = 'completed' AND completed_at >= {NOW_SQL} - INTERVAL 1 HOUR) AS completed_last_hour, count(*) FILTER (WHERE status = 'failed' AND completed_at >= {NOW_SQL} - INTERVAL 1 HOUR) AS failed_last_hour,
{_AGE.format(n=NOW_SQL, c="min(CASE WHEN status = 'pending' THEN created_at END)")} AS oldest_pending_age_s, {_AGE.format(n=NOW_SQL, c="min(CASE WHEN status = 'running' THEN created_at END)")} AS longest_running_age_s, {_AGE.format(n=NOW_SQL, c='max(updated_at)')} AS last_update_age_s FROM jobs)"""


@query(f"{_JOBS}, {_HEALTH} SELECT * FROM h")
def queue_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.queue_health(_jobs(spark, sf_dir), now(), 600)


@query(f"{_JOBS}, {_HEALTH} SELECT CASE WHEN stale_running > 0 OR orphaned_pending_claims > 0 THEN 'Degraded' WHEN retry_scheduled > 0 OR failed_last_hour > 0 THEN 'Warning' ELSE 'Healthy' END AS health FROM h")
def queue_health_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.health_label(J.queue_health(_jobs(spark, sf_dir), now(), 600)).select("health")


@query(f"""{_JOBS}, wanted AS (SELECT DISTINCT job_type, target_path FROM jobs WHERE job_no % 7 = 0)
SELECT w.job_type, w.target_path FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.job_type = w.job_type AND j.target_path = w.target_path AND j.status IN ('pending', 'running'))""")
def create_jobs_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = _jobs(spark, sf_dir)
    return J.create_jobs(jobs, jobs.where("job_no % 7 = 0").select("job_type", "target_path"))


@query(f"""{_JOBS}, u AS (SELECT job_no, CASE WHEN job_no % 2 = 0 THEN 'completed' ELSE 'running' END AS status, CASE WHEN job_no % 3 = 0 THEN 'x.jpg' END AS current_file FROM jobs WHERE job_no % 4 = 1 OR job_no % 6 = 0)
SELECT j.job_no, coalesce(u.status, j.status) AS status, coalesce(u.current_file, j.current_file) AS current_file, CASE WHEN u.status = 'completed' THEN {NOW_SQL} ELSE j.completed_at END AS completed_at, CASE WHEN u.job_no IS NOT NULL THEN {NOW_SQL} ELSE j.updated_at END AS updated_at FROM jobs j LEFT JOIN u USING (job_no)""")
def apply_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = _jobs(spark, sf_dir)
    n = F.col("job_no")
    u = jobs.where("job_no % 4 = 1 OR job_no % 6 = 0").select("job_no", F.when(n % 2 == 0, "completed").otherwise("running").alias("status"), F.when(n % 3 == 0, "x.jpg").alias("current_file"))
    return J.apply_progress(jobs, u, now()).select("job_no", "status", "current_file", "completed_at", "updated_at")


@query(f"{_JOBS} SELECT job_no, CASE WHEN status = 'pending' AND target_path ILIKE '/volumes/v1/%' THEN 'cancelled' ELSE status END AS status FROM jobs")
def cancel_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.cancel_by_prefix(_jobs(spark, sf_dir), "/volumes/v1/", now()).select("job_no", "status")


@query(f"""{_JOBS}, n AS (SELECT *, retry_count + 1 AS k, status = 'failed' AS hit FROM jobs)
SELECT job_no, CASE WHEN NOT hit THEN status WHEN k <= max_retries THEN 'pending' ELSE 'failed' END AS status, CASE WHEN hit AND k <= max_retries THEN k ELSE retry_count END AS retry_count,
CASE WHEN hit AND k <= max_retries THEN {NOW_SQL} + CASE k WHEN 1 THEN INTERVAL 30 SECOND WHEN 2 THEN INTERVAL 120 SECOND ELSE INTERVAL 480 SECOND END ELSE next_retry_at END AS next_retry_at FROM n""")
def retry_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.schedule_retry(_jobs(spark, sf_dir), F.col("status") == "failed", F.lit("again"), now()).select("job_no", "status", "retry_count", "next_retry_at")


@query(f"""{_JOBS}, mine AS (SELECT job_no FROM jobs WHERE status = 'pending' AND (next_retry_at IS NULL OR next_retry_at <= {NOW_SQL}) ORDER BY created_at, job_no LIMIT 8)
SELECT job_no, CASE WHEN job_no IN (SELECT job_no FROM mine) THEN 'running' ELSE status END AS status, CASE WHEN job_no IN (SELECT job_no FROM mine) THEN 'worker_1' ELSE current_file END AS current_file FROM jobs""")
def claim_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.claim(_jobs(spark, sf_dir), 1, 8, now()).select("job_no", "status", "current_file")


@query(f"""{_JOBS}, o AS (SELECT *, (status = 'running' OR (status = 'pending' AND coalesce(current_file LIKE 'worker_%', false))) AND updated_at < {NOW_SQL} - INTERVAL 86400 SECOND AS hit FROM jobs)
SELECT job_no, CASE WHEN hit THEN 'pending' ELSE status END AS status, CASE WHEN NOT hit THEN current_file END AS current_file FROM o""")
def recover_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.recover_orphans(_jobs(spark, sf_dir), now(), 86400).select("job_no", "status", "current_file")


@query(f"{_JOBS} SELECT job_no, status FROM jobs WHERE NOT (status IN ('completed', 'failed', 'cancelled') AND coalesce(completed_at, updated_at) < {NOW_SQL} - INTERVAL 7 DAY)")
def retention_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.retain(_jobs(spark, sf_dir), now(), 7).select("job_no", "status")


@query(f"{_JOBS} SELECT job_no, created_at FROM jobs ORDER BY created_at DESC, job_no DESC LIMIT 25")
def recent_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.recent(_jobs(spark, sf_dir), 25).select("job_no", "created_at")


@query(f"{_JOBS} SELECT job_no, created_at FROM jobs WHERE status = 'failed' ORDER BY created_at DESC, job_no DESC LIMIT 25")
def jobs_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.recent(_jobs(spark, sf_dir), 25, "failed").select("job_no", "created_at")


@query(rf"{_JOBS} SELECT regexp_extract(target_path, '^(.*)/[^/]*$', 1) AS folder, count(*) AS n FROM jobs WHERE status = 'pending' GROUP BY 1 ORDER BY n DESC, folder LIMIT 15")
def pending_by_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.pending_groups(_jobs(spark, sf_dir), C.parent_path(F.col("target_path")), "folder", 15)


@query(rf"{_JOBS} SELECT regexp_extract(target_path, '\.([^.]+)$', 1) AS ext, count(*) AS n FROM jobs WHERE status = 'pending' GROUP BY 1 ORDER BY n DESC, ext LIMIT 6")
def pending_by_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.pending_groups(_jobs(spark, sf_dir), C.extension(F.col("target_path")), "ext", 6)


@query(f"{_JOBS} SELECT * FROM (SELECT job_no, status, row_number() OVER (PARTITION BY status ORDER BY created_at DESC, job_no) AS rank_in_status FROM jobs) WHERE rank_in_status <= CASE status WHEN 'pending' THEN 50 WHEN 'running' THEN 20 WHEN 'failed' THEN 20 WHEN 'completed' THEN 10 ELSE 0 END")
def topn_per_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    caps = {"pending": 50, "running": 20, "failed": 20, "completed": 10}
    return V.rank_by_status(_jobs(spark, sf_dir).select("job_no", "status", "created_at"), "status", [F.desc("created_at"), "job_no"], caps).drop("created_at")


@query(f"{_JOBS} SELECT job_no, CASE WHEN job_type = 'transcription' THEN 'audio' WHEN target_path LIKE '%.mp4' THEN 'video' WHEN target_path LIKE '%.pdf' THEN 'text' WHEN target_path LIKE '%.jpg' THEN 'image' ELSE 'unsupported' END AS route FROM jobs")
def route_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jobs(spark, sf_dir).select("job_no", C.route_job(F.col("job_type"), F.col("target_path")).alias("route"))


@query(f"{_JOBS}, v AS (SELECT job_no, created_at FROM jobs WHERE job_type <> 'transcription' AND target_path LIKE '%.mp4' AND status = 'running') SELECT job_no FROM v QUALIFY row_number() OVER (ORDER BY created_at, job_no) > 1")
def excess_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _jobs(spark, sf_dir).where("status = 'running'").withColumn("route", C.route_job(F.col("job_type"), F.col("target_path")))
    return J.excess(rows, "video").select("job_no")


_SNAP = ctes("snap_old", "snap_new")
_DIFF = """d AS (SELECT coalesce(n.folder_id, o.folder_id) AS folder_id, coalesce(n.file_path, o.file_path) AS file_path, n.content_sig, o.last_index_job_id,
CASE WHEN o.file_path IS NULL THEN 'new' WHEN n.file_path IS NULL THEN 'removed' WHEN n.content_sig = o.content_sig THEN 'unchanged' ELSE 'changed' END AS state FROM snap_new n FULL JOIN snap_old o ON n.folder_id = o.folder_id AND n.file_path = o.file_path)"""


def _snaps(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return view(spark, sf_dir, "snap_new"), view(spark, sf_dir, "snap_old")


@query(f"{_SNAP}, {_DIFF} SELECT folder_id, file_path, content_sig, state FROM d WHERE state IN ('new', 'changed')")
def snapshot_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.changed(*_snaps(spark, sf_dir))


@query(f"{_SNAP}, {_DIFF} SELECT folder_id, file_path FROM d WHERE state = 'removed'")
def snapshot_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.removed(*_snaps(spark, sf_dir)).select("folder_id", "file_path")


@query(f"""{_SNAP}, n AS (SELECT folder_id, file_path, content_sig, CASE WHEN page_id % 2 = 0 THEN concat('job-', page_id) END AS job FROM snap_new)
SELECT coalesce(n.folder_id, o.folder_id) AS folder_id, coalesce(n.file_path, o.file_path) AS file_path, CASE WHEN n.file_path IS NOT NULL THEN n.content_sig ELSE o.content_sig END AS content_sig, coalesce(n.job, o.last_index_job_id) AS last_index_job_id FROM n FULL JOIN snap_old o ON n.folder_id = o.folder_id AND n.file_path = o.file_path""")
def snapshot_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, old = _snaps(spark, sf_dir)
    return W.upsert(old, new.withColumn("last_index_job_id", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("job-"), F.col("page_id").cast("string")))))


@query(f"{_SNAP}, {_DIFF} SELECT folder_id, count(*) FILTER (WHERE state <> 'removed') AS scanned, count(*) FILTER (WHERE state IN ('new', 'changed')) AS queued, count(*) FILTER (WHERE state = 'unchanged') AS unchanged, count(*) FILTER (WHERE state = 'removed') AS removed FROM d GROUP BY folder_id")
def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.summary(*_snaps(spark, sf_dir))


@query(f"{ctes('items')} SELECT id, file_path FROM items WHERE item_no % 9 = 0")
def stale_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenweave.operators.tables import delete_keys

    items = view(spark, sf_dir, "items").select("item_no", "id", "file_path")
    live = items.where("item_no % 9 <> 0").select("id")
    return delete_keys(items, live, ["id"]).select("id", "file_path")
