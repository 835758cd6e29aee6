"""The work queue as a stream: each batch of new jobs is queued, due jobs are claimed and worked on, and the table is published.

Every batch is taken in whole, for a stream does not offer its rows again; intake is bounded by
the source (maxFilesPerTrigger). A batch claims once; with ticking() batches come though nothing
new does, so the queue drains and retries fire. timed_queue keeps the jobs as state instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenweave.operators import jobs as J
from lumenweave.operators.tables import Snapshots

#: Jobs claimed at once.
BATCH = 8


def settle_results(jobs: DataFrame, results: DataFrame, as_of: Column, key: str = "job_no") -> DataFrame:
    """results: key, status (completed or failed), message. Completed jobs end; failed ones wait for their retry or end."""
    done = J.apply_progress(jobs, results.where("status = 'completed'").select(key, "status"), as_of, key)
    bad = results.where("status = 'failed'").select(key, F.col("message").alias("__message"))
    marked = done.join(bad, key, "left")
    return J.schedule_retry(marked, F.col("__message").isNotNull(), F.col("__message"), as_of).select(*jobs.columns)


def ticking(new_jobs: DataFrame, per_second: int = 1) -> DataFrame:
    """The stream with a clock beside it that adds no rows, so that every trigger has a batch."""
    clock = new_jobs.sparkSession.readStream.format("rate").option("rowsPerSecond", per_second).load().where("value < 0")
    return new_jobs.unionByName(clock.select(*(F.lit(None).cast(t).alias(c) for c, t in new_jobs.dtypes)))


def work(new_jobs: DataFrame, state: Snapshots, handler: Callable[[DataFrame], DataFrame], checkpoint: str, clock: Callable[[], Column], worker: int = 1, batch: int = BATCH, stale_seconds: int = 600, paused: Callable[[], bool] = lambda: False, keep_days: int | None = None, **trigger) -> StreamingQuery:
    """new_jobs: a stream of rows like the table's. handler gets the claimed jobs and returns job_no, status, message. The table must be published once before.

    While paused() is true jobs are queued, and what the worker holds is given back; nothing is worked on.
    keep_days: jobs that ended longer ago leave the table.
    """

    def step(rows: DataFrame, number: int) -> None:
        now = clock()
        jobs = J.recover_orphans(state.read(), now, stale_seconds)
        jobs = jobs.unionByName(J.create_jobs(jobs, rows), allowMissingColumns=True)
        if keep_days is not None:
            jobs = J.retain(jobs, now, keep_days)
        if paused():
            state.publish(J.release(jobs, worker, now))
            return
        state.publish(J.claim(jobs, worker, batch, now))
        if paused():  # asked for while jobs were claimed
            state.publish(J.release(state.read(), worker, clock()))
            return
        claimed = state.read()
        mine = claimed.where((F.col("status") == "running") & (F.col("current_file") == f"worker_{worker}"))
        # written once, as they are used twice: the handler's work is not done again
        results = f"{checkpoint.rstrip('/')}/results/{number % 2}"
        handler(mine).select("job_no", "status", "message").write.mode("overwrite").parquet(results)
        state.publish(settle_results(claimed, rows.sparkSession.read.parquet(results), clock()))

    return new_jobs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
