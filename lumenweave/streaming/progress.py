"""What a stream tells of its work: an event a batch of it, and an event for jobs that a batch created."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

ATTEMPTS = 3
SAMPLE = 100


def emit(send: Callable[[str, dict], None], event: str, payload: dict, attempts: int = ATTEMPTS, wait: float = 0.1) -> bool:
    """Sends an event, again after a failure, waiting longer each time; False after the last."""
    for n in range(1, attempts + 1):
        try:
            send(event, payload)
            return True
        except Exception:  # noqa: BLE001  a receiver that fails must not stop the stream
            if n < attempts:
                time.sleep(wait * n)
    return False


class Progress(StreamingQueryListener):
    """Register with spark.streams.addListener; send(event, payload) gets started, progress and ended."""

    def __init__(self, send: Callable[[str, dict], None]):
        self.send = send

    def onQueryStarted(self, event) -> None:
        emit(self.send, "started", {"query": str(event.runId)})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        emit(self.send, "progress", {"query": str(p.runId), "batch": p.batchId, "rows": p.numInputRows, "seconds": p.batchDuration / 1000})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        emit(self.send, "ended", {"query": str(event.runId), "error": event.exception})


def created_event(created: DataFrame, so_far: int, key: str = "job_no", sample: int = SAMPLE) -> DataFrame:
    """One row for the jobs that one batch created: how many, how many with so_far, and the first sample keys. No key beyond them is gathered."""
    total = created.agg(F.count("*").alias("total_jobs"))
    some = created.select(key).orderBy(key).limit(sample).agg(F.sort_array(F.collect_list(key)).alias("sample_job_ids"))
    both = total.crossJoin(some)  # one row each
    return both.select("total_jobs", "sample_job_ids", (F.col("total_jobs") + F.lit(so_far)).alias("total_jobs_created_so_far"))
