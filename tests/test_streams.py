import datetime as dt
import io
import wave

import numpy as np
from pyspark.sql import functions as F

from lumenweave.functions import classify as C
from lumenweave.functions import media as M
from lumenweave.operators.tables import Snapshots, promote_json
from lumenweave.sources import files
from lumenweave.streaming import queue
from tests.test_operators import JOB, NOW, job


def test_queue_stream_works_through_its_jobs(spark, tmp_path):
    state = Snapshots(spark, str(tmp_path / "jobs"))
    state.publish(spark.createDataFrame([job(0, "running", ago=9999)], JOB))
    spark.createDataFrame([job(i, "pending", ago=50 - i) for i in range(1, 7)], JOB).repartition(3).write.parquet(str(tmp_path / "new"))
    new = spark.readStream.schema(JOB).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "new"))
    handler = lambda mine: mine.select("job_no", F.when(F.col("job_no") == 3, "failed").otherwise("completed").alias("status"), F.when(F.col("job_no") == 3, "busy").alias("message"))
    queue.work(new, state, handler, str(tmp_path / "cp"), lambda: F.lit(NOW).cast("timestamp_ntz")).awaitTermination(240)
    got = {r.job_no: r for r in state.read().collect()}
    assert sorted(got) == list(range(7))
    assert all(got[i].status == "completed" for i in got if i != 3)
    assert got[3].status == "pending" and got[3].retry_count == 1 and got[3].errors == ["busy"] and got[3].next_retry_at == NOW + dt.timedelta(seconds=30)


def test_queue_stream_loses_no_job_when_many_are_pending(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queue, "PENDING_CAP", 1, raising=False)
    state = Snapshots(spark, str(tmp_path / "jobs"))
    state.publish(spark.createDataFrame([job(i, "pending", ago=90 - i) for i in range(4)], JOB))
    spark.createDataFrame([job(i, "pending", ago=50 - i) for i in range(4, 8)], JOB).coalesce(1).write.parquet(str(tmp_path / "new"))
    new = spark.readStream.schema(JOB).parquet(str(tmp_path / "new"))
    handler = lambda mine: mine.select("job_no", F.lit("completed").alias("status"), F.lit(None).cast("string").alias("message"))
    queue.work(new, state, handler, str(tmp_path / "cp"), lambda: F.lit(NOW).cast("timestamp_ntz"), batch=2).awaitTermination(240)
    assert sorted(r.job_no for r in state.read().collect()) == list(range(8))


def test_wav_files(spark):
    rows = []
    for width in (1, 2, 3, 4):
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(2)
            w.setsampwidth(width)
            w.setframerate(8000)
            top = 1 << (8 * width - 1)
            values = [0, top // 2, -top // 2, top // 4]
            w.writeframes(b"".join((v + 128).to_bytes(1, "little") if width == 1 else v.to_bytes(width, "little", signed=True) for v in values))
        rows.append((str(width), bytearray(out.getvalue())))
    got = {r.path: r for r in files.read_wav(spark.createDataFrame([*rows, ("bad", bytearray(b"x")), ("none", None)], "path string, content binary")).collect()}
    for width in "1234":
        assert got[width].rate == 8000 and got[width].channels == 2 and np.allclose(got[width].samples, [0, 0.5, -0.5, 0.25])
    assert got["bad"].error and got["none"].error and got["bad"].samples is None


def test_rows_of_frames_and_images(spark):
    row = spark.createDataFrame([("/a/b.mp4", 3, 640, 480)], "p string, n long, w long, h long")
    f = row.select(M.frame_row(F.col("p"), F.col("n"), F.lit(0.5), F.col("w"), F.col("h"), F.lit(9.0)).alias("f")).first().f
    assert f.id == "_a_b_mp4:frame:3" and f.timestamp == 6.0
    meta = row.select(M.image_metadata(F.col("w"), F.col("h"), F.lit(7).cast("long")).alias("metadata"))
    got = promote_json(meta).first()
    assert (got.width, got.height, got.aspect_ratio, got.fs_size) == (640, 480, 1.3333, 7)
    assert spark.createDataFrame([(f.id, f.metadata)], "i string, m string").select(C.is_frame(F.col("i"), F.lit(None), F.col("m"), F.lit(None), F.lit(None))).first()[0]


def test_handler_works_once_a_batch(spark, tmp_path):
    state = Snapshots(spark, str(tmp_path / "jobs"))
    state.publish(spark.createDataFrame([job(i, "pending", ago=90 - i) for i in range(4)], JOB))
    spark.createDataFrame([job(4, "pending", ago=50)], JOB).coalesce(1).write.parquet(str(tmp_path / "new"))
    seen = spark.sparkContext.accumulator(0)

    def handle(batches):
        for rows in batches:
            seen.add(len(rows))
            yield rows.assign(status=["completed" if n % 2 else "failed" for n in rows["job_no"]], message="broken pipe")

    handler = lambda mine: mine.select("job_no").mapInPandas(handle, "job_no long, status string, message string")
    new = spark.readStream.schema(JOB).parquet(str(tmp_path / "new"))
    queue.work(new, state, handler, str(tmp_path / "cp"), lambda: F.lit(NOW).cast("timestamp_ntz"), batch=4).awaitTermination(240)
    assert seen.value == 4
    assert sum(r.status == "completed" for r in state.read().collect()) == 2
