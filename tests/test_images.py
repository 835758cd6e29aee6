"""Search by an image, frames kept row by row, and small table functions."""

import base64
import datetime as dt
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenweave.functions import images as I
from lumenweave.functions import media as M
from lumenweave.operators import jobs as J
from lumenweave.operators import search as S
from lumenweave.operators.tables import Snapshots
from lumenweave.sources import files
from lumenweave.streaming import queue
from tests.test_operators import JOB, job


def ppm(pixels):
    return b"P6\n# made\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.tobytes()


def picture(seed, h=60, w=90):
    rng = np.random.default_rng(seed)
    return np.kron(rng.integers(0, 256, (6, 9, 3)), np.ones((h // 6, w // 9, 1))).astype(np.uint8)


def test_an_image_finds_itself_and_its_like(spark):
    embedder = I.ColourEmbedder()
    noisy = np.clip(picture(3).astype(int) + np.random.default_rng(0).integers(-9, 9, (60, 90, 3)), 0, 255).astype(np.uint8)
    rows = [(f"/p/{i}.ppm", bytearray(ppm(picture(i)))) for i in range(20)] + [("/p/noisy.ppm", bytearray(ppm(noisy))), ("/p/bad.ppm", bytearray(b"GIF89a")), ("/p/none.ppm", None)]
    found = I.embed_images(spark.createDataFrame(rows, "path string, content binary"), embedder)
    assert {r.path: r.error for r in found.where("error IS NOT NULL").collect()}.keys() == {"/p/bad.ppm", "/p/none.ppm"}
    assert {(r.width, r.height) for r in found.where("error IS NULL").collect()} == {(90, 60)}
    items = found.select(F.col("path").alias("id"), "embedding")
    got = I.search_by_image(items, base64.b64encode(ppm(picture(3))).decode(), embedder, 3).collect()
    assert [r.id for r in got[:2]] == ["/p/3.ppm", "/p/noisy.ppm"] and got[0].score == 0 and got[1].score < 0.05 < got[2].score
    for bad in ("", "no base64!", base64.b64encode(b"GIF").decode()):
        with pytest.raises(ValueError):
            I.search_by_image(items, bad, embedder)


def test_prepared_images():
    flat = I.prepare(np.full((10, 400, 3), 128, np.uint8))
    assert flat.shape == (224, 224, 3) and flat.min() == flat.max() == 128
    ramp = I.prepare(np.tile(np.linspace(0, 255, 448).astype(np.uint8)[None, :, None], (5, 1, 3)))
    assert (np.diff(ramp[0, :, 0].astype(int)) >= 0).all() and ramp[0, 0, 0] == 0 and ramp[0, -1, 0] == 255
    grey = I.decode_ppm(b"P5 2 1 255\n\x07\x09")
    assert grey.tolist() == [[[7, 7, 7], [9, 9, 9]]]


def test_frames_kept_row_by_row(spark):
    rng = np.random.default_rng(17)
    rows = []
    for video in range(3):
        h = int(rng.integers(-(2**63), 2**63 - 1))
        for n in range(80):
            h ^= int(sum(1 << int(b) for b in set(rng.integers(0, 63, int(rng.integers(0, 4))))))
            rows.append((video, n, h))
    df = spark.createDataFrame(rows, "video int, n int, h long")
    got = sorted((r.video, r.n) for r in M.kept_frame_rows(df, ["video"], "n", "h", 0.9).collect())
    arrays = df.groupBy("video").agg(F.sort_array(F.collect_list(F.struct("n", "h"))).alias("a")).select("video", M.kept_frames(F.transform("a", lambda x: x["h"]), F.lit(0.9)).alias("k"))
    assert got == sorted((r.video, k) for r in arrays.collect() for k in r.k) and 10 < len(got) < 240


def test_migrations_and_cleared_queues(spark):
    history = spark.createDataFrame([(2, "b", "d", "t", 5), (1, "a", "d", "t", 7)], "version long, name string, description string, applied_at string, execution_time_ms long")
    assert [r.version for r in files.migration_history(history)] == [1, 2] and files.migration_history(None) == []
    assert files.needs_migration(history, 3) and not files.needs_migration(history, 2) and files.needs_migration(None, 1)
    jobs = spark.createDataFrame([job(1, "pending"), job(2, "completed")], JOB)
    assert J.clear_all(jobs).count() == 0 and J.clear_all(jobs).columns == jobs.columns


def test_a_blank_query_is_an_error(spark):
    none = spark.createDataFrame([], "id string")
    with pytest.raises(ValueError):
        S.search(none, none, "  \n", None)


def test_a_ticking_queue_drains_though_nothing_comes(spark, tmp_path):
    state = Snapshots(spark, str(tmp_path / "jobs"))
    state.publish(spark.createDataFrame([], JOB))
    spark.createDataFrame([job(i, "pending", ago=50 - i) for i in range(10)], JOB).coalesce(1).write.parquet(str(tmp_path / "new"))
    new = queue.ticking(spark.readStream.schema(JOB).parquet(str(tmp_path / "new")))
    handler = lambda mine: mine.select("job_no", F.when((F.col("job_no") == 3) & (F.col("retry_count") == 0), "failed").otherwise("completed").alias("status"), F.lit("busy").alias("message"))
    began = time.time()
    clock = lambda: F.lit(dt.datetime(2024, 1, 30, 12) + dt.timedelta(seconds=20 * (time.time() - began))).cast("timestamp_ntz")  # noqa: E731  a fast one
    q = queue.work(new, state, handler, str(tmp_path / "cp"), clock, batch=4, processingTime="1 seconds")
    while time.time() < began + 150 and state.read().where("status = 'completed'").count() < 10:
        time.sleep(1)
    q.stop()
    assert {r.job_no: r.retry_count for r in state.read().where("status = 'completed'").collect()} == {i: int(i == 3) for i in range(10)}
