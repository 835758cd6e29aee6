import datetime as dt

import pytest
from pyspark.sql import functions as F

from lumenweave.operators import jobs as J
from lumenweave.operators import library as L
from lumenweave.operators import search as S
from lumenweave.operators import tables as U
from lumenweave.operators import volumes as V
from lumenweave.operators import watch as W
from lumenweave.sources import files
from lumenweave.streaming import watch as stream

NOW = dt.datetime(2024, 1, 30, 12)


def AS_OF():
    return F.lit(NOW).cast("timestamp_ntz")


JOB = "job_no long, job_type string, target_path string, status string, current_file string, retry_count int, max_retries int, created_at timestamp_ntz, started_at timestamp_ntz, completed_at timestamp_ntz, updated_at timestamp_ntz, next_retry_at timestamp_ntz, errors array<string>"


def job(n, status, **more):
    ago = NOW - dt.timedelta(seconds=more.pop("ago", 0))
    row = {"job_no": n, "job_type": "file", "target_path": f"/p/{n}", "status": status, "current_file": None, "retry_count": 0, "max_retries": 3, "created_at": ago, "started_at": None, "completed_at": None, "updated_at": ago, "next_retry_at": None, "errors": None}
    return tuple((row | more).values())


def test_health_of_eight_jobs(spark):
    rows = [job(1, "pending"), job(2, "running"), job(3, "completed", completed_at=NOW), job(4, "failed", completed_at=NOW), job(5, "cancelled"), job(6, "pending", next_retry_at=NOW + dt.timedelta(minutes=5)), job(7, "running", ago=7200), job(8, "pending", current_file="worker_1", ago=7200)]
    h = J.health_label(J.queue_health(spark.createDataFrame(rows, JOB), AS_OF(), 600)).first()
    assert (h.total, h.pending, h.running, h.completed, h.failed, h.cancelled, h.retry_scheduled, h.stale_running, h.orphaned_pending_claims) == (8, 3, 2, 1, 1, 1, 1, 1, 1)
    assert h.completed_last_hour == 1 and h.failed_last_hour == 1 and h.oldest_pending_age_s == 7200 and h.health == "Degraded"
    none = J.health_label(J.queue_health(spark.createDataFrame([], JOB), AS_OF(), 600)).first()
    assert none.total == 0 and none.health == "Healthy"


def test_claims_take_the_oldest_and_never_twice(spark):
    jobs = spark.createDataFrame([job(i, "pending", ago=100 - i) for i in range(10)], JOB)
    once = J.claim(jobs, 1, 3, AS_OF())
    assert sorted(r.job_no for r in once.where("status = 'running'").collect()) == [0, 1, 2]
    twice = J.claim(once, 2, 3, AS_OF())
    by = {r.job_no: r.current_file for r in twice.where("status = 'running'").collect()}
    assert by == {0: "worker_1", 1: "worker_1", 2: "worker_1", 3: "worker_2", 4: "worker_2", 5: "worker_2"}


def test_recovery_retry_and_retention(spark):
    jobs = spark.createDataFrame([job(1, "running", ago=10), job(2, "pending", current_file="worker_2", ago=10), job(3, "failed", retry_count=1), job(4, "failed", retry_count=3, errors=["a"]), job(5, "completed", ago=8 * 86400), job(6, "running", updated_at=None)], JOB)
    got = {r.job_no: r for r in J.recover_orphans(jobs, AS_OF(), 0).collect()}
    assert [got[i].status for i in (1, 2, 6)] == ["pending"] * 3 and got[2].current_file is None
    got = {r.job_no: r for r in J.schedule_retry(jobs, F.col("status") == "failed", F.lit("x"), AS_OF()).collect()}
    assert got[3].status == "pending" and got[3].next_retry_at == NOW + dt.timedelta(seconds=120) and got[3].errors == ["x"]
    assert got[4].status == "failed" and got[4].errors[0] == "a" and got[4].errors[1].endswith("x") and got[4].retry_count == 3
    assert 5 not in {r.job_no for r in J.retain(jobs, AS_OF(), 7).collect()}


def test_jobs_are_unique_by_type_and_path(spark):
    jobs = spark.createDataFrame([job(1, "pending", target_path="/a")], JOB)
    wanted = spark.createDataFrame([("file", "/a"), ("transcription", "/a"), ("file", "/b"), ("file", "/b")], "job_type string, target_path string")
    assert sorted(tuple(r) for r in J.create_jobs(jobs, wanted).collect()) == [("file", "/b"), ("transcription", "/a")]


def test_progress_keeps_what_is_null(spark):
    jobs = spark.createDataFrame([job(1, "running", errors=["old"], current_file="f")], JOB)
    u = spark.createDataFrame([(1, "completed", None, None)], "job_no long, status string, current_file string, errors array<string>")
    r = J.apply_progress(jobs, u, AS_OF()).first()
    assert (r.status, r.errors, r.current_file, r.completed_at) == ("completed", ["old"], "f", NOW)


def merged(texts, images, limit):
    """The loop that interleave stands for; lists are (path, score) by score, one row a path."""
    if not texts or not images:
        return [p for p, _ in (texts or images)[:limit]]
    si = min(len(images), max(10, limit // 3))
    t, i = iter(texts[: min(len(texts), limit - si)]), iter(images[:si])
    out: list = []

    def take(it):
        for p, _ in it:
            if p not in out:
                out.append(p)
                return True
        return False

    while len(out) < limit:
        some = False
        for _ in range(2):
            if not take(t):
                break
            some = True
            if len(out) >= limit:
                break
        if len(out) < limit and take(i):
            some = True
        if not some:
            break
    return out


@pytest.mark.parametrize("n_text,n_image,limit", [(0, 5, 120), (5, 0, 120), (7, 3, 120), (3, 30, 30), (100, 100, 120), (2, 50, 20)])
def test_interleave_is_the_merge_loop(spark, n_text, n_image, limit):
    t, i = [(f"/t{k}", k / 100) for k in range(n_text)], [(f"/i{k}", k / 50) for k in range(n_image)]
    make = lambda rows: spark.createDataFrame([(p, p, s) for p, s in rows], "id string, file_path string, score double")
    got = [r.file_path for r in S.interleave(make(t), make(i), limit).orderBy("rank").collect()]
    assert got == merged(t, i, limit)


def test_threshold_bounds_are_kept(spark):
    rows = spark.createDataFrame([("a", 0.5), ("b", 0.72), ("c", 0.73), ("d", 0.82)], "id string, score double")
    assert [r.id for r in S.relevance_threshold(rows, "text").orderBy("id").collect()] == ["a", "b"]
    assert S.relevance_threshold(rows.limit(0), "text").count() == 0


def test_longest_mount_wins(spark):
    v = spark.createDataFrame([("1", "/V/A"), ("2", "/V/AB"), ("3", "/V/A/x/")], "uuid string, mount_path string")
    f = spark.createDataFrame([("/V/AB/f",), ("/V/A/f",), ("/V/A/x/f",), ("/W/f",)], "file_path string")
    assert {r.file_path: r.volume_uuid for r in V.on_volume(f, v).collect()} == {"/V/AB/f": "2", "/V/A/f": "1", "/V/A/x/f": "3", "/W/f": None}


def test_status_overwrites_with_nulls_and_known_volumes_are_refused(spark):
    v = spark.createDataFrame([("1", "a", "/V/A", "connected")], "uuid string, name string, mount_path string, status string")
    u = spark.createDataFrame([("1", "disconnected", "/V/A")], "uuid string, status string, mount_path string")
    assert V.set_status(v, u).first().mount_path is None
    mounts = spark.createDataFrame([], "drive_uuid string, mount_path string, mounted_at timestamp, unmounted_at timestamp")
    with pytest.raises(ValueError):
        V.add_volume(v, mounts, "1", "a", "/V/A", F.current_timestamp())
    more, m = V.add_volume(v, mounts, "2", "b", "/V/B", F.current_timestamp())
    assert more.count() == 2 and m.count() == 1


def test_latest_of_equal_times_is_the_first_listing(spark):
    a = spark.createDataFrame([("x", "/p", 5)], "id string, file_path string, updated_s long")
    b = spark.createDataFrame([("y", "/p", 5), ("z", "/q", 1)], "id string, file_path string, updated_s long")
    assert sorted(r.id for r in L.latest_per_path(a, b).collect()) == ["x", "z"]


def test_snapshots_show_what_was_published(spark, tmp_path):
    s = U.Snapshots(spark, str(tmp_path / "t"))
    assert s.read() is None
    s.publish(spark.range(3))
    s.publish(s.read().where("id > 0"))
    assert sorted(r.id for r in s.read().collect()) == [1, 2]


def test_unknown_conditions_keep_rows(spark):
    rows = spark.createDataFrame([("/p", None), ("/p", '{"source_type":"transcript_chunk"}'), (None, None)], "file_path string, metadata string")
    assert U.delete_transcript_chunks(rows, "/p").count() == 2


def test_stream_of_listings_equals_the_batch(spark, tmp_path):
    rows = [(f"f{i % 2}", f"/p{i}", f"{i}:1") for i in range(20)]
    schema = "folder_id string, file_path string, content_sig string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "in"))
    state, seen = U.Snapshots(spark, str(tmp_path / "state")), []
    q = stream.watch(stream.read_listings(spark, str(tmp_path / "in"), 1), state, str(tmp_path / "cp"), lambda df, _: seen.extend(r.file_path for r in df.collect()))
    q.awaitTermination(180)
    assert sorted(seen) == sorted(r[1] for r in rows)
    assert state.read().count() == 20
    again = spark.createDataFrame([("f0", "/p0", "0:2"), ("f1", "/p1", "1:1")], schema)
    assert [r.file_path for r in W.changed(again, state.read()).collect()] == ["/p0"]


def test_files(spark, tmp_path):
    for name, data in {"a.txt": b"hello \xff world", "b.jpg": b"\xff\xd8x\xff\xd9", ".hidden.txt": b"x", "blank.txt": b" \n", "node_modules/c.txt": b"x", "sub/d.md": b"# d", "e.exe": b"x"}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(data)
    found = {r.file_name: r.size for r in files.crawl(spark, str(tmp_path)).collect()}
    assert found == {"a.txt": 13, "b.jpg": 5, "blank.txt": 2, "d.md": 3}
    texts = files.read_texts(spark, str(tmp_path / "*.txt")).collect()
    assert [r.text for r in texts] == ["hello � world"]
    shown = files.list_directory(spark, str(tmp_path)).collect()
    assert [r.is_dir for r in shown] == sorted((r.is_dir for r in shown), reverse=True)


def test_previews_logs_frames_and_probes(spark, tmp_path):
    p = spark.createDataFrame([("aé" * 10,), ("ab",)], "t string").select(files.preview(F.col("t"), 5).alias("p")).collect()
    assert [(r.p.content, r.p.truncated) for r in p] == [("aéa", True), ("ab", False)]
    (tmp_path / "l.log").write_text('{"timestamp":"t","level":"WARN","message":"m"}\n[t2] [ERROR] boom [x] y\nplain\n')
    assert [(r.level, r.message) for r in files.log_tail(spark, str(tmp_path / "l.log"), 2).collect()] == [("ERROR", "boom [x] y"), ("INFO", "plain")]
    frames = spark.createDataFrame([("v", bytearray(b"zz\xff\xd8a\xff\xd9\xff\xd8b\xff\xd9\xff\xd8c"))], "id string, content binary")
    assert [(r.frame_number, bytes(r.frame)) for r in files.split_frames(frames).collect()] == [(0, b"\xff\xd8a\xff\xd9"), (1, b"\xff\xd8b\xff\xd9")]
    probe = spark.createDataFrame([('{"streams":[{"codec_type":"video","codec_name":"h264","width":640,"height":480}],"format":{"duration":"2.5"}}',), ("{}",), (None,)], "probe_json string")
    assert [(r.width, r.height, r.duration, r.codec) for r in files.probe(probe).collect()] == [(640, 480, 2.5, "h264"), (0, 0, 0.0, "unknown"), (0, 0, 0.0, "unknown")]
    (tmp_path / "t.csv").write_text('a,b\n"x ""q""","1\n2"\n')
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "t.csv")).collect()] == [('x "q"', "1\n2")]


def test_stream_extras(spark, tmp_path):
    rows = [(i % 5, dt.datetime(2024, 1, 1, 0, i), "view", 1.0) for i in range(10)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double").write.parquet(str(tmp_path / "e"))
    source = spark.readStream.schema("event_id long, ts timestamp_ntz, event_type string, value double").parquet(str(tmp_path / "e"))
    q = stream.event_counts(source).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.n for r in spark.table("counts").orderBy("start").collect()] == [5, 5]


def test_batches_releases_and_folders(spark):
    jobs = spark.createDataFrame([job(1, "running", current_file="worker_1"), job(2, "running", current_file="worker_2")], JOB)
    assert [r.job_no for r in J.release(jobs, 1, AS_OF()).where("status = 'pending'").collect()] == [1]
    errors = spark.createDataFrame([("/p/2", "disk full")], "path string, message string")
    done = J.attribute_errors(jobs, errors)
    assert {r.job_no: (r.status, r.category) for r in done.collect()} == {1: ("completed", None), 2: ("failed", "temporary")}
    assert tuple(J.tally(done).first()) == (1, 1, 2)
    folders = spark.createDataFrame([("f1", "/a", True), ("f2", "/b", True)], "folder_id string, path string, enabled boolean")
    new = spark.createDataFrame([("x", "/a", False), ("f3", "/c", None)], "folder_id string, path string, enabled boolean")
    assert sorted(tuple(r) for r in W.upsert_folder(folders, new).collect()) == [("f1", "/a", False), ("f2", "/b", True), ("f3", "/c", None)]


def test_large_groups_are_not_gathered(spark):
    from lumenweave.plans import registry
    from tests.conftest import SMALL

    plan = lambda name: registry.queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan("transcript_chunks")
    assert "Window" not in plan("excess_videos")
    assert "__salt" in plan("topn_per_status")
