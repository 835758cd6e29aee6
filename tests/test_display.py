import pytest
from pyspark.sql import functions as F

from lumenweave.functions import classify as C
from lumenweave.operators import display as D
from lumenweave.operators import generations as G
from lumenweave.operators import jobs as J
from lumenweave.operators import volumes as V
from lumenweave.operators import watch as W
from lumenweave.operators.tables import Snapshots, check_width
from lumenweave.sources import files
from lumenweave.streaming import progress, queue
from tests.test_operators import JOB, NOW, job

AT = lambda: F.lit(NOW).cast("timestamp_ntz")


def test_rows_without_optional_columns(spark):
    rows = spark.createDataFrame([("/a/b.MP3",), ("",), (None,), ("b.jpg",), ("/x/%zz.md",), ("/x/%C3.md",), ("/x/%C3%A9+1.mov",), ("/only",)], "file_path string")
    got = [(r.shown_path, r.shown_name, r.shown_type, r.shown_parent) for r in D.display_rows(rows).collect()]
    assert got == [
        ("/a/b.MP3", "b.MP3", "audio", "/a"), ("b.jpg", "b.jpg", "image", None), ("/x/%zz.md", "%zz.md", "document", "/x"), ("/x/%C3.md", "%C3.md", "document", "/x"),
        ("/x/é+1.mov", "é+1.mov", "video", "/x"), ("/only", "only", "document", None),
    ]


def test_marks_in_metadata(spark):
    rows = spark.createDataFrame([
        (1, "/a/b.mp4", "not json", None), (2, "/a/b.jpg", '{"isReferenceImage":true}', None), (3, "/a/b.jpg", '{"isReferenceImage":false}', None),
        (4, "/a/b.txt", '{"source_type":"TEXT_CHUNK","snippet":"s"}', None), (5, "/a/b.mp4", '{"source_type":"transcript_chunk","time_start_seconds":3,"time_start_formatted":"00:03"}', None),
        (6, "/a/b.mp4", '{"source_type":"video_frame","timestamp_formatted":"00:09"}', "reference_image"), (7, "/a/b.mp4", '{"source_type":"video_frame","timestamp_formatted":"00:09","source_path":"/f/o.mp4"}', None), (8, "/a/b.mp4", '{"source_type":"video_frame","timestamp_formatted":"00:11","source_path":"/f/o.mp4"}', None),
    ], "n long, file_path string, metadata string, type string")
    shown = D.display_rows(rows)
    got = {r.n: (r.shown_name, r.shown_type, r.shown_source, r.shown_at, r.shown_clock, r.shown_snippet) for r in shown.collect()}
    assert got == {
        1: ("b.mp4", "video", None, None, None, None), 3: ("b.jpg", "image", None, None, None, None), 4: ("b.txt", "document", "text_chunk", None, None, "s"), 5: ("b.mp4", "video", "transcript_chunk", 3.0, "00:03", None),
        7: ("b.mp4 @ 00:09", "image", "video_frame", None, "00:09", None), 8: ("b.mp4 @ 00:11", "image", "video_frame", None, "00:11", None),
    }
    videos = {r.n: (r.shown_name, r.shown_type, r.shown_parent) for r in D.one_per_video(shown, "n").collect()}
    assert videos[7] == ("b.mp4", "video", "/f") and 8 not in videos and len(videos) == 5


def test_listing_orders(spark):
    rows = spark.createDataFrame([(1, "b", "x", 2, None), (2, "A", "y", None, "2024"), (3, "a", "y", 2, "2023")], "id long, shown_name string, shown_type string, size long, modified string")
    order = lambda *a: [r.id for r in D.sort_listing(rows, *a).collect()]
    assert order("name") == [2, 3, 1] and order("name", False) == [1, 3, 2] and order("size") == [2, 1, 3] and order("modified", False) == [2, 3, 1] and order("type", False) == [2, 3, 1] and order("other") == [1, 2, 3]
    assert [r.id for r in D.newest(rows, "modified", "id").collect()] == [2, 3, 1]


def test_usage_left(spark):
    limits = spark.createDataFrame([("a", "60s"), ("b", "5"), ("c", "10"), ("d", "7")], "k string, most string")
    uses = spark.createDataFrame([("a", "10s"), ("a", " 20"), ("b", "9 seconds"), ("d", "none")], "k string, duration string")
    assert {r.k: (r.used_seconds, r.left_seconds) for r in D.usage_left(uses, limits, "k").collect()} == {"a": (30, 30), "b": (9, -4), "c": (0, 10), "d": (None, None)}


def test_generations(spark):
    none = spark.createDataFrame([], "id string, user_prompt string, json_prompt string, source string, generated_file_path string, created_at timestamp_ntz, updated_at timestamp_ntz")
    made = G.create(none, spark.createDataFrame([("g1", "p", "{}", "s"), ("g2", "q", None, "s")], "id string, user_prompt string, json_prompt string, source string"), AT())
    put = G.set_file_path(made, spark.createDataFrame([("g2", "/o.png")], "id string, generated_file_path string"), AT())
    assert {r.id: r.generated_file_path for r in put.collect()} == {"g1": None, "g2": "/o.png"}
    assert [r.id for r in G.delete(put, spark.createDataFrame([("g1",)], "id string")).collect()] == ["g2"]
    with pytest.raises(ValueError, match="g9"):
        G.delete(put, spark.createDataFrame([("g9",)], "id string"))
    with pytest.raises(ValueError, match="g9"):
        G.set_file_path(put, spark.createDataFrame([("g9", "x")], "id string, generated_file_path string"), AT())


def test_volume_and_folder_settings(spark):
    volumes = spark.createDataFrame([("u1", "n", "l", None), ("u2", "m", "k", None)], "uuid string, custom_name string, physical_location string, last_seen timestamp_ntz")
    got = {r.uuid: (r.custom_name, r.physical_location, r.last_seen) for r in V.set_metadata(volumes, spark.createDataFrame([("u1", "new", None)], "uuid string, custom_name string, physical_location string"), AT()).collect()}
    assert got == {"u1": ("new", None, NOW), "u2": ("m", "k", None)}
    folders = spark.createDataFrame([("w1", True, "watching", None, None), ("w2", True, "watching", None, None)], "folder_id string, enabled boolean, status string, updated_at timestamp_ntz, last_scan_at timestamp_ntz")
    assert {r.folder_id: (r.enabled, r.status) for r in W.set_enabled(folders, "w1", False, AT()).collect()} == {"w1": (False, "paused"), "w2": (True, "watching")}
    assert {r.folder_id: r.last_scan_at for r in W.set_scan(folders, "w2", AT(), F.lit("idle")).collect()} == {"w1": None, "w2": NOW}
    state = spark.createDataFrame([("w1", "a"), ("w2", "b")], "folder_id string, file_path string")
    left = [[r.folder_id for r in t.collect()] for t in W.remove_folder(folders, state, "w1")]
    assert left == [["w2"], ["w2"]]
    due = spark.range(1).select(W.is_due(F.lit(None).cast("timestamp_ntz"), AT()).alias("a"), W.is_due(AT(), AT()).alias("b"), W.is_due(AT() - F.expr("INTERVAL 5 SECONDS"), AT()).alias("c")).first()
    assert tuple(due) == (True, False, True)


def test_jobs_by_hand(spark):
    jobs = spark.createDataFrame([job(1, "running", current_file="worker_1"), job(2, "failed"), job(3, "completed"), job(4, "pending")], JOB)
    assert sorted(r.job_no for r in J.clear_active(jobs).collect()) == [2, 3]
    again = {r.job_no: (r.status, r.retry_count) for r in J.manual_retry(jobs, [2], AT()).collect()}
    assert again[2] == ("pending", 0) and again[3][0] == "completed"


def test_cleared_table_and_widths(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path / "t"))
    assert table.clear() is None
    table.publish(spark.createDataFrame([(1, [0.0, 1.0])], "id long, embedding array<double>"))
    assert check_width(table.read(), 2).count() == 1
    with pytest.raises(Exception, match="2 wide, not 3"):
        check_width(table.read(), 3).collect()
    table.clear()
    assert table.read().count() == 0 and table.read().columns == ["id", "embedding"]


def test_versions_and_open_errors(spark):
    history = spark.createDataFrame([(1,), (3,)], "version long")
    assert files.migration_version(history).first().version == 3 and files.migration_version(history.limit(0)).first().version == 0
    kinds = spark.createDataFrame([("io",), ("decoding",), ("odd",), (None,)], "k string")
    assert [r[0] for r in kinds.select(C.categorize_open_error(F.col("k"))).collect()] == ["IO_ERROR", "CORRUPTED_FILE", "UNKNOWN_ERROR", "UNKNOWN_ERROR"]


def test_events(spark, tmp_path):
    tries = []

    def flaky(event, payload):
        tries.append(event)
        if len(tries) < 3:
            raise OSError("no receiver")

    assert progress.emit(flaky, "e", {}, wait=0) and len(tries) == 3
    assert not progress.emit(lambda e, p: 1 / 0, "e", {}, wait=0)
    row = progress.created_event(spark.range(300).withColumnRenamed("id", "job_no"), 50).first()
    assert (row.total_jobs, row.total_jobs_created_so_far, row.sample_job_ids) == (300, 350, list(range(100)))
    none = progress.created_event(spark.range(0).withColumnRenamed("id", "job_no"), 50).first()
    assert (none.total_jobs, none.total_jobs_created_so_far, none.sample_job_ids) == (0, 50, [])


def test_a_paused_queue_takes_jobs_in_and_works_on_none(spark, tmp_path):
    state = Snapshots(spark, str(tmp_path / "jobs"))
    state.publish(spark.createDataFrame([job(0, "pending", ago=90), job(1, "running", ago=5, current_file="worker_1")], JOB))
    spark.createDataFrame([job(2, "pending", ago=50)], JOB).coalesce(1).write.parquet(str(tmp_path / "new"))
    new = spark.readStream.schema(JOB).parquet(str(tmp_path / "new"))
    queue.work(new, state, lambda mine: 1 / 0, str(tmp_path / "cp"), AT, paused=lambda: True).awaitTermination(240)
    assert {r.job_no: r.status for r in state.read().collect()} == {0: "pending", 1: "pending", 2: "pending"}
