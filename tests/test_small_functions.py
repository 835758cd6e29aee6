"""Functions that no query reaches, each beside plain values."""

import base64
import datetime as dt

import pytest
from pyspark.sql import functions as F

from lumenweave.functions import media as M
from lumenweave.functions import text as T
from lumenweave.operators import jobs as J
from lumenweave.sources import files
from lumenweave.streaming.progress import Progress
from tests.test_operators import AS_OF, JOB, NOW, job


def test_whole_files_are_text_or_base64(spark, tmp_path):
    (tmp_path / "a.txt").write_text("grüße")
    (tmp_path / "b.png").write_bytes(b"\x89PNG\xff")
    got = {r.path.split("/")[-1]: r for r in files.read_content(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert (got["a.txt"].content, got["a.txt"].is_base64) == ("grüße", False)
    assert (base64.b64decode(got["b.png"].content), got["b.png"].is_base64) == (b"\x89PNG\xff", True)
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe")
    with pytest.raises(Exception, match="UTF"):
        files.read_content(spark.read.format("binaryFile").load(str(tmp_path / "c.txt"))).collect()


def test_documents_by_an_extractor(spark):
    def extractor(data):
        if data == b"bad":
            raise OSError("no pdf")
        return data.decode().upper()

    rows = spark.createDataFrame([("/a.pdf", bytearray(b"text")), ("/b.pdf", bytearray(b"bad"))], "path string, content binary")
    assert sorted(map(tuple, files.extract_with(rows, extractor).collect())) == [("/a.pdf", "TEXT", None), ("/b.pdf", None, "no pdf")]


def test_catalogue_and_csv(spark, tmp_path):
    spark.range(3).createOrReplaceTempView("numbers_here")
    assert [f["name"] for f in files.schema_of(spark, "numbers_here")["fields"]] == ["id"] and files.schema_of(spark, "no_such_table") is None
    (tmp_path / "w.csv").write_text(",".join(f"c{i}" for i in range(50)) + "\n" + "\n".join(",".join(["1"] * 50) for _ in range(300)) + "\n")
    shown = files.read_csv(spark, str(tmp_path / "w.csv"))
    assert len(shown.columns) == 40 and shown.count() == 200


def test_jobs_cancelled_by_key(spark):
    got = {r.job_no: r for r in J.cancel(spark.createDataFrame([job(1, "pending"), job(2, "running"), job(3, "pending")], JOB), [1, 2], AS_OF()).collect()}
    assert [got[i].status for i in (1, 2, 3)] == ["cancelled", "cancelled", "pending"] and got[1].completed_at == NOW and got[3].completed_at is None


def test_frames_ids_and_speech(spark):
    row = spark.createDataFrame([("/v/a b.mp4", 10.9, 0.5)], "p string, d double, f double")
    got = row.select(M.expected_frames(F.col("d"), F.col("f")).alias("n"), M.frame_numbers(F.col("d"), F.col("f")).alias("all"), M.path_id(F.col("p")).alias("id")).first()
    assert (got.n, got.all, got.id) == (5, [0, 1, 2, 3, 4], "_v_a_b_mp4")
    segments = [(0.9, -2.0, "hum"), (0.9, -0.5, "said"), (0.1, -2.0, "low"), (None, None, "new")]
    s = spark.createDataFrame([(segments,)], "s array<struct<no_speech_prob:double,avg_logprob:double,text:string>>")
    assert [x.text for x in s.select(M.speech_only(F.col("s")).alias("k")).first().k] == ["said", "low", "new"]
    assert [x.text for x in s.select(M.speech_only(F.col("s"), most=1).alias("k")).first().k] == ["said"]


def test_text_of_paths_and_markup(spark):
    row = spark.createDataFrame([("/a%20b%C3%A9", "<p>One  <b>two</b></p>\n three", "%zz")], "p string, m string, bad string")
    got = row.select(T.url_text(F.col("p")).alias("p"), T.strip_markup(F.col("m")).alias("m"), T.url_text(F.col("bad")).alias("bad"), T.one_line(F.col("m"), 5).alias("o")).first()
    assert (got.p, got.m, got.bad, got.o) == ("/a bé", "One two three", None, "<p>On...")
    meta = spark.range(1).select(files.metadata_json(kind=F.lit("image"), n=F.lit(2)).alias("j")).first().j
    assert meta == '{"kind":"image","n":2}'


def test_a_stream_tells_of_its_batches(spark, tmp_path):
    import time

    told = []
    listener = Progress(lambda event, payload: told.append((event, payload)))
    spark.streams.addListener(listener)
    try:
        spark.range(7).coalesce(1).write.parquet(str(tmp_path / "in"))
        q = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        end = time.time() + 30
        while time.time() < end and "ended" not in {e for e, _ in told}:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert [e for e, _ in told if e != "progress"] == ["started", "ended"] and sum(p["rows"] for e, p in told if e == "progress") == 7


def test_retries_wait_longer_each_time(spark):
    jobs = spark.createDataFrame([job(i, "running", retry_count=i) for i in range(4)], JOB)
    got = {r.job_no: r for r in J.schedule_retry(jobs, F.lit(True), F.lit("x"), AS_OF()).collect()}
    assert [got[i].next_retry_at and got[i].next_retry_at - NOW for i in range(4)] == [dt.timedelta(seconds=30), dt.timedelta(seconds=120), dt.timedelta(seconds=480), None]
