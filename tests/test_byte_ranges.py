"""Ranges of bytes beside whole files, wherever they are cut."""

import random

import pytest

from lumenweave.sources import byte_ranges as B
from lumenweave.sources import files


@pytest.mark.parametrize("end", [b"", b"\n", b"\r\n", b"\n\n"])
def test_the_tail_is_the_end_of_the_whole_log(spark, tmp_path, end):
    rng = random.Random(14)
    lines = [rng.choice(["", "plain é", '{"timestamp":"t","level":"WARN","message":"m%d"}' % i, f"[t{i}] [ERROR] boom {i}", "x" * rng.randint(0, 90)]) for i in range(200)]
    path = tmp_path / "a.log"
    path.write_bytes("\n".join(lines).encode() + end)
    for n in (1, 5, 60, 1000):
        want = [tuple(r) for r in files.log_tail(spark, str(path), n).collect()]
        for block in (7, 64, 100_000):
            if block == 7 and n > 5:
                continue
            assert [tuple(r) for r in B.log_tail(spark, str(path), n, block).collect()] == want


def test_only_the_last_blocks_are_read(spark, tmp_path, monkeypatch):
    path = tmp_path / "big.log"
    with path.open("wb") as f:
        f.truncate(3 << 30)  # three gigabytes of nothing, then the log
        f.seek(0, 2)
        f.write(b"\n" + b"".join(b"[t%d] [INFO] line\n" % i for i in range(100_000)))
    got = B.log_tail(spark, str(path), 3).collect()
    assert [(r.timestamp, r.message) for r in got] == [(f"t{i}", "line") for i in range(99_997, 100_000)]


def test_empty_and_one_line_logs(spark, tmp_path):
    (tmp_path / "e").write_bytes(b"")
    (tmp_path / "o").write_bytes(b"only")
    assert B.log_tail(spark, str(tmp_path / "e"), 5).count() == 0
    assert [r.message for r in B.log_tail(spark, f"file://{tmp_path}/o", 5, 2).collect()] == ["only"]


def streams(rng):
    """Bytes with frames, rubbish between them, markers in wrong places and an open frame at the end."""
    body = lambda: bytes(rng.choice([0, 1, 0xFF, 0xD8, 7]) for _ in range(rng.randint(0, 40))).replace(B.EOI, b"")
    parts = [b"zz", B.EOI]
    for _ in range(40):
        parts += [B.SOI, body(), B.EOI, rng.choice([b"", b"\xff", b"rubbish", B.EOI, b"\xd9"])]
    return b"".join(parts) + B.SOI + b"open"


def test_frames_are_the_same_however_a_file_is_cut(spark, tmp_path):
    rng = random.Random(15)
    for name in ("a.mjpeg", "b.mjpeg"):
        (tmp_path / name).write_bytes(streams(rng))
    whole = spark.read.format("binaryFile").load(str(tmp_path / "*.mjpeg")).selectExpr("substring_index(path, '/', -1) AS name", "content")
    want = sorted((r.name, r.frame_number, bytes(r.frame)) for r in files.split_frames(whole).collect())
    assert len(want) > 60
    for size in (50, 333, 1 << 20):
        got = sorted((r.path.split("/")[-1], r.frame_number, bytes(r.frame)) for r in B.read_frames(spark, str(tmp_path / "*.mjpeg"), size).collect())
        assert got == want
    for size in range(1, 60):  # every cut, without Spark
        for name in ("a.mjpeg", "b.mjpeg"):
            reader = B.FrameReader({"path": str(tmp_path / name), "range": size})
            got = [bytes(data) for part in reader.partitions() for _, _, data in reader.read(part)]
            assert got == [f for n, _, f in want if n == name]


def test_steps_do_not_part_a_marker(tmp_path, monkeypatch):
    monkeypatch.setattr(B, "STEP", 3)
    path = tmp_path / "x"
    path.write_bytes(b"ab" + B.SOI + b"1234567" + B.EOI + b"c" + B.SOI + B.EOI)
    with B.Bytes(str(path)) as f:
        assert [d for _, d in B.frames(f, 0, f.size)] == [B.SOI + b"1234567" + B.EOI, B.SOI + B.EOI]
        assert f.find(B.SOI, 0, 2) == -1 and f.find(B.SOI, 0, 3) == 2 and f.find(b"q", 0) == -1


def test_a_growing_file_is_a_stream(spark, tmp_path):
    path = tmp_path / "live.mjpeg"
    path.write_bytes(B.SOI + b"one" + B.EOI + B.SOI + b"tw")
    out, seen = str(tmp_path / "out"), []
    for more in (b"o" + B.EOI, B.SOI + b"three" + B.EOI + b"zz"):
        q = B.stream_frames(spark, str(path)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="0 seconds").start()
        q.processAllAvailable()
        q.stop()
        seen.append(sorted(bytes(r.frame)[2:-2] for r in spark.read.parquet(out).collect()))
        with path.open("ab") as f:
            f.write(more)
    assert seen == [[b"one"], [b"one", b"two"]]
