"""Listings as a stream beside the batch difference and a plain loop."""

import random

from pyspark.sql import functions as F

from lumenweave.operators import watch as W
from lumenweave.streaming import folder_state as S


def scans(rng, folders, n):
    """Listings of n scans of each folder: dicts of path to signature; files come, change, go and come again."""
    now = {f: {} for f in folders}
    out = []
    for _ in range(n):
        for f in folders:
            paths = now[f]
            for p in list(paths):
                if rng.random() < 0.2:
                    del paths[p]
                elif rng.random() < 0.2:
                    paths[p] += "x"
            for _ in range(rng.randint(0, 8)):
                paths.setdefault(f"/{f}/{rng.randint(0, 40)}", "s" if rng.random() < 0.9 else None)
            for p in [p for p, s in paths.items() if s is None]:
                paths[p] = "null"
        out.append({f: dict(now[f]) for f in folders})
    return out


def plain(listings):
    state, out = {}, []
    for no, scan in enumerate(listings):
        for f, files in scan.items():
            old = state.get(f, {})
            out += [(f, p, s, old.get(p), "changed" if p in old else "new", no) for p, s in files.items() if old.get(p) != s]
            out += [(f, p, None, s, "removed", no) for p, s in old.items() if p not in files]
            state[f] = files
    return state, out


def run(spark, batches, tmp_path, buckets=4):
    """Each batch is a file, read in its order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, S.LISTING).coalesce(1).write.parquet(str(tmp_path / f"stage/{i}"))
        target = tmp_path / "in"
        target.mkdir(exist_ok=True)
        part = next((tmp_path / f"stage/{i}").glob("part-*"))
        part.rename(target / f"{i:04d}.parquet")
        stream = spark.readStream.schema(S.LISTING).option("maxFilesPerTrigger", 1).parquet(str(target))
        S.watch(stream, str(tmp_path / "events"), str(tmp_path / "cp"), buckets).awaitTermination(120)
    return spark.read.parquet(str(tmp_path / "events"))


def test_events_of_scans_equal_a_plain_loop(spark, tmp_path):
    listings = scans(random.Random(8), ["a", "b"], 4)
    state, want = plain(listings)
    batches = []
    for no, scan in enumerate(listings):
        rows = [(f, no, p, s) for f, files in scan.items() for p, s in files.items()]
        half = len(rows) // 2
        batches += [rows[:half] or [("a", no, None, None)][:0], rows[half:] + [(f, no, None, None) for f in scan]]  # a scan in two batches
    found = run(spark, [b for b in batches if b], tmp_path)
    key = lambda r: tuple(str(c) for c in r)
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(want, key=key)
    assert sorted(tuple(r) for r in S.stored(found).collect()) == sorted((f, p, s) for f, files in state.items() for p, s in files.items())


def test_events_equal_the_batch_difference(spark, tmp_path):
    rng = random.Random(9)
    old = {f"/p/{i}": f"{i}:1" for i in range(60) if rng.random() < 0.8}
    new = {f"/p/{i}": f"{i}:{rng.randint(1, 2)}" for i in range(60) if rng.random() < 0.8}
    frame = lambda files: spark.createDataFrame([("wf", p, s, None) for p, s in files.items()], "folder_id string, file_path string, content_sig string, last_index_job_id string")
    batches = []
    for no, files in enumerate((old, new)):
        listing = S.as_listing(frame(files), no, F.col("folder_id"), F.col("file_path"), F.col("content_sig"))
        batches.append([tuple(r) for r in listing.collect()])
    found = run(spark, batches, tmp_path).where("scan_no = 1")
    want = W.diff(frame(new), frame(old)).where("state <> 'unchanged'")
    assert {(r.file_path, r.state) for r in found.collect()} == {(r.file_path, r.state) for r in want.collect()}


def test_empty_folders_late_rows_and_volumes(spark, tmp_path):
    folders = spark.createDataFrame([("volumes",)], "folder_id string")
    none = spark.createDataFrame([], "u string, m string")
    empty = [tuple(r) for r in S.as_listing(none, 2, F.lit("volumes"), F.col("u"), F.col("m"), folders).collect()]
    assert empty == [("volumes", 2, None, None)]
    batches = [
        [("volumes", 0, "u1", "/V/A"), ("volumes", 0, "u2", "/V/B"), ("volumes", 0, None, None)],
        [("volumes", 1, "u1", "/V/C"), ("volumes", 1, "u2", "/V/B"), ("volumes", 1, None, None), ("other", 7, "u1", "/V/A"), ("other", 7, None, None)],
        empty,
        [("volumes", 1, "u9", "/V/Z"), ("volumes", 1, None, None)],  # late
        [("volumes", 3, "u2", "/V/B"), ("volumes", 3, None, None)],
    ]
    found = S.volume_events(run(spark, batches, tmp_path).where("folder_id = 'volumes'"))
    got = sorted((r.scan_no, r.event, r.uuid, r.mount_path, r.old_mount_path) for r in found.collect())
    assert got == [(0, "connected", "u1", "/V/A", None), (0, "connected", "u2", "/V/B", None), (1, "moved", "u1", "/V/C", "/V/A"), (2, "disconnected", "u1", None, "/V/C"), (2, "disconnected", "u2", None, "/V/B"), (3, "connected", "u2", "/V/B", None)]
