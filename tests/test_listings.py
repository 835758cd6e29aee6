from pyspark.sql import functions as F

from lumenweave.functions.text import token_chunks, windows
from lumenweave.operators.library import index_stats
from lumenweave.operators.search import search_status, search_with_fallback
from lumenweave.operators.tables import transcript_rollup
from lumenweave.sources import files


def made(tmp_path):
    for name in ("a.txt", "b/c.txt", "b/d/e.txt", ".git/x.txt", "b/.hidden.txt", "b/Thumbs.db"):
        where = tmp_path / name
        where.parent.mkdir(parents=True, exist_ok=True)
        where.write_text("text of " + name)
    return str(tmp_path)


def test_recursive_listing(spark, tmp_path):
    root = made(tmp_path)
    got = [tuple(r) for r in files.list_recursive(spark, root).collect()]
    assert got == [("b", f"{root}/b", True, 2), ("d", f"{root}/b/d", True, 1), ("a.txt", f"{root}/a.txt", False, None), ("c.txt", f"{root}/b/c.txt", False, None), ("e.txt", f"{root}/b/d/e.txt", False, None)]


def test_metadata_and_capped_crawl(spark, tmp_path):
    root = made(tmp_path)
    row = files.file_metadata(spark, f"{root}/a.txt").first()
    assert row.modified_at.startswith("20") and (row.name, row.path, row.size) == ("a.txt", f"{root}/a.txt", len("text of a.txt"))
    assert [r.file_name for r in files.crawl(spark, root, cap=2).collect()] == ["a.txt", "c.txt"]


def test_fallback_chain(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0], 1), ("b", [0.0, 1.0], 2), ("c", None, 3)], "id string, embedding array<double>, created_s long")
    near = search_with_fallback(rows, [1.0, 0.1], 2).collect()
    assert [(r.id, r.tier) for r in near] == [("a", 0), ("b", 0)]
    zero = rows.withColumn("embedding", F.transform("embedding", lambda _: F.lit(0.0)))
    assert [(r.id, r.score, r.tier) for r in search_with_fallback(zero, [1.0, 0.1], 5).collect()] == [("a", 1.0, 1), ("b", 1.0, 1)]
    none = rows.withColumn("embedding", F.lit(None).cast("array<double>"))
    assert [(r.id, r.score, r.tier) for r in search_with_fallback(none, [1.0, 0.1], 2).collect()] == [("c", 0.5, 2), ("b", 0.5, 2)]
    assert search_with_fallback(rows.limit(0), [1.0, 0.1], 2).count() == 0


def test_status_without_an_embedder(spark):
    items = spark.createDataFrame([("a.jpg", None)], "file_path string, source_type string")
    chunks = spark.createDataFrame([("b.txt", 0, "x"), ("b.txt", 1, "y")], "file_path string, chunk_index long, chunk_text string")
    r = search_status(items, chunks).first()
    assert (r.model_loaded, r.indexed_count, r.chunks, r.status) == (False, 2, 2, "not_ready")


def test_rollup_keeps_the_first_confidence(spark):
    rows = spark.createDataFrame([(1, 1, "b ", 2.0, 0.5), (1, 0, "a", 1.0, 0.9), (2, 0, "c", 1.0, None)], "conv_id long, seg_no int, text string, end_s double, confidence double")
    got = {r.conv_id: (r.transcription_text, r.confidence_score) for r in transcript_rollup(rows, ["conv_id"]).collect()}
    assert got == {1: ("a b", 0.9), 2: ("c", None)}


def test_chunks_of_any_text(spark):
    odd = [None, "", " \n ", "one", "  é two three ", " ".join(f"w{i}" for i in range(11))]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(odd)], "chunk_index int, text string, __x string").withColumnRenamed("chunk_index", "n")
    got = [(r.n, r.chunk_index, r.chunk_text, r.char_start, r.char_end, r.token_estimate) for r in token_chunks(rows, window=5, overlap=2).orderBy("n", "chunk_index").collect()]
    assert got[:2] == [(3, 0, "one", 0, 3, 1), (4, 0, "é two three", 2, 17, 3)]
    assert [g[2] for g in got[2:]] == ["w0 w1 w2 w3 w4", "w3 w4 w5 w6 w7", "w6 w7 w8 w9 w10"]
    long = "é " * 300_000
    parts = windows(long)
    assert len(parts) == 441 and parts[-1]["char_end"] == 3 * 300_000 - 1 and parts[1]["char_start"] == 3 * 680


def test_counts_of_an_index_gather_no_batch_of_chunks(spark):
    docs = spark.createDataFrame([("a", "x " * 900), ("b", " "), ("c", None)], "file_path string, text string")
    items = spark.createDataFrame([("f", "video_frame"), ("g", None)], "file_path string, source_type string")
    stats = index_stats(items, token_chunks(docs))
    assert "ArrowEvalPython" not in stats._jdf.queryExecution().optimizedPlan().toString()
    assert tuple(stats.drop("text_mb").first()) == (2, 1, 1, 2)


def test_chunks_are_counted_without_being_made(spark):
    from pyspark.sql import functions as F

    from lumenweave.functions.text import chunk_count, windows

    texts = [None, "", " \t　 ", "a", " b c\x1cd ", *(" ".join(["wé"] * n) for n in (799, 800, 801, 1480, 1481, 2161))]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = [r.n for r in docs.select("i", chunk_count(F.col("text")).alias("n")).orderBy("i").collect()]
    assert got == [len(windows(t or "")) for t in texts]
