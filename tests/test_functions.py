import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenweave.functions import classify as C
from lumenweave.functions import media as M
from lumenweave.functions import text as T
from lumenweave.functions.embed import HashingEmbedder, embed
from lumenweave.functions.vector import knn, knn_null_safe


def one_hot(i, n=768):
    return [1.0 if k == i else 0.0 for k in range(n)]


def test_two_chunks_nearest_first(spark):
    rows = spark.createDataFrame([("/tmp/doc-a.txt", one_hot(0)), ("/tmp/doc-b.txt", one_hot(1))], "file_path string, embedding array<float>")
    found = knn(rows, one_hot(0), 10, "file_path").collect()
    assert [r.file_path for r in found] == ["/tmp/doc-a.txt", "/tmp/doc-b.txt"] and found[0].score == 0 and found[1].score == 1


def test_odd_vectors(spark):
    rows = spark.createDataFrame([(1, None), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (4, [float("nan"), 1.0])], "id int, embedding array<float>")
    assert [(r.id, r.score) for r in knn_null_safe(rows, [1.0, 0.0], 9, "id").collect()] == [(3, 0.0), (1, 1.0), (2, 1.0), (4, 1.0)]
    with pytest.raises(ValueError):
        knn(rows, [0.0, 0.0], 3, "id")
    with pytest.raises(Exception, match="wide"):
        knn(rows, [1.0, 0.0, 0.0], 3, "id").collect()


def windows(text, window=800, overlap=120):
    """The loop that the chunker stands for."""
    spans, at = [], 0
    for w in text.split():
        a = text.index(w, at)
        at = a + len(w)
        spans.append((a, at))
    out, i = [], 0
    while spans:
        part = spans[i : i + window]
        a, b = part[0][0], part[-1][1]
        out.append((len(out), text[a:b], len(text[:a].encode()), len(text[:b].encode()), len(part)))
        if i + window >= len(spans):
            break
        i += window - overlap
    return out


@pytest.mark.parametrize("n", [0, 1, 799, 800, 801, 1480, 1481, 2200])
def test_chunks_of_so_many_tokens(spark, n):
    text = " ".join(f"token{i}" for i in range(n))
    got = [tuple(r) for r in T.token_chunks(spark.createDataFrame([(text,)], "text string")).collect()]
    assert [(k, t, a, b, m) for k, t, a, b, m in got] == windows(text)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aé中 \n\t", max_size=60), min_size=1, max_size=20))
def test_chunks_of_any_text(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, text string")
    got = sorted(tuple(r) for r in T.token_chunks(rows, window=5, overlap=2).collect())
    assert got == sorted((i, *c) for i, t in enumerate(texts) for c in windows(t, 5, 2))


def test_chunks_split_at_any_white_space(spark):
    got = T.token_chunks(spark.createDataFrame([("a b",), ("  ",), (None,)], "text string")).collect()
    assert [r.token_estimate for r in got] == [2]


def packed(segments):
    out, held, start, end = [], [], 0.0, 0.0
    for a, b, t in segments:
        t = (t or "").strip(" ")
        if not t:
            continue
        if held and (len(" ".join(held).encode()) + len(t.encode()) + 1 > 420 or len(held) >= 6):
            out.append((" ".join(held), start, end))
            held = []
        if not held:
            start = max(a, 0.0)
        held.append(t)
        end = max(b, start)
    return out + ([(" ".join(held), start, end)] if held else [])


def test_segments_are_packed_as_the_loop_does(spark):
    rng = np.random.default_rng(3)
    rows = []
    for conv in range(40):
        for k in range(int(rng.integers(0, 25))):
            text = [None, "", "  ", "é" * int(rng.integers(1, 300)), "word " * int(rng.integers(1, 120))][int(rng.integers(0, 5))]
            rows.append((conv, k, float(k) - 1, float(k) - 0.5 * (k % 5 == 0), text))
    got: dict = {}
    for r in T.transcript_chunks(spark.createDataFrame(rows, "conv int, seg_no int, start_s double, end_s double, text string"), ["conv"]).orderBy("conv", "chunk_index").collect():
        got.setdefault(r.conv, []).append((r.chunk_text, r.time_start, r.time_end))
    for conv in range(40):
        assert got.get(conv, []) == packed([(a, b, t) for c, _, a, b, t in rows if c == conv])


def test_names_and_errors(spark):
    names = {".git": True, ".DS_Store": True, "DS_Store": True, "Thumbs.db": True, "photo.jpg": False, "x.app": True, "apply": False}
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", C.is_hidden_or_system(F.col("n")).alias("h")).collect()
    assert {r.n: r.h for r in got} == names
    said = {"Connection timeout": "temporary", "FILE NOT FOUND": "permanent", "weird": "unknown", "": "unknown", "decode error: resource busy": "temporary", "unsupported format": "permanent"}
    got = spark.createDataFrame([(n,) for n in said], "n string").select("n", C.categorize_error(F.col("n")).alias("c")).collect()
    assert {r.n: r.c for r in got} == said


def test_embedder_matches_its_column(spark):
    e = HashingEmbedder(16)
    got = spark.createDataFrame([("a b a",), ("",), (None,)], "t string").select(embed(F.col("t"), e).alias("v")).collect()
    assert np.allclose(got[0].v, e.encode(["a b a"])[0]) and abs(np.linalg.norm(got[0].v) - 1) < 1e-9 and not any(got[1].v) and not any(got[2].v)


def test_frames_like_the_last_kept_are_left_out(spark):
    hashes = [0, 1, 3, (1 << 40) - 1, (1 << 40) - 2]
    got = spark.createDataFrame([(hashes,)], "h array<bigint>").select(M.kept_frames(F.col("h"), F.lit(0.95)).alias("k")).first().k
    kept, last = [], None
    for i, h in enumerate(hashes):
        if last is None or 1 - bin(last ^ h).count("1") / 64 <= 0.95:
            kept.append(i)
            last = h
    assert got == kept


def test_audio_steps(spark):
    row = spark.createDataFrame([([0.0, 1.0, 0.5, -0.5, 0.25, 0.25],)], "s array<double>")
    assert row.select(M.mono(F.col("s"), F.lit(2))).first()[0] == [0.5, 0.0, 0.25]
    assert row.select(M.normalise_peak(M.mono(F.col("s"), F.lit(2)))).first()[0] == [1.0, 0.0, 0.5]
    assert row.select(M.resample(F.col("s"), F.lit(32000.0))).first()[0] == [0.0, 0.5, 0.25]


def test_timestamp_tokens(spark):
    tokens = [50364, 11, 12, 50414, 50414, 13, 50464, 14]
    got = spark.createDataFrame([(tokens,)], "t array<int>").select(M.timestamp_tokens(F.col("t")).alias("s")).first().s
    assert [(round(s.start_s, 2), round(s.end_s, 2), s.tokens) for s in got] == [(0.0, 1.0, [11, 12]), (1.0, 2.0, [13]), (2.0, 3.0, [14])]


def test_texts_of_numbers(spark):
    got = spark.createDataFrame([(0, -1.0), (59, 512.0), (3661, 1536.0), (60, 1048576.0)], "s int, b double").select(T.clock(F.col("s")), T.bytes_text(F.col("b"))).collect()
    assert [tuple(r) for r in got] == [("00:00", "0 B"), ("00:59", "512 B"), ("01:01:01", "1.5 KB"), ("01:00", "1.0 MB")]


def test_knn_batch_in_blocks_breaks_ties_by_key(spark):
    from lumenweave.functions.vector import knn_batch

    rows = spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(40, 0, -1)], "i long, embedding array<double>").repartition(3)
    got = knn_batch(rows.where("i <= 12"), rows, 4, "i", "i", block=5).orderBy("query", "rank").collect()
    want = [(q, n) for q in range(1, 13) for n in [x for x in range(1, 41) if x % 3 == q % 3][:4]]
    assert [(r["query"], r.neighbour) for r in got] == want


def test_chunks_leave_a_task_in_small_batches():
    import pyarrow as pa

    texts = [None, " ", *("word é " * (n % 400 + 1) for n in range(3000)), "x " * 900_000]
    batch = pa.RecordBatch.from_pydict({"n": list(range(len(texts))), "text": texts})
    names = ["n", "chunk_index", "chunk_text", "char_start", "char_end", "token_estimate"]
    out = list(T._cut(names, 800, 120)(iter([batch])))
    longest = max(len(t) for b in out for t in b.column(2).to_pylist())
    assert len(out) > 3 and all(sum(map(len, b.column(2).to_pylist())) < T.GROUP + longest for b in out)
    got = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert got == [(n, *c.values()) for n, t in enumerate(texts) if t for c in T.windows(t)]


def test_chunks_are_cut_without_a_gathered_column(spark):
    docs = spark.createDataFrame([(1, "a b", [1.5])], "n long, text string, v array<double>")
    chunks = T.token_chunks(docs)
    assert "ArrowEvalPython" not in chunks._jdf.queryExecution().optimizedPlan().toString()  # which would hold all chunks of 10,000 texts at once
    assert [tuple(r) for r in chunks.collect()] == [(1, [1.5], 0, "a b", 0, 3, 2)]


class Narrow(HashingEmbedder):
    """Takes no more than some megabytes at once."""

    def encode(self, texts):
        assert sum(map(len, texts)) < 2_000_000
        return super().encode(texts)


def test_an_embedder_gets_a_large_batch_in_groups(spark):
    texts = [None, "", *(f"word{n} and " * 300 for n in range(2000))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").coalesce(1)
    got = [r.v for r in rows.select("i", embed(F.col("t"), Narrow(8)).alias("v")).orderBy("i").collect()]
    assert np.array_equal(got, HashingEmbedder(8).encode(texts))
    assert rows.limit(0).select(embed(F.col("t"), Narrow(8))).count() == 0


def test_a_batch_of_vectors_is_compared_slice_by_slice():
    import tracemalloc

    import pandas as pd

    from lumenweave.functions.vector import _nearest

    rng = np.random.default_rng(3)
    kinds = rng.normal(size=(40, 64)).astype("float32")
    which = rng.integers(0, 40, 10_000)
    rows = pd.DataFrame({"i": rng.permutation(10_000), "v": [None, *(kinds[w] for w in which[1:])]})
    q = np.tile(kinds, (12, 1)).astype(float)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    tracemalloc.start()
    found = pd.concat(_nearest(list(range(len(q))), q, 20, "i", "v")(iter([rows, rows.iloc[:0]])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # all distances of the batch alone are 38 MB, and their order as much again
    for n, part in found.groupby("query"):
        assert part["neighbour"].tolist() == sorted(rows["i"][1:][which[1:] == n % 40])[:20]
