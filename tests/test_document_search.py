"""The one-pass search beside the search of chunks with embeddings."""

import random

import pytest
from pyspark.sql import functions as F

from lumenweave.functions.embed import HashingEmbedder, embed
from lumenweave.functions.text import token_chunks
from lumenweave.functions.vector import knn
from lumenweave.operators import document_search as D
from lumenweave.operators import search as S

EMBEDDER = HashingEmbedder(32)
QUERY = EMBEDDER.encode(["red bicycle near the river"])[0].tolist()


def docs(spark):
    rng = random.Random(13)
    words = "red blue bicycle river the near a tower of glass".split()
    rows = [(f"/d/{i}", " ".join(rng.choice(words) for _ in range(rng.choice([3, 50, 900, 2000])))) for i in range(30)]
    rows += [("/d/same", rows[0][1]), ("/d/null", None), ("/d/blank", " \n "), ("/d/other", "zzz")]
    return spark.createDataFrame(rows, "file_path string, text string").repartition(5)


def as_chunks(rows):
    pieces = token_chunks(rows).withColumn("id", F.concat_ws(":", F.lit("text"), F.col("file_path"), F.col("chunk_index").cast("string")))
    return pieces.withColumns({"embedding": embed(F.col("chunk_text"), EMBEDDER), "mime_type": F.lit("text/plain"), "source_type": F.lit("text_chunk"), "metadata": F.lit('{"source_type":"text_chunk"}')})


@pytest.mark.parametrize("k", [1, 7, 500])
def test_nearest_chunks_are_the_same(spark, k):
    rows = docs(spark)
    want = [tuple(r) for r in knn(as_chunks(rows).select("id", "file_path", "chunk_index", "embedding"), QUERY, k, "id").collect()]
    assert [tuple(r) for r in D.nearest_chunks(rows, QUERY, EMBEDDER, k).collect()] == want
    texts = {r.id: r.chunk_text for r in as_chunks(rows).collect()}
    shown = D.with_text(S.held(D.nearest_chunks(rows, QUERY, EMBEDDER, k)), rows).collect()
    assert len(shown) == len(want) and all(r.chunk_text == texts[r.id] for r in shown)


def test_the_whole_search_is_the_same(spark):
    rows = docs(spark)
    items = spark.createDataFrame([(f"i{i}", f"/v/{i}.jpg", "image/jpeg", None, "{}", [float(i % 5), 1.0, float(i)]) for i in range(40)], "id string, file_path string, mime_type string, source_type string, metadata string, embedding array<double>")
    for kind in (None, "document", "image"):
        want = [tuple(r) for r in S.unified_search(items, as_chunks(rows), [1.0, 0.5, 2.0], QUERY, kind).orderBy("rank").collect()]
        got = [tuple(r) for r in D.search_documents(items, rows, [1.0, 0.5, 2.0], QUERY, EMBEDDER, kind).orderBy("rank").collect()]
        assert got == want and got


def test_texts_do_not_leave_the_tasks(spark):
    plan = D.nearest_chunks(docs(spark), QUERY, EMBEDDER, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "chunk_text" not in plan
    assert D.nearest_chunks(docs(spark).limit(0), QUERY, EMBEDDER, 5).count() == 0
    with pytest.raises(ValueError):
        D.nearest_chunks(docs(spark), [0.0] * 32, EMBEDDER, 5)


class Narrow(HashingEmbedder):
    """Takes no more than some megabytes at once."""

    def encode(self, texts):
        assert sum(map(len, texts)) < 1_500_000
        return super().encode(texts)


def test_a_task_embeds_by_the_megabyte_also_in_long_texts(spark):
    texts = [f"word{n} red bicycle " * (n % 300) for n in range(600)] + ["near the river " * 200_000, None, " "]
    rows = spark.createDataFrame([(f"/d/{n}", t) for n, t in enumerate(texts)], "file_path string, text string").coalesce(1)
    want = [tuple(r) for r in D.nearest_chunks(rows.repartition(5), QUERY, EMBEDDER, 7).collect()]
    assert [tuple(r) for r in D.nearest_chunks(rows, QUERY, Narrow(32), 7).collect()] == want


def test_nearest_chunks_reads_arrow_batches():
    import pyarrow as pa

    from lumenweave.functions.embed import HashingEmbedder
    from lumenweave.operators.document_search import _nearest

    e = HashingEmbedder(8)
    rows = pa.RecordBatch.from_pydict({"path": ["p", "q", None], "text": ["a b", None, "c"]})
    (out,) = _nearest(e.encode(["a b"])[0].tolist(), e, 5)(iter([rows, rows.slice(0, 0)]))
    assert set(zip(out["file_path"].to_pylist(), out["chunk_index"].to_pylist())) == {("p", 0), (None, 0)}
