"""Search in documents that are chunked and embedded as they are read: only ranks leave a task, texts are fetched for what is shown.

A task cuts its documents into chunks, embeds them and measures their distance in one pass, and
hands on its k best as ids and scores; texts are read from the Arrow batch one by one. Chunk texts and vectors never leave the task; the texts
of the rows that are shown (as many as the result has) are cut again by key afterwards.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweave.functions.embed import Embedder
from lumenweave.functions.text import snippet, token_chunks, windows
from lumenweave.functions.vector import knn
from lumenweave.operators import search as S

#: Characters of the chunks that are embedded at once.
GROUP = 1 << 20


def _nearest(query: Sequence[float], embedder: Embedder, k: int):
    q = np.array(query, float)
    q = q / math.sqrt(float(q @ q))

    def distances(texts: list[str]) -> np.ndarray:
        m = np.asarray(embedder.encode(texts), float)
        size = np.sqrt((m * m).sum(axis=1))
        with np.errstate(invalid="ignore", divide="ignore"):
            return 1.0 - (m @ q) / size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple] = []  # at most k, and what is as near as the last

        def take(held: list[tuple], texts: list[str]) -> list[tuple]:
            found = [(round(float(d), 9), *h) for d, h in zip(distances(texts), held, strict=True) if not math.isnan(d)]
            found += best
            if len(found) <= k:
                return found
            last = heapq.nsmallest(k, found)[-1][0] + 1e-6  # ranks are by six digits
            return [x for x in found if x[0] <= last]

        held: list[tuple] = []
        texts: list[str] = []
        size = 0
        for part in batches:
            for at, value in enumerate(part.column("text")):
                text, path = value.as_py(), part.column("path")[at].as_py()
                for c in windows(text) if isinstance(text, str) else []:
                    held.append((f"text:{path}:{c['chunk_index']}", path, c["chunk_index"]))
                    texts.append(c["chunk_text"])
                    size += len(c["chunk_text"])
                    if size > GROUP:
                        best = take(held, texts)
                        held, texts, size = [], [], 0
        if texts:
            best = take(held, texts)
        if best:
            score, *rest = zip(*best, strict=True)
            columns = [pa.array(v, kind) for v, kind in zip((*rest, score), (pa.string(), pa.string(), pa.int64(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "file_path", "chunk_index", "score"])
        pa.default_memory_pool().release_unused()  # the worker lives on

    return run


def nearest_chunks(docs: DataFrame, query: Sequence[float], embedder: Embedder, k: int, path: str = "file_path", text: str = "text", digits: int = 6) -> DataFrame:
    """id, file_path, chunk_index, score of the k chunks nearest to a query vector, equal scores by id."""
    if not len(query) or not any(query):
        raise ValueError("the query vector has no length")
    rows = docs.select(F.col(path).alias("path"), F.col(text).alias("text"))
    near = rows.mapInArrow(_nearest(query, embedder, k), "id string, file_path string, chunk_index long, score double")
    return near.withColumn("score", F.round("score", digits)).orderBy("score", "id").limit(k)


def with_text(hits: DataFrame, docs: DataFrame, path: str = "file_path", text: str = "text") -> DataFrame:
    """hits (a top-k: file_path, chunk_index and others) with chunk_text; only documents that were hit are cut again."""
    wanted = hits.select(F.col("file_path").alias("__path")).distinct()
    some = docs.select(F.col(path).alias("__path"), F.col(text).alias("text")).join(F.broadcast(wanted), "__path", "left_semi")  # k rows
    pieces = token_chunks(some).select("__path", F.col("chunk_index").alias("__i"), "chunk_text")
    return pieces.join(F.broadcast(hits), (F.col("__path") == F.col("file_path")) & (F.col("__i") == F.col("chunk_index"))).select(*hits.columns, "chunk_text")


def document_hits(docs: DataFrame, query: Sequence[float], embedder: Embedder, k: int, files: int = S.TEXT_FILES) -> DataFrame:
    """The nearest chunk of each file, with its snippet, of the k nearest chunks."""
    best = S.held(S.best_per_file(S.held(nearest_chunks(docs, query, embedder, k))).orderBy("score", "id").limit(files))
    return with_text(best, docs).withColumn("snippet", snippet(F.col("chunk_text"))).drop("chunk_text")


def search_documents(items: DataFrame, docs: DataFrame, item_query: Sequence[float], chunk_query: Sequence[float], embedder: Embedder, kind: str | None = None) -> DataFrame:
    """operators.search.unified_search over documents (file_path, text) instead of chunks with embeddings."""
    k = S.K if kind is None else S.K_FILTERED
    texts = S.held(document_hits(docs, chunk_query, embedder, k)).withColumns({"mime_type": F.lit("text/plain"), "source_type": F.lit("text_chunk"), "metadata": F.lit('{"source_type":"text_chunk"}')})
    return S.merged(texts, S.held(knn(items, item_query, k, "id")), kind)
