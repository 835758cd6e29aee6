"""The search pipeline: nearest rows of both kinds, thresholds, type filter, merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenweave.functions.classify import matches_media_type
from lumenweave.functions.text import snippet
from lumenweave.functions.vector import knn, knn_null_safe
from lumenweave.operators.library import distinct_paths, index_stats

#: Candidates of each kind without and with a type filter; results; text files kept.
K, K_FILTERED, LIMIT, TEXT_FILES = 120, 240, 120, 80
# Largest distance, and window beyond the best, by kind.
THRESHOLDS = {"text": (0.82, 0.22), "image": (0.995, 0.035)}


def best_per_file(rows: DataFrame, path: str = "file_path", key: str = "id") -> DataFrame:
    """The nearest row of each file."""
    rank = Window.partitionBy(path).orderBy("score", key)
    return rows.withColumn("__r", F.row_number().over(rank)).where("__r = 1").drop("__r")


def dedupe_chunks(rows: DataFrame, limit: int = TEXT_FILES, text: str = "chunk_text", key: str = "id") -> DataFrame:
    """The nearest chunk of each file, at most limit of them, with a short snippet."""
    return best_per_file(rows, key=key).orderBy("score", key).limit(limit).withColumn("snippet", snippet(F.col(text))).drop(text)


def relevance_threshold(rows: DataFrame, kind: str) -> DataFrame:
    """Rows up to the lesser of a fixed distance and the best distance plus a window. The best is one row, joined by broadcast."""
    most, window = THRESHOLDS[kind]
    best = rows.agg(F.min("score").alias("__best"))
    cut = F.least(F.lit(most), F.col("__best") + F.lit(window))
    return rows.crossJoin(F.broadcast(best)).where(F.col("score") <= cut).drop("__best")


def interleave(texts: DataFrame, images: DataFrame, limit: int = LIMIT, key: str = "id") -> DataFrame:
    """Two texts, one image, and so on; of a file in both lists only the row that comes first.

    texts and images have one schema with file_path and score. Slots are shared out before
    the merge: images get at most a third (10 at least), texts the rest; if one list is
    empty the other fills all. Adds rank. At most limit rows of each side are looked at.
    """
    if limit <= 0:
        return texts.limit(0).withColumn("rank", F.lit(0).cast("long"))
    by = Window.orderBy("score", key)
    first = lambda rows: held(best_per_file(rows, key=key).orderBy("score", key).limit(limit))  # noqa: E731  no more can find a slot
    t = first(texts).withColumn("__i", F.row_number().over(by) - 1).withColumn("__kind", F.lit(0))
    i = first(images).withColumn("__i", F.row_number().over(by) - 1).withColumn("__kind", F.lit(1))
    n = t.agg(F.count("*").alias("__nt")).crossJoin(i.agg(F.count("*").alias("__ni")))
    share = F.least(F.col("__ni"), F.lit(max(10, limit // 3)))
    slots_i = F.when(F.col("__nt") == 0, F.lit(limit)).otherwise(share)
    slots_t = F.when(F.col("__ni") == 0, F.lit(limit)).otherwise(F.least(F.col("__nt"), F.greatest(F.lit(limit) - share, F.lit(0))))
    both = t.unionByName(i).crossJoin(F.broadcast(n)).where(F.col("__i") < F.when(F.col("__kind") == 0, slots_t).otherwise(slots_i))
    # in the common case no file is in both lists, and rounds say it all; a file in both keeps its earlier place
    turn = F.when(F.col("__kind") == 0, F.floor(F.col("__i") / 2)).otherwise(F.col("__i"))
    placed = both.withColumn("__turn", turn)
    again = Window.partitionBy("file_path").orderBy("__turn", "__kind", "__i")
    placed = placed.withColumn("__first", F.row_number().over(again)).where("__first = 1")
    # rounds are closed up after what was dropped
    closed = Window.partitionBy("__kind").orderBy("__i")
    placed = placed.withColumn("__j", F.row_number().over(closed) - 1)
    turn = F.when(F.col("__kind") == 0, F.floor(F.col("__j") / 2)).otherwise(F.col("__j"))
    ranked = placed.withColumn("rank", F.row_number().over(Window.orderBy(turn, "__kind", "__j")).cast("long"))
    return ranked.where(F.col("rank") <= limit).select(*texts.columns, "rank")


def held(hits: DataFrame) -> DataFrame:
    """What a top-k or a limit left (some hundred rows), as a local table in one partition: the steps after it neither search again nor shuffle."""
    return hits.sparkSession.createDataFrame(hits.collect(), hits.schema).coalesce(1)


RESULT = ("id", "file_path", "mime_type", "source_type", "metadata", "chunk_index", "snippet", "score")


def unified_search(items: DataFrame, chunks: DataFrame, item_query: Sequence[float], chunk_query: Sequence[float], kind: str | None = None) -> DataFrame:
    """Texts and images near a query, filtered, cut and merged. kind given (even 'all') doubles the candidates, as the filter comes after them.

    items: id, file_path, mime_type, source_type, metadata, embedding; chunks also chunk_index and chunk_text.
    """
    k = K if kind is None else K_FILTERED
    return merged(dedupe_chunks(held(knn(chunks, chunk_query, k, "id"))), held(knn(items, item_query, k, "id")), kind)  # k rows each


def merged(texts: DataFrame, images: DataFrame, kind: str | None = None) -> DataFrame:
    """The nearest texts (one a file, with snippet and chunk_index) and the nearest images, filtered, cut and merged."""
    none = lambda t: F.lit(None).cast(t)
    texts, images = texts.select(*RESULT), images.withColumns({"chunk_index": none("long"), "snippet": none("string")}).select(*RESULT)
    sides = []
    for rows, name in ((texts, "text"), (images, "image")):
        wanted = matches_media_type(kind, F.col("file_path"), F.col("mime_type"), F.col("source_type"), F.col("metadata"), F.col("chunk_index"))
        sides.append(relevance_threshold(rows.where(wanted), name))
    return interleave(*sides)


def search(items: DataFrame, chunks: DataFrame, text: str, embedder, kind: str | None = None) -> DataFrame:
    """unified_search of a text; blank texts are an error."""
    if not text.strip():
        raise ValueError("the query is empty")
    vector = embedder.encode([f"search_query: {text.strip()}"])[0]
    return unified_search(items, chunks, vector, vector, kind)


def newest(items: DataFrame, k: int, updated: str = "created_s", key: str = "id") -> DataFrame:
    """The k rows last changed, all at the same middling distance."""
    return items.withColumn("score", F.lit(0.5)).orderBy(F.desc(updated), key).limit(k)


def search_with_fallback(items: DataFrame, vector: Sequence[float], k: int, updated: str = "created_s", key: str = "id", embedding: str = "embedding") -> DataFrame:
    """The nearest rows; if none has a distance, all rows that have an embedding, unknown distances counting as 1; if there is none, the newest rows. Adds score and tier (0, 1, 2)."""
    near = held(knn(items, vector, k, key, embedding))
    if near.limit(1).count():
        return near.withColumn("tier", F.lit(0))
    with_vector = items.where(F.col(embedding).isNotNull())
    if with_vector.limit(1).count():
        return knn_null_safe(with_vector, vector, k, key, embedding).withColumn("tier", F.lit(1))
    return newest(items, k, updated, key).drop(embedding).withColumn("tier", F.lit(2))


def search_status(items: DataFrame, chunks: DataFrame, embedder=None) -> DataFrame:
    """One row: model_loaded, indexed_count (files of either kind), items, frames, regular, chunks, and status (ready or not_ready)."""
    files = distinct_paths(items, chunks).agg(F.count("*").alias("indexed_count"))
    stats = index_stats(items, chunks).drop("text_mb")
    loaded = embedder is not None
    return files.crossJoin(F.broadcast(stats)).select(F.lit(loaded).alias("model_loaded"), "indexed_count", *stats.columns, F.lit("ready" if loaded else "not_ready").alias("status"))


def visual_search(items: DataFrame, vector: Sequence[float], k: int = 20) -> DataFrame:
    return knn(items, vector, k, "id")
