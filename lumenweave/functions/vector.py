"""Exact cosine distance and nearest neighbours over array columns. Lower is nearer."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_vector(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos; null where a vector is null, has no length or a null part."""
    return F.lit(1.0) - dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def distance_to(column: Column, query: Sequence[float]) -> Column:
    """Cosine distance to a fixed vector, whose length is computed once, on the driver. Vectors of another width are an error."""
    width = len(query)
    size = math.sqrt(sum(float(v) ** 2 for v in query))
    if not width or not size:
        raise ValueError("the query vector has no length")
    right = F.when(column.isNull() | (F.size(column) == width), column).otherwise(F.raise_error(F.lit(f"a vector is not {width} wide")))
    return F.lit(1.0) - dot(right, as_vector(query)) / F.nullif(F.sqrt(dot(column, column)) * F.lit(size), F.lit(0.0))


def knn(rows: DataFrame, query: Sequence[float], k: int, key: str, vector: str = "embedding", digits: int | None = 6) -> DataFrame:
    """The k nearest rows, with score; equal scores by key. One scan and a bounded sort in each task."""
    score = distance_to(F.col(vector), query)
    score = F.round(score, digits) if digits is not None else score
    held = rows.where(F.col(vector).isNotNull()).withColumn("score", score).drop(vector)
    return held.where(F.col("score").isNotNull()).orderBy("score", key).limit(k)


def knn_null_safe(rows: DataFrame, query: Sequence[float], k: int, key: str, vector: str = "embedding", digits: int = 6) -> DataFrame:
    """As knn over all rows: an unknown or NaN distance counts as 1."""
    score = F.coalesce(F.nanvl(distance_to(F.col(vector), query), F.lit(1.0)), F.lit(1.0))
    return rows.withColumn("score", F.round(score, digits)).drop(vector).orderBy("score", key).limit(k)


#: Rows whose distances to a block of queries are held at once.
SLICE = 1024


def _nearest(names, q, k: int, key: str, vector: str):
    """Each task's k nearest rows of each query of a block, ties by key."""
    import numpy as np
    import pandas as pd

    def run(batches):
        dist = keys = None
        for part in batches:
            part = part[part[vector].notna()]
            for at in range(0, len(part), SLICE):
                some = part.iloc[at : at + SLICE]
                own = np.stack(some[vector].to_numpy()).astype(float)
                m = np.zeros((SLICE, own.shape[1]))  # of one shape always, so that equal vectors have equal distances
                m[: len(own)] = own / np.linalg.norm(own, axis=1, keepdims=True)
                d = (1 - q @ m.T)[:, : len(own)]
                own = np.broadcast_to(some[key].to_numpy(), d.shape)
                if dist is not None:
                    d, own = np.concatenate([dist, d], axis=1), np.concatenate([keys, own], axis=1)
                keep = np.lexsort((own, d), axis=1)[:, :k]
                dist, keys = np.take_along_axis(d, keep, 1), np.take_along_axis(own, keep, 1)
        if dist is not None:
            yield pd.DataFrame({"query": np.repeat(names, dist.shape[1]), "neighbour": keys.ravel(), "score": dist.ravel()})

    return run


def knn_batch(queries: DataFrame, rows: DataFrame, k: int, query_key: str, key: str, vector: str = "embedding", block: int = 512) -> DataFrame:
    """The k nearest rows of each query, equal distances by key; a query without a vector has none. Extra: queries are dealt into blocks of
    about block arrays, with one pass of rows each; each task keeps k rows a query of its own before they meet."""
    import numpy as np
    from pyspark.sql import Window

    usable = queries.where(F.col(vector).isNotNull()).select(query_key, vector)
    n = max(1, -(-usable.count() // block))
    kinds = dict(rows.dtypes)
    schema = f"query {dict(queries.dtypes)[query_key]}, neighbour {kinds[key]}, score double"
    found = None
    for b in range(n):
        held = usable.where(F.pmod(F.xxhash64(query_key), F.lit(n)) == b).collect()
        if not held and (found is not None or b < n - 1):
            continue
        q = np.array([r[vector] for r in held], float).reshape(len(held), -1)
        q /= np.linalg.norm(q, axis=1, keepdims=True)
        source = rows.select(key, vector) if held else rows.select(key, vector).limit(0)
        near = source.mapInPandas(_nearest([r[query_key] for r in held], q, k, key, vector), schema)
        found = near if found is None else found.unionByName(near)
    rank = Window.partitionBy("query").orderBy("score", "neighbour")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
