"""Exact nearest neighbours of many queries without all pairs: pivots, rings and the triangle inequality.

Vectors are scaled to length 1, where the cosine distance is half the square of a distance in
space, so bounds hold. Each row is kept with its nearest pivot and its distance from it; the
rows of a pivot are cut into rings by that distance. A ring lies between two distances from
its pivot, so it is no nearer to a query than what the query's own distance from the pivot
leaves. A query first reads the rings that are nearest to it, until they hold k rows; the worst
of its best k so far then rules out every ring that cannot hold a better one. All queries are
searched in two passes of one plan, however many they are.

How much is skipped depends on the rows: tight groups are found by reading a few rings, and in
an even cloud of many dimensions hardly a ring can be ruled out. share() says what was read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenweave.sources.shared import settle

#: Most pivots, rows of a ring, queries that meet a block at once.
PIVOTS, RING, TOGETHER = 512, 2048, 512
#: What rounding can add to a distance.
SLACK = 1e-7


def _unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """key, v as key, v: vectors of length 1 as bytes; those without a length, or with null parts, are left out."""
    for rows in batches:
        out, keep = [], []
        for v in rows["v"]:
            x = np.array(v, float)
            size = np.sqrt((x * x).sum())
            good = bool(len(x) and np.isfinite(size) and size > 0)
            keep.append(good)
            if good:
                out.append((x / size).tobytes())
        yield pd.DataFrame({"key": rows["key"][keep].array, "v": out})


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column)).reshape(len(column), -1)


def unit_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    held = rows.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    return held.mapInPandas(_unit, f"key {dict(rows.dtypes)[key]}, v binary")


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


class Rings:
    """What tasks know of an index: pivots, and of each ring its pivot, number, bounds and size. As many as PIVOTS allows."""

    def __init__(self, pivots: np.ndarray, rings: list[tuple]):
        self.pivots, self.rings = pivots, rings

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Of each query and ring, what the distance is at least."""
        cell, _, low, high, _ = (np.array(c) for c in zip(*self.rings, strict=True))
        d = _distances(q, self.pivots)[:, cell]
        return np.maximum(np.maximum(d - high, low - d), 0.0) - SLACK

    def visits(self, q: np.ndarray, k: int, worst: np.ndarray | None, seen: np.ndarray | None) -> list[list[int]]:
        """Rings to read: without worst those that are nearest until they hold k rows, else all that can hold a row as near as worst, but those seen."""
        least, sizes = self.bounds(q), np.array([r[4] for r in self.rings])
        if worst is not None:
            return [[int(i) for i in np.flatnonzero(row <= w + SLACK) if i not in s] for row, w, s in zip(least, worst, seen, strict=True)]
        out = []
        for row in least:
            order = np.argsort(row, kind="stable")
            out.append([int(i) for i in order[: 1 + int(np.searchsorted(np.cumsum(sizes[order]), k))]])
        return out


class Index:
    """rows: unit vectors by pivot and ring, as a settled table; pivots and rings are as many as PIVOTS allows and the rows need."""

    def __init__(self, rows: DataFrame, key: str, vector: str = "embedding", most: int = PIVOTS, ring: int = RING):
        self.key_type = dict(rows.dtypes)[key]
        unit = settle(unit_vectors(rows, key, vector))
        self.n = unit.count()
        many = max(1, min(most, int(np.sqrt(self.n))))
        chosen = unit.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(many).collect()  # at most PIVOTS rows
        pivots = _matrix([bytes(r["v"]) for r in chosen]) if chosen else np.zeros((0, 0))

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in batches:
                if len(part):
                    d = _distances(_matrix(part["v"]), pivots)
                    yield part.assign(cell=d.argmin(axis=1).astype(np.int32), far=d.min(axis=1))

        placed = settle(unit.mapInPandas(place, f"key {self.key_type}, v binary, cell int, far double"))
        sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("far", F.array(*(F.lit(i / 64) for i in range(1, 64))), 1000).alias("cuts"))
        # as many of the 63 cuts as give rings of about ring rows
        step = F.greatest(F.lit(1), (F.lit(64) / F.greatest(F.ceil(F.col("n") / ring), F.lit(1))).cast("int"))
        cuts = F.array_distinct(F.filter(F.transform("cuts", lambda c, i: F.when((i + 1) % F.col("step") == 0, c)), lambda c: c.isNotNull()))
        cuts = sizes.withColumn("step", step).select("cell", F.when(F.col("n") > ring, cuts).otherwise(F.array().cast("array<double>")).alias("cuts"))
        inside = placed.join(F.broadcast(cuts), "cell")  # at most PIVOTS rows
        inside = inside.withColumn("ring", F.size(F.filter("cuts", lambda c: c < F.col("far")))).drop("cuts")
        self.rows = settle(inside)
        bounds = self.rows.groupBy("cell", "ring").agg(F.min("far").alias("low"), F.max("far").alias("high"), F.count("*").alias("n"))
        rings = sorted((r["cell"], r["ring"], r["low"], r["high"], r["n"]) for r in bounds.collect())  # at most 64 * PIVOTS rows
        self.map, self.ring = Rings(pivots, rings), ring


def _scan(k: int):
    """Rows of a block (kind 0), then the queries that read it; each query's k nearest of the block, none beyond its worst."""

    def best(block, keys, part):
        d = 1.0 - _matrix(part["v"]) @ block.T
        n = d.shape[1]
        kth = np.partition(d, k - 1, axis=1)[:, k - 1] if n > k else np.full(len(d), np.inf)
        a, b = np.nonzero(d <= np.minimum(kth, part["worst"].to_numpy())[:, None] + SLACK)
        exact = 1.0 - (_matrix(part["v"])[a] * block[b]).sum(axis=1)
        return pd.DataFrame({"query": part["query"].to_numpy()[a], "neighbour": keys[b], "score": exact})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, rows, keys, block = None, [], [], None
        for part in batches:
            place = list(zip(part["spot"], part["sub"], part["kind"], strict=True))
            edges = [i for i in range(len(place)) if i == 0 or place[i] != place[i - 1]]
            for i, j in zip(edges, [*edges[1:], len(place)], strict=True):
                spot, sub, kind = place[i]
                if at != (spot, sub):
                    at, rows, keys, block = (spot, sub), [], [], None
                piece = part.iloc[i:j]
                if kind == 0:
                    rows.append(_matrix(piece["v"]))
                    keys.append(piece["neighbour"].to_numpy())
                elif rows:
                    if block is None:
                        block, keys = np.concatenate(rows), np.concatenate(keys)
                    for c in range(0, len(piece), TOGETHER):
                        yield best(block, keys, piece.iloc[c : c + TOGETHER])

    return run


def _pass(index: Index, asked: DataFrame, k: int, query_type: str) -> DataFrame:
    """asked: query, v, worst, spots (rings to read). query, neighbour, score of the best rows of each ring."""
    spark = asked.sparkSession
    shape = [(i, r[0], r[1], -(-r[4] // (2 * index.ring))) for i, r in enumerate(index.map.rings)]  # rings that equal distances made large are read in parts
    spots = F.broadcast(spark.createDataFrame(shape, "spot int, cell int, ring int, parts int"))
    rows = index.rows.join(spots, ["cell", "ring"]).select("spot", F.pmod(F.xxhash64("key"), "parts").cast("int").alias("sub"), F.lit(0).alias("kind"), F.lit(None).cast(query_type).alias("query"), F.col("key").alias("neighbour"), "v", F.lit(0.0).alias("worst"))
    reads = asked.select("query", "v", "worst", F.explode("spots").alias("spot")).join(spots, "spot")
    reads = reads.select("spot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("sub"), F.lit(1).alias("kind"), "query", F.lit(None).cast(index.key_type).alias("neighbour"), "v", "worst")
    dealt = rows.unionByName(reads).repartition("spot", "sub").sortWithinPartitions("spot", "sub", "kind")
    return dealt.mapInPandas(_scan(k), f"query {query_type}, neighbour {index.key_type}, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    place = Window.partitionBy("query").orderBy("score", "neighbour")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def knn_pivots(queries: DataFrame, index: Index, k: int, query_key: str, vector: str = "embedding") -> DataFrame:
    """query, neighbour, score (cosine distance), rank (from 1) of the k nearest rows of each query, equal distances by key; a query without a usable vector has none.

    Query keys are unique.
    """
    kind, known = dict(queries.dtypes)[query_key], index.map
    asked = settle(unit_vectors(queries, query_key, vector).withColumnRenamed("key", "query"))
    if not index.n:
        return _top(asked.select("query", F.lit(None).cast(index.key_type).alias("neighbour"), F.lit(0.0).alias("score")).limit(0), k)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                yield part.assign(worst=np.inf, spots=known.visits(_matrix(part["v"]), k, None, None))

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                far = part["worst"].fillna(np.inf).to_numpy()
                more = known.visits(_matrix(part["v"]), k, np.sqrt(2 * np.maximum(far, 0.0)), [set(s) for s in part["spots"]])
                yield part.assign(worst=far, spots=more)

    shape = f"query {kind}, v binary, worst double, spots array<int>"
    nearest = settle(asked.mapInPandas(first, shape))
    near = settle(_top(_pass(index, nearest, k, kind), k))
    worst = near.groupBy("query").agg(F.max("score").alias("worst"), F.count("*").alias("n")).select("query", F.when(F.col("n") >= k, F.col("worst")).alias("worst"))
    bounded = nearest.drop("worst").join(worst, "query", "left").select("query", "v", F.col("worst"), "spots")
    far = _pass(index, bounded.mapInPandas(rest, shape), k, kind)
    return _top(near.select("query", "neighbour", "score").unionByName(far), k)


def share(queries: DataFrame, index: Index, found: DataFrame, query_key: str, vector: str = "embedding") -> float:
    """Of all pairs of a query and a row, how many lie in rings that the worst of found (a result of knn_pivots) does not rule out."""
    asked = unit_vectors(queries, query_key, vector).withColumnRenamed("key", "query")
    far = asked.join(found.groupBy("query").agg(F.max("score").alias("worst")), "query")
    known = index.map
    sizes = np.array([r[4] for r in known.rings])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                open_ = known.bounds(_matrix(part["v"])) <= np.sqrt(2 * np.maximum(part["worst"].to_numpy(), 0.0))[:, None] + SLACK
                yield pd.DataFrame({"pairs": open_ @ sizes})

    got = far.mapInPandas(count, "pairs long").agg(F.sum("pairs"), F.count("*")).first()
    return (got[0] or 0) / max(1, got[1] * index.n)
