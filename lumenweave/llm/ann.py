"""Nearest neighbours by inner product through a forest of random-projection trees.

The largest inner product is the least distance once each vector has one more coordinate,
sqrt(M**2 - |x|**2) with M the largest length, and each query a zero there. A tree turns
these vectors by a random rotation of its own and halves them level by level at the median of
one turned coordinate; medians are fitted on a bounded sample (SAMPLE distinct vectors), and
then every row is placed in its leaf of every tree.

A query first reads its own leaf of each tree. Its best K + 1 rows so far say where neighbours
lie, and how widely, and so how likely one is on either side of a split (in two views, see
Forest.views). All trees share one priority queue of nodes by that likelihood; leaves are
taken from it until the trees together hold a neighbour with probability TARGET in each view. So a query in a dense place reads few leaves and
one in an even cloud reads many, whatever the size of the table. The rows of the leaves
taken are compared exactly, in double precision.

Equal vectors are one row with their K + 1 smallest ids (no more of them can be among K), so
a vector that a third of all rows share is searched once. Leaves of more than BLOCK rows are
read in blocks, each in a task of its own if need be; queries pass through a block in a
stream.

Edge cases: vectors null, empty, zero, or holding null or non-finite entries take no part,
nor do rows with a null id; vectors shorter than the widest count as padded with zeros; rows
of one id and one vector count once, and of one id and two vectors are two candidates and
two queries; with fewer than K + 1 different vectors every leaf is read; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenweave.llm.common import settle, table

K = 20
TREES = 8
#: Rows of a leaf, about, as long as the sample has LEAST of its own in each.
LEAF = 512
LEAST = 8
#: Distinct vectors that the medians are fitted on, about.
SAMPLE = 32_768
#: Probability with which the leaves that a query reads hold a neighbour, if those lie as a view expects.
TARGET = 0.93
#: Rows of a leaf that one block holds.
BLOCK = 4096
#: Queries that meet a block in one product.
TOGETHER = 512


def vectors(rows: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """id and v, the vector's doubles as bytes; rows that take no part left out."""
    held = rows.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & F.col("id").isNotNull())
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = held.where(~bad & F.exists("v", lambda c: c != 0))
    width = good.agg(F.max(F.size("v"))).first()[0] or 0

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = np.zeros((len(part), width))
            for row, v in zip(out, part["v"], strict=True):
                row[: len(v)] = v
            yield pd.DataFrame({"id": part["id"], "v": [(row + 0.0).tobytes() for row in out]})  # -0.0 as 0.0

    return good.mapInPandas(pack, f"id {dict(good.dtypes)['id']}, v binary")


def unpack(column) -> np.ndarray:
    """Bytes of a column as a matrix of doubles."""
    data = b"".join(column)
    return np.frombuffer(data).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def classes(found: DataFrame, asks, k: int = K) -> DataFrame:
    """Of each distinct vector: uid, v, ids (its k + 1 smallest, rising) and asks (whether one of its rows is a query)."""
    once = found.dropDuplicates(["id", "v"])
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    least = once.withColumn("__place", place).where(F.col("__place") <= k + 1)
    ids = least.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    asking = found.where(asks).select("v").distinct().withColumn("asks", F.lit(True))
    out = ids.join(asking, "v", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    return settle(out.withColumn("uid", F.monotonically_increasing_id()))


class Forest:
    """The fitted trees: rotations, medians and spreads. As large as the sample at most, whatever the table."""

    def __init__(self, sample: np.ndarray, longest: float, n: int, trees: int = TREES, leaf: int = LEAF, seed: int = 11):
        self.longest = longest
        a = self.lifted(sample)
        d = a.shape[1]
        deep = min(math.log2(max(n, 1) / leaf), math.log2(max(len(a), 1) / LEAST))
        self.depth = max(0, math.ceil(deep))
        self.trees = trees if self.depth else 1
        self.centre = a.mean(axis=0)
        off = a - self.centre
        spread = float((off**2).sum(axis=1).mean())
        rng = np.random.default_rng(seed)
        self.turn, self.medians, self.share = [], [], []
        for _ in range(self.trees):
            q = np.linalg.qr(rng.normal(size=(d, d)))[0]
            turn = q[:, [level % d for level in range(self.depth)]]
            p = off @ turn
            at, medians = np.zeros(len(a), np.int64), []
            for level in range(self.depth):
                cut = np.zeros(1 << level)
                order = np.argsort(at, kind="stable")
                bounds = np.searchsorted(at[order], np.arange((1 << level) + 1))
                for node in range(1 << level):
                    inside = p[order[bounds[node] : bounds[node + 1]], level]
                    cut[node] = np.median(inside) if len(inside) else 0.0
                medians.append(cut)
                at = 2 * at + (p[:, level] > cut[at])
            self.turn.append(turn)
            self.medians.append(medians)
            self.share.append(p.var(axis=0) / max(spread, 1e-300))

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Rows with the coordinate that makes inner products distances."""
        return np.c_[x, np.sqrt(np.maximum(self.longest**2 - (x**2).sum(axis=1), 0.0))]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree; leaves of all trees are numbered in one sequence."""
        off = self.lifted(x) - self.centre
        out = np.zeros((len(x), self.trees), np.int64)
        for t in range(self.trees):
            p = off @ self.turn[t]
            for level in range(self.depth):
                out[:, t] = 2 * out[:, t] + (p[:, level] > self.medians[t][level][out[:, t]])
        return out + (np.arange(self.trees) << self.depth)

    def views(self, q: np.ndarray, best: np.ndarray, worst: float) -> list[tuple[np.ndarray, float]]:
        """Where a neighbour is expected, and its mean squared distance from there, in two ways.

        The triangle of centre, query and neighbour gives so much of the query's offset and
        leaves the rest to any direction, which is right in an even cloud; the best rows so
        far show it where rows lie in groups or differ in length.
        """
        found = self.lifted(best) - self.centre
        off = np.r_[q, 0.0] - self.centre
        own, wide = float(off @ off), float((found**2).sum(axis=1).mean())
        far = max(self.longest**2 + float(q @ q) - 2 * worst, 0.0)
        pull = (own + wide - far) / (2 * own) if own > 0 else 0.0
        mean = found.mean(axis=0)
        least = max(1e-12 * self.longest**2, 1e-300)
        return [(pull * off, max(wide - pull**2 * own, least)), (mean, max(float(((found - mean) ** 2).sum()) / max(len(found) - 1, 1), least))]

    def search(self, q: np.ndarray, best: np.ndarray | None, worst: float, target: float = TARGET) -> list[int]:
        """Leaves for a query whose best rows so far are best, the last with the inner product worst (None: fewer than k were found; every leaf of one tree)."""
        if best is None or not self.depth:
            return list(range(1 << self.depth))
        views = []
        for mean, rest in self.views(q, best, worst):
            widths = [np.sqrt(rest * np.maximum(share, 1 / len(mean))) for share in self.share]
            views.append(([mean @ turn for turn in self.turn], widths, [1.0] * self.trees))
        # one queue for all trees and both views: (-log of the likelihood, view, tree, level, node)
        queue = [(0.0, w, t, 0, 0) for w in range(len(views)) for t in range(self.trees)]
        open_, out = set(range(len(views))), set()
        while queue and open_:
            cost, w, t, level, node = heapq.heappop(queue)
            if w not in open_:
                continue
            mean, width, missed = views[w]
            if level == self.depth:
                out.add((t << self.depth) + node)
                missed[t] = max(missed[t] - math.exp(-cost), 0.0)
                if math.prod(missed) <= 1 - target:
                    open_.discard(w)
                continue
            left = 0.5 * math.erfc((mean[t][level] - self.medians[t][level][node]) / width[t][level] / math.sqrt(2))
            for side, p in ((0, left), (1, 1 - left)):
                if p > 1e-12:
                    heapq.heappush(queue, (cost - math.log(p), w, t, level + 1, 2 * node + side))
        return sorted(out)


def fit(rows: DataFrame, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE) -> Forest:
    """rows: uid, v. The sample is taken by a hash of the vector, so it is the same however rows are dealt."""

    def lengths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                yield pd.DataFrame({"n": [len(part)], "longest": [float(np.sqrt((unpack(part["v"]) ** 2).sum(axis=1)).max())]})

    whole = rows.select("v").mapInPandas(lengths, "n long, longest double").agg(F.sum("n"), F.max("longest")).first()
    n, longest = whole[0] or 0, whole[1] or 0.0
    every = max(1, -(-n // sample))
    held = rows.where(F.pmod(F.xxhash64("v"), F.lit(every)) == 0).select("v").collect()  # about sample rows
    x = unpack(sorted(bytes(r["v"]) for r in held))
    return Forest(x if len(x) else np.zeros((1, 1)), longest, n, trees, leaf)


def place(rows: DataFrame, forest: Forest) -> DataFrame:
    """uid, v and leaves (one of each tree)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                yield pd.DataFrame({"uid": part["uid"], "v": part["v"], "leaves": list(forest.leaves(unpack(part["v"])).astype(np.int32))})

    return rows.select("uid", "v").mapInPandas(run, "uid long, v binary, leaves array<int>")


def _scan(k: int):
    """Rows of a block come first (kind 0), then the queries that read it; each query's best rows of the block, none below its floor."""

    def best(block, uids, q, quid, floors):
        s = q @ block.T
        n = s.shape[1]
        kth = np.partition(s, n - k, axis=1)[:, n - k] if n > k else np.full(len(q), -np.inf)
        slack = 1e-12 * (1.0 + np.abs(s).max(initial=0.0))
        a, b = np.nonzero(s >= np.maximum(kth, floors)[:, None] - slack)
        exact = (q[a] * block[b]).sum(axis=1)  # one way of adding up for a pair, whatever the block
        return pd.DataFrame({"quid": quid[a], "uid": uids[b], "score": exact})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, rows, uids, block = None, [], [], None
        for part in batches:
            leaf, sub, kind = part["leaf"].to_numpy(), part["sub"].to_numpy(), part["kind"].to_numpy()
            edges = np.flatnonzero(np.r_[True, (leaf[1:] != leaf[:-1]) | (sub[1:] != sub[:-1]) | (kind[1:] != kind[:-1])])
            for i, j in zip(edges, np.r_[edges[1:], len(part)], strict=True):
                if at != (leaf[i], sub[i]):
                    at, rows, uids, block = (leaf[i], sub[i]), [], [], None
                piece = part.iloc[i:j]
                if kind[i] == 0:
                    rows.append(unpack(piece["v"]))
                    uids.append(piece["uid"].to_numpy())
                    continue
                if not rows:  # no row lies in this leaf
                    continue
                if block is None:
                    block, uids = np.concatenate(rows), np.concatenate(uids)
                for c in range(0, len(piece), TOGETHER):
                    some = piece.iloc[c : c + TOGETHER]
                    yield best(block, uids, unpack(some["v"]), some["uid"].to_numpy(), some["floor"].to_numpy())

    return run


def scan(placed: DataFrame, visits: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """quid, uid, score of the best k or more rows of each leaf that a query visits. visits: uid, v, floor, leaf; blocks: leaf, n_blocks."""
    rows = placed.select("uid", "v", F.explode("leaves").alias("leaf")).join(F.broadcast(blocks), "leaf")  # as many leaves as the forest has
    rows = rows.select("leaf", F.pmod(F.xxhash64("uid"), "n_blocks").cast("int").alias("sub"), F.lit(0).alias("kind"), "uid", "v", F.lit(0.0).alias("floor"))
    asked = visits.join(F.broadcast(blocks), "leaf").select("leaf", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("sub"), F.lit(1).alias("kind"), "uid", "v", "floor")
    dealt = rows.unionByName(asked).repartition("leaf", "sub").sortWithinPartitions("leaf", "sub", "kind")
    return dealt.mapInPandas(_scan(k), "quid long, uid long, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    """The best k rows of each query. found: quid, uid, score, first (the least id of the row's vector)."""
    place = Window.partitionBy("quid").orderBy(F.desc("score"), "first", "uid")
    return found.withColumn("__place", F.row_number().over(place)).where(F.col("__place") <= k).drop("__place")


def search(rows: DataFrame, asks=None, k: int = K, vector: str = "embedding", key: str = "vec_id", trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, target: float = TARGET, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query. asks: a Column over id, by default whether 20 divides it."""
    asks = F.col("id") % 20 == 0 if asks is None else asks
    found = settle(vectors(rows, vector, key))
    unique = classes(found, asks, k)
    forest = fit(unique, trees, leaf, sample)
    placed = settle(place(unique, forest))
    firsts = unique.select("uid", F.element_at("ids", 1).alias("first"))
    asking = settle(placed.join(unique.where("asks").select("uid"), "uid"))
    sizes = placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n"))
    blocks = settle(sizes.select("leaf", F.expr(f"CAST((n - 1) div {block} + 1 AS INT)").alias("n_blocks")))
    # own leaves first: they bound the distance of the k-th neighbour
    near = asking.select("uid", "v", F.lit(float("-inf")).alias("floor"), F.explode("leaves").alias("leaf"))
    near = scan(placed, near, blocks, k + 1).groupBy("quid", "uid").agg(F.max("score").alias("score"))
    near = settle(_top(near.join(firsts, "uid"), k + 1))
    best = near.join(placed.select("uid", "v"), "uid").groupBy("quid").agg(F.min("score").alias("worst"), F.collect_list("v").alias("best"))  # at most k + 1
    best = best.where(F.size("best") > k).withColumnRenamed("quid", "uid")

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for q, best, low, own in zip(unpack(part["v"]), part["best"], part["worst"], part["leaves"], strict=True):
                out.append(sorted(set(forest.search(q, None if best is None else unpack(list(best)), low, target)) - set(own)))
            yield pd.DataFrame({"uid": part["uid"], "v": part["v"], "floor": part["worst"].fillna(-math.inf), "more": out})

    bounded = asking.join(best, "uid", "left").select("uid", "v", "worst", "best", "leaves")
    more = bounded.mapInPandas(choose, "uid long, v binary, floor double, more array<int>").select("uid", "v", "floor", F.explode("more").alias("leaf"))
    far = scan(placed, more, blocks, k + 1).groupBy("quid", "uid").agg(F.max("score").alias("score")).join(firsts, "uid")
    both = near.select("quid", "uid", "score", "first").unionByName(far.select("quid", "uid", "score", "first"))
    best = settle(_top(both.groupBy("quid", "uid").agg(F.max("score").alias("score"), F.min("first").alias("first")), k + 1))
    # vectors as their ids again; own: the id may be the query's own row
    ids = best.join(unique.select("uid", "ids"), "uid").select("quid", "score", F.explode("ids").alias("id"), (F.col("uid") == F.col("quid")).alias("own"))
    ids = ids.withColumn("__place", F.row_number().over(Window.partitionBy("quid").orderBy(F.desc("score"), "id"))).where(F.col("__place") <= k + 1)
    lists = ids.groupBy("quid").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "own"))).alias("list"))  # at most k + 1
    lists = lists.join(unique.select(F.col("uid").alias("quid"), "v"), "quid").select("v", "list")
    asked = found.where(asks).select(F.col("id").alias("query_id"), "v").distinct().join(lists, "v")
    others = F.filter("list", lambda x: ~(x["own"] & (x["id"] == F.col("query_id"))))
    out = asked.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (F.lit(0.0) - F.col("x.s")).alias("score"))


def op11_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


QUERIES = {"op11_ann": op11_ann}
