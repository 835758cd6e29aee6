"""Resharding as a minimum-cost flow.

The sizes of the old shards and the capacities of the new ones are a transport problem:
bytes that stay cost nothing, bytes that move cost their distance. Its solution says how
many bytes go from each old shard to each new one; the documents of an old shard, in a
fixed order, are cut at those amounts, and only shards that lose or gain are rewritten.

Law `bytes`: capacities are equal up to one byte. A document that is large against a shard
is placed first, one by one (there are at most LARGE times as many as shards), and the flow
fills what room is left, so cuts fall between small documents.

Edge cases: a null text is of size 16 and crc32 0; null doc_ids are placed as the empty
string; repeated rows, and rows of equal texts, are placed each by their own doc_id, so they may
lie in several shards; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.llm.common import documents, hex_digits, running_total, settle, table

SHARDS = 40
OLD_SHARDS = 32
OVERHEAD = 16
LARGE = 24


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Bytes from old shard i to new shard j at least total cost(i, j) a byte; supplies and capacities have one sum.

    Successive shortest paths with potentials on the bipartite graph. It runs over shards,
    not documents.
    """
    n, m = len(supply), len(capacity)
    left, room = list(supply), list(capacity)
    flow: dict[tuple[int, int], int] = {}
    into: list[set[int]] = [set() for _ in range(m)]
    price = [0.0] * (n + m)
    while any(left):
        dist, back, done = [float("inf")] * (n + m), [-1] * (n + m), [False] * (n + m)
        heap = []
        for i in range(n):
            if left[i]:
                dist[i] = 0.0
                heap.append((0.0, i))
        heapq.heapify(heap)
        end = -1
        while heap:
            d, u = heapq.heappop(heap)
            if done[u]:
                continue
            done[u] = True
            if u >= n and room[u - n]:
                end = u
                break
            steps = ((n + j, cost(u, j)) for j in range(m)) if u < n else ((i, -cost(i, u - n)) for i in into[u - n])
            for v, c in steps:
                if not done[v] and (new := d + c + price[u] - price[v]) < dist[v] - 1e-12:
                    dist[v], back[v] = new, u
                    heapq.heappush(heap, (new, v))
        for u in range(n + m):
            price[u] += min(dist[u], dist[end])
        path = [end]
        while back[path[-1]] >= 0:
            path.append(back[path[-1]])
        path.reverse()
        amount = min(left[path[0]], room[end - n], *(flow[(v, u - n)] for u, v in zip(path[1::2], path[2::2], strict=False)))
        left[path[0]] -= amount
        room[end - n] -= amount
        for u, v in zip(path, path[1:], strict=False):
            i, j, more = (u, v - n, amount) if u < n else (v, u - n, -amount)
            flow[(i, j)] = flow.get((i, j), 0) + more
            into[j].add(i)
            if not flow[(i, j)]:
                del flow[(i, j)]
                into[j].discard(i)
    return flow


def stay_or_move(i: int, j: int) -> float:
    return 0.0 if i == j else 1.0


def even(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def _place_large(large: list, capacity: list[int]) -> list[int]:
    """The shard of each (size, old): the old one if it has room, else the one with most room; the largest come first."""
    room = list(capacity)
    out = []
    for size, old in large:
        j = old if old < len(room) and room[old] >= size else max(range(len(room)), key=lambda k: (room[k], -k))
        room[j] -= size
        out.append(j)
    return out


def reshard(docs: DataFrame, old_shard=None, shards: int = SHARDS, old_shards: int = OLD_SHARDS, per_bucket: int = 50_000) -> DataFrame:
    """Per row: doc_id, size, text_crc32, old_shard, shard, slot. old_shard: a Column over doc_id and text (by default from a hash of doc_id)."""
    spark = docs.sparkSession
    h = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    old = F.pmod(F.conv(F.substring("h", 25, 8), 16, 10).cast("long"), F.lit(old_shards)) if old_shard is None else old_shard
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = documents(docs).withColumn("h", h).select("doc_id", (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), "h", old.cast("int").alias("old_shard"))
    rows = settle(rows.withColumn("rid", F.monotonically_increasing_id()))
    sums = rows.agg(F.sum("size").alias("size"), F.count("*").alias("n")).first()
    total, n = sums["size"] or 0, sums["n"]
    capacity = even(total, shards)
    big = max(1, total // shards // LARGE)
    large = rows.where(F.col("size") > big).select("size", "old_shard", "rid", F.xxhash64("h", "text_crc32").alias("o")).orderBy(F.desc("size"), "o", "rid").collect()  # fewer than LARGE * shards rows
    spots = _place_large([(x["size"], x["old_shard"]) for x in large], capacity)
    room = list(capacity)
    for x, j in zip(large, spots, strict=True):
        room[j] -= x["size"]
    supply = [0] * old_shards
    for x in rows.where(F.col("size") <= big).groupBy("old_shard").agg(F.sum("size").alias("s")).collect():
        supply[x["old_shard"]] = x["s"]
    while min(room) < 0:  # a document larger than a shard: the others share what it takes
        over = sum(-r for r in room if r < 0)
        free = [j for j, r in enumerate(room) if r > 0]
        cut = even(over, len(free))
        room = [max(0, r) for r in room]
        for j, c in zip(free, cut, strict=True):
            room[j] -= c
    flow = min_cost_flow(supply, room, stay_or_move)
    spans, at = [], [0] * old_shards
    for (i, j), amount in sorted(flow.items(), key=lambda x: (x[0][0], x[0][0] != x[0][1], x[0][1])):  # what stays comes first
        spans.append((i, at[i], at[i] + amount, j))
        at[i] += amount
    k = hex_digits(n, per_bucket)
    small = rows.where(F.col("size") <= big).withColumn("bucket", F.substring("h", 1, k))
    small = running_total(small, ["old_shard"], "bucket", [F.col("h"), F.col("text_crc32"), F.col("rid")], F.col("size"), "upto").drop("bucket")
    # one span holds the middle byte of a document; spans: fewer than old_shards + shards rows
    steps = spark.createDataFrame([(i, [x[1:] for x in spans if x[0] == i]) for i in range(old_shards)], "old_shard int, spans array<struct<lo:long,hi:long,shard:int>>")
    mid = F.col("upto") - F.col("size") / 2
    pick = F.filter("spans", lambda s: (s["lo"] < mid) & (mid <= s["hi"]))
    small = small.join(F.broadcast(steps), "old_shard").select(*rows.columns, F.coalesce(F.get(pick, F.lit(0))["shard"], F.col("old_shard")).alias("shard"))
    spot = spark.createDataFrame([(x["rid"], j) for x, j in zip(large, spots, strict=True)], "rid long, shard int")
    placed = small.unionByName(rows.where(F.col("size") > big).join(F.broadcast(spot), "rid").select(*rows.columns, "shard"))
    placed = settle(placed).withColumn("bucket", F.substring("h", 1, k))
    slot = running_total(placed, ["shard"], "bucket", [F.col("h"), F.col("text_crc32"), F.col("rid")], F.lit(1).cast("long"), "slot")
    return slot.select("doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("slot") - 1).alias("slot"))


def moved(plan: DataFrame) -> DataFrame:
    """Documents and bytes that each old shard sends to each new one, those that stay left out."""
    return plan.where("old_shard <> shard").groupBy("old_shard", "shard").agg(F.count("*").alias("docs"), F.sum("size").alias("bytes"))


def rewrite_affected(docs: DataFrame, plan: DataFrame, path: str) -> DataFrame:
    """Write docs (with unique doc_id) by new shard, as shard=N folders under path, but only shards whose documents change; gives those shards.

    Folders of other shards stay; those of shards that are left empty are deleted. docs may be read from path: they are settled first.
    """
    changed = plan.where("old_shard <> shard")
    affected = settle(changed.select(F.explode(F.array(F.col("old_shard").cast("int"), F.col("shard").cast("int"))).alias("shard")).distinct())
    into = plan.select(F.col("doc_id").alias("__id"), F.col("shard"), F.col("slot")).join(affected, "shard", "left_semi")
    out = settle(docs.drop("shard", "slot").join(into, F.col("doc_id").eqNullSafe(F.col("__id"))).drop("__id"))
    empty = [r["shard"] for r in affected.join(out.select("shard").distinct(), "shard", "left_anti").collect()]  # at most one row a shard
    dealt = out.repartition("shard", F.pmod(F.xxhash64("slot"), F.lit(8))).sortWithinPartitions("shard", "slot")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    spark = docs.sparkSession
    for n in empty:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/shard={n}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return affected


def op8_min_cost_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reshard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


QUERIES = {"op8_min_cost_reshard": op8_min_cost_reshard}
