"""Best-fit packing of token pieces by a grouping genetic algorithm on islands.

A solution is a set of bins. A population begins with best-fit packings: of the pieces in
falling order and in random ones. Crossover injects whole well-filled bins of one parent into
the other, drops the other's bins that hold the same pieces twice and best-fits the pieces
so displaced: each open bin takes the piece, or the two, that fill it most. Every block's
first generation has FIRST crossovers at least; then it goes on while the best packing is
above the bound (all lengths over SIZE), the longer the further it is. The pieces are dealt
by hash into blocks of about BLOCK; each block evolves on several islands (rows of a table, so
tasks of their own), whose elite moves to the next island between epochs. Bins that stay badly
filled are taken apart and their pieces, from all blocks, are dealt and packed again.

Only lengths and numbers of pieces are moved; a task holds one block. Every text is cut
into pieces of at most SIZE ids, so a long text is a number of full sequences and a rest.

Edge cases: a null or empty text is one piece of the end id alone; null doc_ids and
repeated rows are packed each; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.llm.common import documents, map_slices, settle, table
from lumenweave.llm.tokens import KEPT, id_bytes

SIZE = 4096
BLOCK = 4096
ISLANDS = 3
EPOCHS = 2
POPULATION = 5
#: Crossovers of an island and epoch for each bin above the bound (as far as GAP bins), and of the seeds' generation at least.
CHILDREN, GAP, FIRST = 8, 24, 2
#: Bins below this fill are taken apart after a round; so many rounds.
FULL = 0.97
ROUNDS = 3


def tokenizer_file() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def _cut(path: str, size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for doc, data in zip(rows["doc_id"].array, id_bytes([t or "" for t in rows["text"]], path), strict=True):
                for k in range(0, len(data), 4 * size):
                    part = data[k : k + 4 * size]
                    out.append((doc, k // (4 * size), k // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return run


def pieces(docs: DataFrame, path: str | None = None, size: int = SIZE) -> DataFrame:
    """Per piece: uid, doc_id, piece, start, length, ids_crc32."""
    cut = map_slices(documents(docs), _cut(path or tokenizer_file(), size), "doc_id long, piece int, start long, length long, ids_crc32 long", KEPT)
    return settle(cut.withColumn("uid", F.monotonically_increasing_id()))


class Bins:
    """Bins of item numbers with their fills."""

    def __init__(self, lengths, size: int, bins=()):
        self.lengths, self.size = lengths, size
        self.bins = [list(b) for b in bins]
        self.fills = [sum(lengths[i] for i in b) for b in self.bins]

    def best_fit(self, items) -> Bins:
        """Each item, in the given order, goes into the fullest bin that has room."""
        free = sorted((self.size - f, k) for k, f in enumerate(self.fills))
        for i in items:
            n = self.lengths[i]
            at = bisect_left(free, (n, -1))
            if at == len(free):
                self.bins.append([i])
                self.fills.append(n)
                insort(free, (self.size - n, len(self.bins) - 1))
            else:
                room, k = free.pop(at)
                self.bins[k].append(i)
                self.fills[k] += n
                insort(free, (room - n, k))
        return self

    def best_company(self, items) -> Bins:
        """Open bins, then new ones begun with the longest item left, take the item or the two items that fill them most, until none fits."""
        pool = sorted((self.lengths[i], i) for i in items)
        for k in sorted(range(len(self.bins)), key=lambda k: self.fills[k], reverse=True):
            self._take(k, pool)
        while pool:
            n, i = pool.pop()
            self.bins.append([i])
            self.fills.append(n)
            self._take(len(self.bins) - 1, pool)
        return self

    def _take(self, k: int, pool: list) -> None:
        """Moves items from the pool (sorted by length) into bin k."""
        while pool and pool[0][0] <= (room := self.size - self.fills[k]):
            high = bisect_left(pool, (room + 1, -1)) - 1
            best, picked = pool[high][0], (high,)
            low = 0
            while low < high and best < room:
                both = pool[low][0] + pool[high][0]
                if both > room:
                    high -= 1
                    continue
                if both > best:
                    best, picked = both, (low, high)
                low += 1
            for at in sorted(picked, reverse=True):
                self.bins[k].append(pool.pop(at)[1])
            self.fills[k] += best

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then fuller ones (sum of squared fills)."""
        return -len(self.bins), float(sum((f / self.size) ** 2 for f in self.fills))

    def places(self) -> list[int]:
        out = [0] * len(self.lengths)
        for k, b in enumerate(self.bins):
            for i in b:
                out[i] = k
        return out

    @classmethod
    def of(cls, lengths, size, places) -> Bins:
        bins = [[] for _ in range(max(places, default=-1) + 1)]
        for i, k in enumerate(places):
            bins[k].append(i)
        return cls(lengths, size, bins)


def crossover(one: Bins, other: Bins, rng) -> Bins:
    """one with whole well-filled bins of other; what they displace is best-fitted."""
    by_fill = sorted(range(len(other.bins)), key=lambda k: -other.fills[k])
    half = max(1, len(by_fill) // 2)
    a, b = sorted(rng.integers(0, half + 1, 2))
    given = [other.bins[k] for k in by_fill[a : b + 1]]
    taken = {i for g in given for i in g}
    kept, displaced = [], []
    for items in one.bins:
        if taken.isdisjoint(items):
            kept.append(items)
        else:
            displaced.extend(i for i in items if i not in taken)
    return _refill(one, kept + given, displaced, rng)


def _refill(like: Bins, bins, displaced, rng) -> Bins:
    """The emptiest bins and a few others are taken apart too, so that what is displaced finds new company."""
    out = Bins(like.lengths, like.size, bins)
    order = sorted(range(len(out.bins)), key=lambda k: out.fills[k])
    loose = set(order[: max(1, len(order) // 50)]) | set(rng.integers(0, max(1, len(order)), 3).tolist()) if order else set()
    displaced = displaced + [i for k in loose if k < len(out.bins) for i in out.bins[k]]
    stay = [b for k, b in enumerate(out.bins) if k not in loose]
    return Bins(like.lengths, like.size, stay).best_company(displaced)


def evolve(lengths, size: int, elites, rng, population: int = POPULATION, children: int = CHILDREN) -> Bins:
    """The best of a population that begins with elites (or a best-fit packing in falling order) and best-fit packings of random orders.

    Elites at the bound have had their crossovers, in the epoch that they come from.
    """
    n, least = len(lengths), -(-sum(lengths) // size)
    falling = sorted(range(n), key=lambda i: -lengths[i])
    people = [Bins.of(lengths, size, e) for e in elites] or [Bins(lengths, size).best_fit(falling)]
    best = max(people, key=Bins.fitness)
    if elites and len(best.bins) <= least:
        return best
    while len(people) < population:
        people.append(Bins(lengths, size).best_fit(rng.permutation(n).tolist()))
    people.sort(key=Bins.fitness, reverse=True)
    for born in range(max(FIRST, children * min(GAP, len(best.bins) - least))):
        if born >= FIRST and len(people[0].bins) <= least:
            break
        # fitter parents more often: the less of two draws
        a, b = (int(min(rng.integers(0, len(people), 2))) for _ in range(2))
        one, other = people[a], people[b if b != a else (a + 1) % len(people)]
        child = crossover(one, other, rng)
        if child.fitness() not in [x.fitness() for x in people]:  # no clones
            people.append(child)
            people.sort(key=Bins.fitness, reverse=True)
            del people[population:]
    return people[0]


def _epoch(size: int, epoch: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for block, island, lens, own, guest in zip(rows["block"], rows["island"], rows["lens"], rows["own"], rows["guest"], strict=True):
                lens = [int(x) for x in lens]
                elites = [[int(x) for x in e] for e in (own, guest) if e is not None]
                best = evolve(lens, size, elites, np.random.default_rng([int(block), int(island), epoch]))
                n, squares = best.fitness()
                out.append((block, island, best.places(), -n, squares))
            yield pd.DataFrame(out, columns=["block", "island", "plan", "n_bins", "squares"])

    return run


def _place(size: int, full: float, last: bool, first_id: int):
    """Of each block's plan: sequence and offset per piece; pieces of badly filled bins get none, but in the last round."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for block, uids, lens, plan in zip(rows["block"], rows["uids"], rows["lens"], rows["plan"], strict=True):
                fills: dict[int, int] = {}
                at = []
                for n, k in zip(lens, plan, strict=True):
                    at.append(fills.get(k, 0))
                    fills[k] = fills.get(k, 0) + int(n)
                for uid, n, k, offset in zip(uids, lens, plan, at, strict=True):
                    good = last or fills[k] >= full * size
                    out.append((uid, int(n), first_id + (int(block) << 20) + int(k) if good else None, offset))
            yield pd.DataFrame(out, columns=["uid", "length", "sequence_id", "offset"]).astype({"sequence_id": "Int64"})

    return run


def _round(rest: DataFrame, number: int, last: bool, n: int, size: int, block: int) -> DataFrame:
    """rest: uid, length. One round of evolution in blocks; gives uid, length, sequence_id (null: to be packed again), offset."""
    blocks = -(-n // block)
    dealt = rest.withColumn("block", F.pmod(F.xxhash64("uid", F.lit(number)), F.lit(blocks)))
    held = dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct((-F.col("length")).alias("n"), "uid"))).alias("all"))
    held = settle(held.select("block", F.expr("transform(all, x -> x.uid)").alias("uids"), F.expr("transform(all, x -> -x.n)").alias("lens")))
    schema = "block long, island int, plan array<int>, n_bins int, squares double"
    islands = held.select("block", "lens", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"))
    none = F.lit(None).cast("array<int>")
    state = None
    for epoch in range(EPOCHS):
        if state is None:
            now = islands.withColumns({"own": none, "guest": none})
        else:
            own = state.select("block", "island", F.col("plan").alias("own"))
            guest = state.select("block", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("plan").alias("guest"))
            now = islands.join(own, ["block", "island"]).join(guest, ["block", "island"])
        now = now.select("block", "island", "lens", "own", "guest").repartition(F.col("block"), F.col("island"))
        state = settle(now.mapInPandas(_epoch(size, epoch), schema))
    best = state.groupBy("block").agg(F.min(F.struct("n_bins", (-F.col("squares")).alias("s"), "island", "plan")).alias("best")).select("block", F.col("best.plan").alias("plan"))
    first_id = number << 58
    return settle(held.join(best, "block").mapInPandas(_place(size, FULL, last, first_id), "uid long, length long, sequence_id long, offset long"))


def pack(cut: DataFrame, size: int = SIZE, block: int = BLOCK) -> DataFrame:
    """cut: uid, length. Per uid: sequence_id, offset; as few sequences of at most size as the search finds."""
    alone = cut.where(F.col("length") == size).select("uid", (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = cut.where(F.col("length") < size).select("uid", "length")
    done = alone
    for number in range(ROUNDS):
        n = rest.count()
        if not n:
            break
        last = number == ROUNDS - 1 or n <= block
        placed = _round(rest, number, last, n, size, block)
        done = done.unionByName(placed.where("sequence_id IS NOT NULL").select("uid", "sequence_id", "offset"))
        if last:
            break
        rest = placed.where("sequence_id IS NULL").select("uid", "length")
    return done


def pack_documents(docs: DataFrame, path: str | None = None, size: int = SIZE, block: int = BLOCK) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = pieces(docs, path, size)
    return cut.join(pack(cut, size, block), "uid").drop("uid")


def sequences(docs: DataFrame, plan: DataFrame, path: str | None = None, size: int = SIZE) -> DataFrame:
    """The packed ids: sequence_id, ids (array of int). docs have unique doc_ids; a sequence holds at most size ids."""
    where = path or tokenizer_file()

    def ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for doc, data in zip(rows["doc_id"], id_bytes([t or "" for t in rows["text"]], where), strict=True):
                every = np.frombuffer(data, "<u4").astype("int32")
                out.extend((doc, k // size, every[k : k + size]) for k in range(0, len(every), size))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "ids"])

    held = documents(docs).mapInPandas(ids, "doc_id long, piece int, ids array<int>").join(plan.select("doc_id", "piece", "sequence_id", "offset"), ["doc_id", "piece"])
    together = held.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("all"))
    return together.select("sequence_id", F.expr("flatten(transform(all, x -> x.ids))").alias("ids"))


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline, last: the pieces of all documents and their places."""
    return pack_documents(docs)


QUERIES = {"op1_pack": op1_pack}
