"""MinHash near-duplicates by an LSH forest.

Each distinct set of 5-word shingles gets 128 MinHash values, read in 32 orders (the
forest's trees), each beginning four values further. Sets with the same first four values
of an order are neighbours there; where such a region is crowded, its depth adapts: its
members are split by longer and longer common prefixes until few are left, and only then
are all of them candidates of each other. Members of a crowded region are also candidates
of its centre, the set that stands in the most and largest regions of all trees: in a
large group of copies of one text that is the text itself, so the group is found through
links with its centre and not through all its pairs. What a crowded region's centre and its
deeper regions leave apart is searched exactly (see unjoined): sets of regions that still hold
several components meet on the rarest shingles of their prefixes, which no pair of
similarity 0.75 can miss.

Candidates are confirmed on full sets, built again from whole texts: first one pair per
set (with its most central partner), then all pairs but those of two sets that are linked
with one partner, or with each other, already; such a pair cannot change a component. Two sets of similarity 0.75 share a region
with probability 1 - (1 - 0.75**4)**32, about 0.999995.

Edge cases: null, empty and blank texts have no shingles and are linked with nothing; a
null doc_id is never a component_id unless no member has another (then it is null and
kept is false); repeated rows are in one component and share kept; an empty table gives an
empty result; other columns are not read (the pipeline's stage hands them on, whatever their
names).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.llm.common import documents, hidden, map_slices, settle, table
from lumenweave.llm.components import roots
from lumenweave.llm.shingles import MinHash, set_name, shingle_sets

TREES = 32
DEPTHS = (4, 8, 16, 32)
CROWD = 24
SALTS = 256
BLOCK = 256
#: Counters of the order of shingles by rarity (its precision changes the work, not the result), and sets of a shingle's list that meet in one task.
RARITY, LIST = 1 << 20, 1024
RANGES = 64
#: Similarity as a fraction: 75 of 100.
LEAST = (75, 100)


def _sign(values: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        least = MinHash(values)
        for rows in batches:
            out = []
            for s in shingle_sets(list(rows["text"])):
                out.append((len(s), set_name(s), least(s).tobytes() if len(s) else None))
            made = pd.DataFrame(out, columns=["n_shingles", "set_name", "sig"])
            made.insert(0, "text_mark", rows["text_mark"].array)
            made.insert(0, "doc_id", rows["doc_id"].array)
            yield made

    return run


def _text_mark():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def sign(docs: DataFrame) -> DataFrame:
    """Per row uid, doc_id, text_mark, n_shingles, set_name and sig (32-bit MinHash values); the last two are null for empty sets."""
    marked = documents(docs).withColumn("text_mark", _text_mark())
    signed = map_slices(marked, _sign(TREES * DEPTHS[0]), "doc_id long, text_mark long, n_shingles long, set_name string, sig binary")
    return settle(signed.withColumn("uid", F.monotonically_increasing_id()))


def _region(tree, depth: int):
    """The region of a tree at a depth: a hash of the order's first values. The order of tree t begins at value 4 * t."""
    n = TREES * DEPTHS[0] * 4
    at = tree * F.lit(DEPTHS[0] * 4)
    head = F.substring(F.concat("sig", "sig"), at + 1, F.lit(depth * 4)) if depth * 4 < n else F.col("sig")
    return F.xxhash64(tree, F.lit(depth), head)


def _blocks(rows: DataFrame) -> DataFrame:
    """rows: cid, tree, key. The members of regions of two and more, in blocks: key, salt, tree, cids, and the region's size n."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("cid"), F.lit(SALTS)).cast("int"))
    blocks = salted.groupBy("key", "salt").agg(F.first("tree").alias("tree"), F.collect_list("cid").alias("cids"))
    sizes = blocks.groupBy("key").agg(F.sum(F.size("cids")).alias("n")).where("n > 1")
    return settle(blocks.join(sizes, "key"))


def candidates(sets: DataFrame, crowd: int = CROWD) -> tuple[DataFrame, DataFrame | None]:
    """sets: cid, sig. Pairs a, b, weight of sets that are neighbours in a tree, once each; a is the more central, by weight. And per
    member of the first depth's crowded regions, of which not all pairs are given: cid and at, its regions.

    The members of a crowded region are kept in blocks, so that joins meet blocks and not members.
    """
    rows = sets.select("cid", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    found, crowded = [], None
    for depth, deeper in zip(DEPTHS, (*DEPTHS[1:], None), strict=True):
        level = _blocks(rows.select("cid", "tree", _region(F.col("tree"), depth).alias("key")))
        few = level.where(F.col("n") <= crowd).groupBy("key").agg(F.sort_array(F.flatten(F.collect_list("cids"))).alias("all"))
        few = few.select(F.explode(F.expr("flatten(transform(all, (x, i) -> transform(slice(all, i + 2, size(all)), y -> struct(x AS a, y AS b))))")).alias("p"))
        found.append(few.select("p.a", "p.b", F.lit(0).cast("long").alias("weight")))
        many = level.where(F.col("n") > crowd)
        if not many.limit(1).count():
            break
        members = many.repartition("key", "salt").select("key", "tree", "n", F.explode("cids").alias("cid"))
        places = settle(members.groupBy("cid").agg(F.sum("n").alias("weight"), F.collect_list(F.struct("key", "tree")).alias("at")))  # at most TREES each
        crowded = places if crowded is None else crowded
        top = F.max(F.struct("weight", (-F.col("cid")).alias("c"))).alias("top")
        centre = places.select("cid", "weight", F.explode("at").alias("p")).groupBy("p.key").agg(top).select("key", (-F.col("top.c")).alias("a"), "top.weight")
        star = many.join(centre, "key").repartition("key", "salt").select("a", F.explode("cids").alias("b"), "weight")
        found.append(star.where("a <> b").groupBy("a", "b").agg(F.max("weight").alias("weight")))
        if deeper:
            rows = places.select("cid", "at").join(sets, "cid").select("cid", "sig", F.explode(F.col("at.tree")).alias("tree"))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    once = pairs.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.max(F.struct("weight", (-F.col("a")).alias("a"))).alias("top"))
    hub = -F.col("top.a")
    return settle(once.select(hub.alias("a"), F.when(hub == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("b"), "top.weight")), crowded


def _confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come by key, the hub's text first; each other text of the key is compared with it."""
    key, hub, hub_set = None, None, None
    for rows in batches:
        out = []
        sets = shingle_sets(list(rows["text"]))
        for now, uid, is_hub, s in zip(rows["key"], rows["uid"], rows["is_hub"], sets, strict=True):
            if is_hub:
                key, hub, hub_set = now, uid, s
            elif now == key and len(s):
                both = len(np.intersect1d(hub_set, s, assume_unique=True))
                if both * LEAST[1] >= (len(hub_set) + len(s) - both) * LEAST[0]:
                    out.append((hub, uid))
        yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def confirm(docs: DataFrame, where: DataFrame, pairs: DataFrame, block: int = BLOCK) -> DataFrame:
    """pairs: a, b. Those whose full sets are similar enough. where: uid, doc_id, text_mark of every set's text.

    A hub's partners are dealt out in blocks; the hub's text goes to each of its blocks once.
    """
    sizes = pairs.groupBy("a").agg(F.count("*").alias("n"))
    salt = F.pmod(F.xxhash64("b"), F.expr(f"(n - 1) div {block} + 1"))
    keyed = settle(pairs.select("a", "b").join(sizes, "a").select("a", "b", F.concat_ws("/", "a", salt).alias("key")))
    need = keyed.select("key", F.col("b").alias("uid"), F.lit(False).alias("is_hub")).unionByName(keyed.select("key", F.col("a").alias("uid"), F.lit(True).alias("is_hub")).distinct())
    place = need.join(where, "uid").select("key", "uid", "is_hub", F.col("doc_id").alias("__id"), F.col("text_mark").alias("__mark"))
    text = documents(docs)
    rows = text.join(place, F.col("doc_id").eqNullSafe(F.col("__id")) & (_text_mark() == F.col("__mark"))).select("key", "uid", "is_hub", "text")
    dealt = rows.repartition("key").sortWithinPartitions("key", F.desc("is_hub"))
    return map_slices(dealt, _confirm, "a long, b long")


def _counter(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - (RARITY.bit_length() - 1))).astype(np.int64)


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    n = np.zeros(RARITY, np.int64)
    for rows in batches:
        for s in shingle_sets(list(rows["text"])):
            np.add.at(n, _counter(s), 1)
    yield pd.DataFrame([(p, part.tobytes()) for p, part in enumerate(np.split(n, RANGES)) if part.any()], columns=["part", "n"])


def _add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come by part; one part's sum is held at a time."""
    part, total = None, None
    for rows in batches:
        for p, n in zip(rows["part"], rows["n"], strict=True):
            if p != part:
                if part is not None:
                    yield pd.DataFrame([(part, total.tobytes())], columns=["part", "n"])
                part, total = p, np.zeros(RARITY // RANGES, np.int64)
            total += np.frombuffer(n, np.int64)
    if part is not None:
        yield pd.DataFrame([(part, total.tobytes())], columns=["part", "n"])


def _prefixes(rarity):
    """The shingles by which a similar set must be met: with the rarest first, the first n - 0.75 n + 1."""
    columns = ["token", "uid", "comp", "pos", "n"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often = rarity.value
        for rows in batches:
            out, held = [], 0
            for uid, comp, s in zip(rows["uid"], rows["comp"], shingle_sets(list(rows["text"])), strict=True):
                first = s[np.lexsort((s, often[_counter(s)]))[: len(s) * (LEAST[1] - LEAST[0]) // LEAST[1] + 1]]
                out.append((first.view(np.int64), np.full(len(first), uid), np.full(len(first), comp), np.arange(len(first)), np.full(len(first), len(s))))
                held += len(first)
                if held > 1 << 18:
                    yield pd.DataFrame(dict(zip(columns, map(np.concatenate, zip(*out, strict=True)), strict=True)))
                    out, held = [], 0
            if out:
                yield pd.DataFrame(dict(zip(columns, map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return run


def unjoined(docs: DataFrame, where: DataFrame, crowded: DataFrame, found: DataFrame) -> DataFrame | None:
    """Pairs a, b that may be similar, of sets that share a crowded region and are not joined by found; none if every such region is one component.

    Prefix filtering: of two sets of similarity p/q, the first shingle in common, in one order of all shingles,
    stands among the first n (q - p) / q of the larger and the first n (q - p) / (q + p) of the smaller, and behind
    it are at least p / (p + q) of both sizes in each. So every similar pair is met at that shingle. The order is by
    rarity, so what a form's texts share stands behind what is their own.
    """
    p, q = LEAST
    comp = roots(found).select(F.col("node").alias("cid"), "root")
    at = crowded.select("cid", F.explode("at.key").alias("key")).join(comp, "cid", "left").select("cid", "key", F.coalesce("root", "cid").alias("comp"))
    mixed = at.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    sets = settle(at.join(mixed, "key", "left_semi").select(F.col("cid").alias("uid"), "comp").distinct())
    if not sets.limit(1).count():
        return None
    place = settle(where.join(sets, "uid").select("uid", "comp", F.col("doc_id").alias("__id"), F.col("text_mark").alias("__mark")))
    texts = documents(docs).join(place, F.col("doc_id").eqNullSafe(F.col("__id")) & (_text_mark() == F.col("__mark"))).dropDuplicates(["uid"])
    texts = settle(texts.select("uid", "comp", "text"))
    often = np.zeros(RARITY, np.int64)
    sums = map_slices(texts.select("text"), _frequencies, "part int, n binary").repartition("part").sortWithinPartitions("part").mapInPandas(_add, "part int, n binary")
    for row in settle(sums).toLocalIterator():  # RANGES rows, of one size in all
        often[row["part"] * (RARITY // RANGES) : (row["part"] + 1) * (RARITY // RANGES)] = np.frombuffer(row["n"], np.int64)
    sent = docs.sparkSession.sparkContext.broadcast(often)
    rows = settle(map_slices(texts, _prefixes(sent), "token long, uid long, comp long, pos int, n int"))
    short = F.col("pos") * (p + q) <= F.col("n") * (q - p)
    lists = rows.groupBy("token").agg(F.count_if(short).alias("short"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    lists = settle(lists.where("short > 0 AND lo < hi").select("token", F.expr(f"cast((short - 1) div {LIST} + 1 AS int)").alias("salts")))
    known = rows.join(lists, "token")
    x = known.where(short).select("token", F.pmod(F.xxhash64("uid"), "salts").cast("int").alias("salt"), *(F.col(c).alias(f"{c}_x") for c in ("uid", "comp", "pos", "n")))
    y = known.select("token", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), *(F.col(c).alias(f"{c}_y") for c in ("uid", "comp", "pos", "n")))
    may = (F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("uid_x") < F.col("uid_y")))
    may &= (F.col("comp_x") != F.col("comp_y")) & (F.col("n_x") * q >= F.col("n_y") * p)
    may &= F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y")) * (p + q) >= (F.col("n_x") + F.col("n_y")) * p
    return settle(x.join(y, ["token", "salt"]).where(may).select(F.col("uid_y").alias("a"), F.col("uid_x").alias("b")).distinct())


def links(docs: DataFrame, signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gives set_name, cid of every distinct set and a, b: confirmed links between sets that join their components."""
    held = signed.where(F.col("set_name").isNotNull())
    first = held.groupBy("set_name").agg(F.min("uid").alias("cid"))
    heads = settle(held.select("uid", "doc_id", "text_mark", "sig", "set_name").join(first.select(F.col("cid").alias("uid")), "uid", "left_semi"))
    sets = heads.select("set_name", F.col("uid").alias("cid"))
    where = heads.select("uid", "doc_id", "text_mark")
    pairs, crowded = candidates(heads.select(F.col("uid").alias("cid"), "sig"))
    best = settle(pairs.groupBy("b").agg(F.max(F.struct("weight", (-F.col("a")).alias("a"))).alias("top")).select((-F.col("top.a")).alias("a"), "b"))
    found = settle(confirm(docs, where, best))
    # a set stands for itself or for the partner that it is linked with; a pair of one standing is joined already
    stands = found.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("hub"))
    ha, hb = (stands.select(F.col("node").alias(c), F.col("hub").alias(f"h{c}")) for c in "ab")
    rest = pairs.join(best, ["a", "b"], "left_anti").join(ha, "a", "left").join(hb, "b", "left")
    rest = settle(rest.where(F.coalesce("ha", "a") != F.coalesce("hb", "b")).select("a", "b"))
    if rest.limit(1).count():
        found = found.unionByName(settle(confirm(docs, where, rest)))
    more = unjoined(docs, where, crowded, found) if crowded is not None else None
    if more is not None and more.limit(1).count():
        found = found.unionByName(settle(confirm(docs, where, more)))
    return sets, found


def components(docs: DataFrame) -> DataFrame:
    """Per row uid, doc_id, text_mark, n_shingles and root: the number of its component (null without shingles)."""
    signed = sign(docs)
    sets, found = links(docs, signed)
    top = roots(found).withColumnRenamed("node", "cid")
    sets = sets.join(top, "cid", "left").select("set_name", F.coalesce("root", "cid").alias("root"))
    return settle(signed.drop("sig").join(sets, "set_name", "left").select("uid", "doc_id", "text_mark", "n_shingles", "root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    rows = components(docs)
    least = rows.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    out = rows.join(least, "root", "left").withColumn("component_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: of each component one row stays, the one of the smallest doc_id; rows without shingles stay."""
    rows = components(docs)
    stay = rows.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("best"))
    gone = rows.join(stay, "root").where(F.col("uid") != F.col("best.uid")).groupBy("doc_id", "text_mark").agg(F.count("*").alias("__gone"))
    total = rows.groupBy("doc_id", "text_mark").agg(F.count("*").alias("__rows"))
    same = gone.doc_id.eqNullSafe(total.doc_id) & (gone.text_mark == total.text_mark)
    gone = gone.join(total, same).select(gone.doc_id.alias("gone_id"), gone.text_mark.alias("gone_mark"), F.col("__gone").alias("n_gone"), F.col("__rows").alias("n_rows"))
    held, own = hidden(docs, "doc_id", "text")
    out = held.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("gone_id")) & (_text_mark() == F.col("gone_mark")), "left")
    whole = out.where("n_gone IS NULL").select(*own)
    # one of several rows with the same id and text stays
    if not gone.where("n_gone < n_rows AND n_rows > 1").limit(1).count():
        return whole
    return whole.unionByName(out.where("n_gone < n_rows").dropDuplicates(["gone_id", "gone_mark"]).select(*own))


QUERIES = {"op6_minhash_dedup": op6_minhash_dedup}
