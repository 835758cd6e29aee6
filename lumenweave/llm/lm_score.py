"""Language-model scoring by cross-entropy difference.

Two bigram models over the ids of one public tokenizer, so one vocabulary: the target model
counts the documents that labels marks as good, the background model counts all documents.
Both have one order, one smoothing and one table layout. A document's score is its mean
loss a token under the target model less that under the background model (lower: more like
the target).

Every token of the corpus is counted, ids and pairs exactly: tasks add up what they read and
the sums are made by a grouped sum. The most frequent pairs, at most SLOTS, are sent to all
tasks; a document's other pairs meet their counts in a join, so nothing is shared by two pairs
whatever the input's size.

A document is scored without itself (leave_out): its own counts are taken from the background
model's and, if it is a target document, from the target model's, so that a document of which
there is no other does not look likely for having been counted, and target documents are not
favoured over equally good ones outside the target. Copies of it are other documents and stay
counted: each adds one to every pair of the text, which lowers its background loss by what
that one is against the counts of the pairs' contexts. Copies are not this operator's to find.

Edge cases: a null or empty text has no tokens and null losses and score; a null doc_id is
scored; repeated rows are each counted and scored; repeated labels count as their maximum;
without a target document the target model is uniform; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.llm.common import documents, settle, table
from lumenweave.llm.tokens import id_bytes

IDS = 49_408
#: Pairs at most that are sent to all tasks.
SLOTS = 1 << 20
PAIR_WEIGHT = 0.7
#: Tokens of one step in numpy.
STEP = 1 << 18


def tokenizer_file() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def _ids(texts: list[str], path: str) -> list[np.ndarray]:
    return [np.frombuffer(b, "<u4")[:-1] for b in id_bytes(texts, path)]


def _together(ids: list[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Documents first to last, their ids joined, and each id's predecessor (IDS at a document's start); documents without ids are in no group of their own."""
    a = 0
    while a < len(ids):
        b, n = a, 0
        while b < len(ids) and (b == a or n + len(ids[b]) <= STEP):
            n += len(ids[b])
            b += 1
        now = np.concatenate(ids[a:b]).astype(np.int64)
        before = np.empty_like(now)
        before[1:] = now[:-1]
        starts = np.cumsum([0] + [len(x) for x in ids[a:b]])[:-1]
        before[starts[[len(x) > 0 for x in ids[a:b]]]] = IDS
        yield a, b, now, before
        a = b


def _loss(share: np.ndarray, alone: np.ndarray) -> np.ndarray:
    return -np.log(PAIR_WEIGHT * share + (1 - PAIR_WEIGHT) * alone)


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """parts: (keys, counts of two models). Each key once."""
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    both = np.concatenate([n for _, n in parts], axis=1)
    return keys, np.stack([np.bincount(at, n, minlength=len(keys)) for n in both]).astype(np.int64)


def _count(path: str):
    """Counts of pairs, by before * (IDS + 1) + now, and of ids, by -1 - id; sums are kept until there are STEP of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        single, parts, held = np.zeros((2, IDS + 1), np.int64), [], 0

        def made(keys, n):
            return pd.DataFrame({"pair": keys, "target": n[0], "background": n[1]})

        for rows in batches:
            for is_target, part in rows.groupby("target"):
                for _, _, now, before in _together(_ids([t or "" for t in part["text"]], path)):
                    c = np.bincount(now, minlength=IDS + 1)
                    c[IDS] += int((before == IDS).sum())
                    keys, n = np.unique(before * (IDS + 1) + now, return_counts=True)
                    single[1] += c
                    single[0] += c * bool(is_target)
                    parts.append((keys, np.stack([n * bool(is_target), n])))
                    held += len(keys)
                    if held > 4 * STEP:
                        parts = [_merged(parts)]
                        held = len(parts[0][0])
                        if held > 2 * STEP:
                            yield made(*parts[0])
                            parts, held = [], 0
        if parts:
            yield made(*_merged(parts))
        yield made(-1 - np.arange(IDS + 1), single)

    return run


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        yield pd.DataFrame([tuple(rows[c].to_numpy(np.int64).tobytes() for c in ("pair", "target", "background"))], columns=["pair", "target", "background"])


def _held(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    sent = counts.select("pair", "target", "background").mapInPandas(_packed, "pair binary, target binary, background binary")
    got = [np.frombuffer(b"".join(c), np.int64) for c in zip(*sent.toLocalIterator(), strict=True)] or [np.zeros(0, np.int64)] * 3
    order = np.argsort(got[0])
    return got[0][order], np.stack(got[1:])[:, order]


class Model:
    """Counts of ids and of the most frequent pairs under target (0) and background (1); rest: the table of all other pairs' counts, if there are any."""

    def __init__(self, single: np.ndarray, keys: np.ndarray, pairs: np.ndarray, rest: DataFrame | None):
        self.single, self.total = single, single[:, :IDS].sum(1)
        self.keys, self.pairs, self.rest = keys, pairs, rest

    def sent(self) -> Model:
        """Without the table, to be sent to tasks."""
        m = copy.copy(self)
        m.rest = None
        return m

    def found(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The counts of pairs under both models, and whether they are held (if not, the counts are 0)."""
        if not len(self.keys):
            return np.zeros((2, len(pair)), np.int64), np.zeros(len(pair), bool)
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        hit = self.keys[at] == pair
        return np.where(hit, self.pairs[:, at], 0), hit


def _own(doc: np.ndarray, key: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct keys as doc * width + key, and their counts."""
    return np.unique(doc * width + key, return_counts=True)


def _terms(m: Model, doc: np.ndarray, now: np.ndarray, before: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each distinct pair of each document: document, pair, its tokens there, what of both models' counts is the document's own
    (member: 1 where a model counted the document, per document), contexts and smoothed shares of the id without the document."""
    wide = IDS + 1
    both, n = _own(doc, before * wide + now, wide * wide)
    d, pair = both // (wide * wide), both % (wide * wide)
    b, w = pair // wide, pair % wide
    ids, of_id = _own(doc, now, wide)
    size = np.bincount(doc, minlength=len(member[0]))
    own_b = np.where(b == IDS, 1, of_id[np.minimum(np.searchsorted(ids, d * wide + b), len(ids) - 1)])
    own_w = of_id[np.searchsorted(ids, d * wide + w)]
    mine = member[:, d]
    context = np.maximum(m.single[:, b] - mine * own_b, 1)
    alone = (m.single[:, w] - mine * own_w + 0.5) / ((m.total[:, None] - mine * size[d]) + 0.5 * IDS)
    return d, pair, n, mine * n, context, alone


def mark(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text and whether a row is a target document; a table, as it is read twice."""
    good = labels.select(F.col("doc_id").alias("__id"), F.col("quality").alias("__q")).groupBy("__id").agg((F.max("__q") >= 1).alias("target"))
    # labels grow with the documents: neither side is broadcast
    held = documents(docs).join(good.hint("merge"), F.col("doc_id") == F.col("__id"), "left")
    return settle(held.select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target")))


def count(docs: DataFrame, labels: DataFrame, path: str | None = None, slots: int = SLOTS) -> Model:
    """At most slots pairs, the most frequent, are held in the model; all others stay in a table."""
    return count_marked(mark(docs, labels), path, slots)


def count_marked(marked: DataFrame, path: str | None = None, slots: int = SLOTS) -> Model:
    sent = marked.select("text", "target").mapInPandas(_count(path or tokenizer_file()), "pair long, target long, background long")
    counts = settle(sent.groupBy("pair").agg(F.sum("target").alias("target"), F.sum("background").alias("background")))
    single = np.zeros((2, IDS + 1), np.int64)
    keys, n = _held(counts.where("pair < 0"))  # IDS + 1 rows
    single[:, -1 - keys] = n
    pairs = counts.where("pair >= 0").withColumn("often", F.floor(F.log2("background") * 8).cast("int"))
    least, room = None, slots
    for row in pairs.groupBy("often").agg(F.count("*").alias("n")).orderBy(F.desc("often")).collect():  # some hundred rows
        if row["n"] > room:
            break
        least, room = row["often"], room - row["n"]
    else:
        return Model(single, *_held(pairs), None)
    held = pairs.where(F.lit(False) if least is None else F.col("often") >= least)
    return Model(single, *_held(held), pairs if least is None else pairs.where(F.col("often") < least))


COLD = "array<struct<pair:long,n:int,own:int,target_context:long,background_context:long,target_alone:double,background_alone:double>>"


def _score(model, path: str, whole: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for rows in batches:
            ids = _ids([t or "" for t in rows["text"]], path)
            leave = rows["leave"].to_numpy(np.int64)  # 0: nothing; 1: the background; 3: both models counted the row
            sums = np.zeros((2, len(ids)))
            cold: list = [[] for _ in ids]
            for a, b, now, before in _together(ids):
                if not len(now):
                    continue
                doc = np.repeat(np.arange(b - a), [len(x) for x in ids[a:b]])
                d, pair, n, own, context, alone = _terms(m, doc, now, before, np.stack([leave[a:b] >> 1, leave[a:b] & 1]))
                seen, hit = m.found(pair)
                loss = _loss(np.maximum(seen - own, 0) * hit / context, alone)
                for k in (0, 1):
                    sums[k, a:b] = np.bincount(d, n * loss[k], minlength=b - a)
                if not whole:
                    for i in np.flatnonzero(~hit).tolist():
                        cold[a + d[i]].append((pair[i], n[i], own[1, i] + 2 * own[0, i], *context[:, i], *alone[:, i]))
            made = pd.DataFrame({"n_tokens": [len(x) for x in ids], "target_sum": sums[0], "background_sum": sums[1]})
            if not whole:
                made["cold"] = cold
            made.insert(0, "doc_id", rows["doc_id"].array)
            yield made

    return run


def score(docs: DataFrame, model: Model, path: str | None = None, leave_out: str | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, target_loss and background_loss (nats a token), score (their difference).

    leave_out: a column of docs that tells the rows of the target model; with it, all rows are ones that the background
    model counted, and each is scored without its own counts.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model.sent())  # at most SLOTS pairs: a bound whatever the input
    leave = F.lit(0) if leave_out is None else F.when(F.col(leave_out), 3).otherwise(1)
    whole, columns = model.rest is None, "doc_id long, n_tokens long, target_sum double, background_sum double"
    held = docs.select("doc_id", F.col("text").cast("string").alias("text"), leave.cast("int").alias("leave"))
    out = held.mapInPandas(_score(sent, path or tokenizer_file(), whole), columns if whole else f"{columns}, cold {COLD}")
    if not whole:
        # no pair left to this join has more than about one of SLOTS tokens, so no key is hot
        out = settle(out.withColumn("uid", F.monotonically_increasing_id()))
        met = out.select("uid", F.explode("cold").alias("c")).select("uid", "c.*").join(model.rest.select("pair", F.col("target").alias("t"), F.col("background").alias("b")), "pair")

        def more(seen: str, own: str, kind: str) -> Column:
            now = PAIR_WEIGHT * F.greatest(F.col(seen) - F.expr(own), F.lit(0)) / F.col(f"{kind}_context") + (1 - PAIR_WEIGHT) * F.col(f"{kind}_alone")
            return F.sum(-F.col("n") * F.log(now / ((1 - PAIR_WEIGHT) * F.col(f"{kind}_alone")))).alias(f"{kind}_more")

        added = met.groupBy("uid").agg(more("t", "CASE WHEN own > n THEN n ELSE 0 END", "target"), more("b", "CASE WHEN own > 0 THEN n ELSE 0 END", "background"))
        out = out.drop("cold").join(added, "uid", "left").withColumns({f"{c}_sum": F.col(f"{c}_sum") + F.coalesce(f"{c}_more", F.lit(0.0)) for c in ("target", "background")})
    n = F.nullif(F.col("n_tokens"), F.lit(0))
    out = out.select("doc_id", "n_tokens", *((F.col(f"{c}_sum") / n).alias(f"{c}_loss") for c in ("target", "background")))
    return out.withColumn("score", F.col("target_loss") - F.col("background_loss"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return score(marked, count_marked(marked), leave_out="target")


QUERIES = {"op5_lm_score": op5_lm_score}
