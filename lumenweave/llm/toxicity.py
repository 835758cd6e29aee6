"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives, any texts of the training folds the unlabelled
ones. Words and their beginnings get an evidence: how much more often, at least, positive
texts have them than unlabelled ones (for a confirmed text, without its own part). A text is then a few numbers (its strongest words,
how many are strong, their share), and small numpy networks are trained on those by the
class-prior-corrected risk whose negative part is kept from falling below zero. Each
network is trained in a task of its own on its own resample; a score is their mean.

The shares behind the evidence are counted over all rows of the training folds, by partial
sums of tasks and a grouped sum; the networks are fitted on at most POSITIVE positives and
UNLABELLED unlabelled rows, those of the least hashes of doc_id; scoring reads every whole
text. Held-out rows (crc32 of doc_id as text mod 4 is 2) take no part in either.

Edge cases: a null text counts as empty and is scored like any text without words; a null
doc_id is scored, but never trained on, and is not held out; repeated labels of a document
count as their maximum; without a positive label every score is 0; repeated rows are each
scored; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.llm.common import documents, give_back, map_slices, settle, table

POSITIVE = 4_000
UNLABELLED = 16_000
MODELS = 3
STEPS = 1500
HIDDEN = 12
#: Features that fewer toxic texts have carry no evidence; so many of the strongest are kept.
LEAST_DF = 5
FEATURES = 50_000
CANDIDATES = 200_000
THRESHOLD = 0.3
HELD_OUT = 2
LEVELS = (1.8, 1.0, 0.4)
_WORD = re.compile(r"[^\W\d_]+")
_CACHE = 500_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def features(token: str) -> list[str]:
    """The words of a stretch between white space, and their beginnings of 3 to 7 letters."""
    out = []
    for w in (token,) if token.isalpha() else _WORD.findall(token):
        out.append(w)
        out += ["^" + w[:n] for n in range(3, min(len(w), 7) + 1)]
    return out


class Lookup:
    """The values of a token's features that have one."""

    def __init__(self, values: dict):
        self.words = {f: v for f, v in values.items() if not f.startswith("^")}
        self.beginnings = {f[1:]: v for f, v in values.items() if f.startswith("^")}
        self.begun: dict[str, tuple] = {}

    def word(self, w: str) -> tuple:
        head = w[:7]
        begun = self.begun.get(head)
        if begun is None:
            if len(self.begun) > _CACHE:
                self.begun.clear()
            begun = self.begun[head] = tuple(self.beginnings[b] for n in range(3, len(head) + 1) if (b := head[:n]) in self.beginnings)
        return (self.words[w], *begun) if w in self.words else begun

    def __call__(self, token: str) -> tuple:
        if token.isalpha():
            return self.word(token)
        return tuple(chain.from_iterable(map(self.word, _WORD.findall(token))))


class Describer:
    """Texts as rows of numbers by the evidence of their words."""

    def __init__(self, evidence: dict[str, float]):
        self.lookup = Lookup({f: e for f, e in evidence.items() if e > LEVELS[2]})  # what is not above the last level counts nowhere
        self.seen: set[str] = set()
        self.strong: dict[str, float] = {}

    def __call__(self, text: str | None) -> list[float]:
        words = (text or "").lower().split()
        n = len(words)
        if len(self.seen) > _CACHE:
            self.seen.clear()
            self.strong.clear()
        # most words are neither new nor strong, and set operations pass over them
        fresh = set(words) - self.seen
        self.seen |= fresh
        self.strong.update((w, max(own)) for w in fresh if (own := self.lookup(w)))
        found = Counter(filter(self.strong.__contains__, words))
        strong = sorted(((self.strong[w], k) for w, k in found.items()), reverse=True)
        top = [e for e, _ in strong[:3]] + [0.0] * 3
        counts = [sum(k for e, k in strong if e > level) for level in LEVELS]
        distinct = [sum(e > level for e, _ in strong) for level in LEVELS[:2]]
        share = [min(1.0, scale * c / max(n, 1)) for c, scale in zip(counts, (20, 20, 10), strict=True)]
        return [*top[:3], *(float(np.log1p(d)) for d in distinct), *share, float(np.log1p(n)) / 5, float(n == 0)]


class Network:
    """One hidden layer; gives the log odds of the positive class."""

    def __init__(self, weights: list[np.ndarray]):
        self.weights = weights

    def __call__(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh(x @ w1 + b1) @ w2 + b2[0]

    def gradient(self, x: np.ndarray, slope: np.ndarray) -> list[np.ndarray]:
        w1, b1, w2, _ = self.weights
        h = np.tanh(x @ w1 + b1)
        back = np.outer(slope, w2) * (1 - h * h)
        return [x.T @ back, back.sum(0), h.T @ slope, slope.sum(keepdims=True)]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int, steps: int = STEPS, hidden: int = HIDDEN, rate: float = 0.01) -> Network:
    """Minimise prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) for the logistic loss, by Adam on batches.

    Where a batch's negative part is below zero, the step goes against it, as that estimator asks.
    """
    rng = np.random.default_rng(seed)
    width = positive.shape[1]
    net = Network([rng.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.array([np.log(prior / (1 - prior))])])
    first, second = [np.zeros_like(w) for w in net.weights], [np.zeros_like(w) for w in net.weights]
    for t in range(1, steps + 1):
        p = positive[rng.integers(0, len(positive), 256)]
        u = unlabelled[rng.integers(0, len(unlabelled), 1024)]
        on_p, on_u = net(p), net(u)
        as_negative = np.logaddexp(0, on_u).mean() - prior * np.logaddexp(0, on_p).mean()
        down = [a - b for a, b in zip(net.gradient(u, _sigmoid(on_u) / len(u)), net.gradient(p, prior * _sigmoid(on_p) / len(p)), strict=True)]
        if as_negative >= 0:
            up = net.gradient(p, -prior * _sigmoid(-on_p) / len(p))
            step = [a + b for a, b in zip(down, up, strict=True)]
        else:
            step = [-a for a in down]
        for j, w in enumerate(net.weights):
            g = step[j] + 1e-4 * w
            first[j] = 0.9 * first[j] + 0.1 * g
            second[j] = 0.999 * second[j] + 0.001 * g * g
            w -= rate * (first[j] / (1 - 0.9**t)) / (np.sqrt(second[j] / (1 - 0.999**t)) + 1e-8)
    return net


def _training(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and toxic (null: no label) of the training folds' documents."""
    marks = labels.select(F.col("doc_id").alias("__id"), F.col("toxic").alias("__toxic")).where("__toxic IS NOT NULL").groupBy("__id").agg(F.max("__toxic").alias("__toxic"))
    train = docs.select("doc_id").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    return settle(train.join(marks, F.col("doc_id") == F.col("__id"), "left").select("doc_id", (F.col("__toxic") >= 1).alias("toxic")))


def _sample(docs: DataFrame, known: DataFrame, positive: int, unlabelled: int) -> DataFrame:
    """Rows doc_id, text, positive, confirmed for the fit."""
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    p = known.where("toxic").orderBy(*by_hash).limit(positive).select("doc_id", F.lit(True).alias("positive"), F.lit(True).alias("confirmed"))
    u = known.orderBy(*by_hash).limit(unlabelled).select("doc_id", F.lit(False).alias("positive"), F.coalesce("toxic", F.lit(False)).alias("confirmed"))
    ids = settle(p.unionByName(u))  # at most positive + unlabelled rows
    return settle(documents(docs).join(F.broadcast(ids), "doc_id").select("doc_id", "text", "positive", "confirmed"))


def _features():
    """Partial counts of texts by feature, and of rows under the empty name; handed on when there are _CACHE of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, known = Counter(), {}

        def made() -> Iterator[pd.DataFrame]:
            names = iter(n)
            while part := list(islice(names, 20_000)):
                yield pd.DataFrame({"feature": part, "n": [n[f] for f in part]})

        for rows in batches:
            for text in rows["text"]:
                found = {""}
                for w in set((text or "").lower().split()):
                    parts = known.get(w)
                    if parts is None:
                        parts = known[w] = tuple(features(w))
                    if parts:
                        found.update(parts)
                n.update(found)
            if len(n) > _CACHE or len(known) > _CACHE:
                yield from made()
                n, known = Counter(), {}
        yield from made()

    return run


def _wanted_features(wanted):
    """As _features for the wanted ones alone: a text's features are numbers, counted in an array."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = list(wanted.value)
        of, count, total = Lookup({f: i for i, f in enumerate(names)}), np.zeros(len(names), np.int64), 0
        seen: set[str] = set()
        known: dict[str, tuple] = {}
        for rows in batches:
            for text in rows["text"]:
                words = set((text or "").lower().split())
                fresh = words - seen
                seen |= fresh
                known.update((w, own) for w in fresh if (own := of(w)))
                found = np.fromiter(chain.from_iterable(map(known.__getitem__, filter(known.__contains__, words))), np.int32)
                found.sort()
                count[found[np.append(True, found[1:] != found[:-1])] if len(found) else found] += 1
            total += len(rows)
            if len(seen) > _CACHE:
                seen, known = set(), {}
        if total:
            some = np.flatnonzero(count)
            yield pd.DataFrame({"feature": ["", *(names[i] for i in some)], "n": [total, *count[some]]})

    return run


def _counted(texts: DataFrame, name: str, wanted=None) -> DataFrame:
    return map_slices(texts.select("text"), _wanted_features(wanted) if wanted else _features(), "feature string, n long").groupBy("feature").agg(F.sum("n").alias(name))


def evidence(docs: DataFrame, known: DataFrame, sample: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Feature -> log ratio of its shares among confirmed toxic rows and all rows of the training folds (known), less a standard error;
    at most FEATURES, positive ones. Twice: from all rows, and with one toxic row (that is among all rows too) left out.

    Both shares are exact. Features that the sample's unlabelled rows show to have no positive evidence, by three standard
    errors, are not counted in the other rows; of the rest at most CANDIDATES are.
    """
    train = documents(docs).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    toxic = known.where("toxic").select(F.col("doc_id").alias("__id"))
    p = _counted(train.join(toxic, F.col("doc_id") == F.col("__id")), "p").where(F.col("p") >= LEAST_DF)
    few = settle(p.join(_counted(sample.where("NOT positive"), "s"), "feature", "left").withColumn("s", F.coalesce("s", F.lit(0))))
    n = few.where("feature = ''").select("p", "s").first()
    if n is None:
        return {}, {}
    high = F.log(F.col("p") / n["p"]) - F.log(F.greatest(F.col("s") - 3 * F.sqrt("s"), F.lit(0.5)) / max(n["s"], 1))
    some = few.where("feature <> ''").withColumn("high", high).where("high > 0").orderBy(F.desc("high"), "feature").limit(CANDIDATES)
    chosen = settle(some.select("feature", "p"))
    wanted = docs.sparkSession.sparkContext.broadcast(frozenset(r["feature"] for r in chosen.toLocalIterator()))  # at most CANDIDATES names
    u = settle(_counted(train, "u", wanted))
    n = {"p": n["p"], "u": u.where("feature = ''").first()["u"]}
    counts = chosen.join(u, "feature")

    def ratio(less: int) -> Column:
        p, u = F.col("p") - less + 0.5, F.greatest(F.col("u") - less, F.lit(0)) + 0.5
        return F.log(p / (n["p"] - less + 1)) - F.log(u / (max(n["u"] - less, 0) + 1)) - 1 / F.sqrt(p)

    without = F.when(F.col("p") > LEAST_DF, F.greatest(ratio(1), F.lit(0.0))).otherwise(0.0)
    strong = counts.select("feature", ratio(0).alias("e"), without.alias("w")).where("e > 0").orderBy(F.desc("e"), "feature").limit(FEATURES)
    rows = strong.collect()
    return {r["feature"]: r["e"] for r in rows}, {r["feature"]: r["w"] for r in rows}


def _describe(found: dict[str, float], without: dict[str, float]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every, own = Describer(found), Describer(without)
        for rows in batches:
            x = [(own if c else every)(t) for t, c in zip(rows["text"], rows["confirmed"], strict=True)]
            yield pd.DataFrame({"doc_id": rows["doc_id"], "positive": rows["positive"], "x": x})

    return run


def _train(prior: float, steps: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        number = int(rows["model"].iloc[0])
        rows = rows.sort_values(["doc_id", "positive"], kind="stable")
        x = np.array(rows["x"].tolist())
        is_p = rows["positive"].to_numpy(bool)
        middle, spread = x[~is_p].mean(0), x[~is_p].std(0) + 1e-6
        z = (x - middle) / spread
        rng = np.random.default_rng(1000 + number)
        p, u = (part[rng.integers(0, len(part), len(part))] for part in (z[is_p], z[~is_p]))
        net = fit_nnpu(p, u, prior, number, steps)
        flat = np.concatenate([middle, spread, *(w.ravel() for w in net.weights)])
        return pd.DataFrame({"model": [number], "weights": [flat.tolist()]})

    return run


def train(docs: DataFrame, labels: DataFrame, positive: int = POSITIVE, unlabelled: int = UNLABELLED, models: int = MODELS, steps: int = STEPS):
    """The evidence and the networks' weights (None without a positive label); both are small whatever the input."""
    known = _training(docs, labels)
    prior = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    if not 0 < prior < 1:
        return None
    sample = _sample(docs, known, positive, unlabelled)
    found, without = evidence(docs, known, sample)
    rows = settle(sample.mapInPandas(_describe(found, without), "doc_id long, positive boolean, x array<double>"))
    each = rows.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(models - 1))))
    weights = each.groupBy("model").applyInPandas(_train(prior, steps), "model int, weights array<double>").orderBy("model").collect()
    return found, [np.array(r["weights"]) for r in weights]


def _network(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, Network]:
    width = len(Describer({})(""))
    hidden = (len(flat) - 2 * width - 1) // (width + 2)
    ends = np.cumsum([width, width, width * hidden, hidden, hidden])
    middle, spread, w1, b1, w2, b2 = np.split(flat, ends)
    return middle, spread, Network([w1.reshape(width, hidden), b1, w2, b2])


def _score(model):
    """Batches of kept columns and, last, texts become batches of kept columns and scores; texts are read from the batch one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        describe = Describer(model[0]) if model else None
        nets = [_network(w) for w in model[1]] if model else []
        for rows in batches:
            *kept, texts = rows.columns
            score = np.zeros(len(texts))
            if model and len(texts):
                x = np.array([describe(t.as_py()) for t in texts])
                score = np.mean([_sigmoid(net((x - m) / s)) for m, s, net in nets], axis=0)
            yield pa.RecordBatch.from_arrays([*kept, pa.array(score)], names=[*rows.schema.names[:-1], "score"])

    return run


def score(docs: DataFrame, model, keep: tuple = ()) -> DataFrame:
    """Per row: doc_id, keep, score."""
    chosen = docs.select(F.col("doc_id"), *keep, F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"`{n}` {t}" for n, t in chosen.drop("text").dtypes)
    return chosen.mapInArrow(give_back(_score(model)), f"{schema}, score double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents predicted toxic go."""
    model = train(docs, table(spark, sf_dir, "labels"))
    hidden = {c: f"__keep_{i}" for i, c in enumerate(docs.columns) if c != "doc_id"}
    held = docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(h) for c, h in hidden.items()))
    scored = score(held, model, tuple(hidden.values())).where(F.col("score") < THRESHOLD)
    return scored.select(*(F.col(hidden.get(c, c)).alias(c) for c in docs.columns))


QUERIES = {"op4_toxicity": op4_toxicity}
