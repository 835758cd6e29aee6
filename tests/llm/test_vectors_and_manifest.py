"""Nearest neighbours, whitening and the manifest beside plain loops."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenweave.llm import ann, manifest, whitening
from tests.conftest import SMALL

VECTORS = "vec_id long, embedding array<double>"


def clashing(df):
    return df.withColumns({"uid": F.lit(1), "v": F.lit("x"), "x": F.lit(2), "ids": F.lit(0), "leaf": F.lit(7), "key": F.lit("k"), "grp": F.lit(1), "pos": F.lit(0), "run": F.lit(3), "n": F.lit(9), "score": F.lit(0.5), "component": F.lit(1)})


# nearest neighbours


def nearest(rows, k, asks=lambda i: i % 20 == 0):
    """All k nearest of each query by brute force: query, rank, id, score."""
    width = max((len(v) for _, v in rows if v), default=0)
    usable = {(i, tuple(v) + (0.0,) * (width - len(v))) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    out = []
    for i, q in sorted(usable):
        if asks(i):
            others = sorted((-float((np.array(q) * np.array(v)).sum()), j) for j, v in usable if (j, v) != (i, q))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(others)]
    return out


def as_rows(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


def test_small_tables_are_searched_exactly(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).round(1).tolist()) for i in range(120)] + [(300 + i, [1.0] + [0.0] * 5) for i in range(60)]
    rows += [(500, None), (520, []), (540, [0.0] * 6), (560, [1.0, None] + [0.0] * 4), (580, [float("nan")] + [1.0] * 5), (None, [1.0] * 6), (600, [2.0, 1.0]), (600, [2.0, 1.0]), (620, [-0.0, 1.0] + [0.0] * 4), (620, [1.0] * 6)]
    got = as_rows(ann.search(clashing(spark.createDataFrame(rows, VECTORS))))
    want = sorted(nearest(rows, 20))
    assert [(q, n, i) for q, n, i, _ in got] == [(q, n, i) for q, n, i, _ in want]
    assert np.allclose([s for *_, s in got], [s for *_, s in want], rtol=0, atol=1e-12)


def test_few_rows_and_none(spark):
    three = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, -1.0])]
    assert as_rows(ann.search(spark.createDataFrame(three, VECTORS))) == [(0, 1, 1, 0.5), (0, 2, 2, 0.0)]
    assert as_rows(ann.search(spark.createDataFrame(three[:1], VECTORS))) == []
    assert as_rows(ann.search(spark.createDataFrame([], VECTORS))) == []


@pytest.mark.parametrize("kind", ["cloud", "groups", "lengths"])
def test_recall_of_a_deep_forest(spark, kind):
    """Leaves of 32 rows in blocks of 10, on an even cloud, on tight groups of which one holds a third of all rows, and on vectors of unequal length."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 24))
    if kind == "groups":
        which = np.where(rng.random(4000) < 0.34, 0, rng.integers(0, 40, 4000))
        x = rng.normal(size=(40, 24))[which] + 0.1 * x
    if kind == "lengths":
        x *= rng.lognormal(sigma=0.7, size=(4000, 1))
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    got = as_rows(ann.search(spark.createDataFrame(rows, VECTORS), leaf=32, block=10))
    s = x[::20] @ x.T
    s[np.arange(200), np.arange(0, 4000, 20)] = -np.inf
    want = {(20 * q, int(i)) for q in range(200) for i in np.argsort(-s[q], kind="stable")[:20]}
    assert len(got) == 4000 and len({(q, i) for q, _, i, _ in got}) == 4000
    assert len({(q, i) for q, _, i, _ in got} & want) / 4000 >= 0.9
    assert all(abs(score - x[q] @ x[i]) < 1e-9 for q, _, i, score in got)
    assert [n for _, n, _, _ in got] == list(range(1, 21)) * 200


def test_tight_groups_read_few_leaves():
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(200, 24)), 40, axis=0) + 0.01 * rng.normal(size=(8000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    forest = ann.Forest(x, 1.0, len(x), leaf=32)
    even = rng.normal(size=(8000, 24))
    even /= np.linalg.norm(even, axis=1, keepdims=True)
    cloud = ann.Forest(even, 1.0, len(even), leaf=32)

    def read(forest, rows):
        out = []
        for q in rows[:50]:
            best = np.argsort(-(rows @ q))[:21]
            out.append(len(forest.search(q, rows[best], rows[best[-1]] @ q)))
        return np.mean(out)

    assert read(forest, x) < 0.1 * read(cloud, even)


def test_recall_on_the_given_table(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    held = [(r.vec_id, [float(c) for c in r.embedding]) for r in rows.collect()]
    want = {(q, i) for q, _, i, _ in nearest(held, 20)}
    got = {(r.query_id, r.vec_id) for r in ann.search(rows, leaf=64).collect()}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


# whitening


def test_limb_products_are_exact():
    rng = random.Random(4)
    x = np.array([[rng.randint(-(2**56), 2**56) for _ in range(5)] for _ in range(50)] + [[2**56, -(2**56), 0, 1, -1]], np.int64)
    want = [[sum(int(r[i]) * int(r[j]) for r in x) for j in range(5)] for i in range(5)]
    assert whitening.gram(x).tolist() == want
    assert whitening.column_sums(x).tolist() == [sum(int(r[i]) for r in x) for i in range(5)]
    back = whitening.digits(np.array([v for row in want for v in row], object))
    assert [sum(int(d) << (32 * k) for k, d in enumerate(row)) for row in back] == [v for row in want for v in row]
    many = np.full((10_000, 2), 2**20 - 1, np.int64)
    assert whitening.gram(many).tolist() == [[10_000 * (2**20 - 1) ** 2] * 2] * 2


def exact_covariance(x):
    n, d = len(x), len(x[0])
    mean = [Fraction(sum(r[j] for r in x), n) for j in range(d)]
    return mean, [[sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in x) / n for j in range(d)] for i in range(d)]


def check_whitening(rows, got, width):
    usable = [(i, [int(np.floor(64 * c)) + 1_000_000 for c in list(v) + [0.0] * (width - len(v))]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in usable})
    n, sums = len(fit), [sum(x[j] for x in fit) for j in range(width)]
    mean, cov = exact_covariance(fit)
    v = np.array([[float(c) for c in row] for row in cov])
    e, w = np.linalg.eigh(v)
    e, w = e[::-1], w[:, ::-1]
    k = min(16, width)
    assert len(got) == k * len(usable)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    signs = {}
    for i, x in usable:
        dev = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        mine = by[i, dev]
        for c in range(1, k + 1):
            r = mine[c][0]
            assert r.n == n and r.explained == pytest.approx(e[c - 1] / np.trace(v), rel=1e-6)
            if e[c - 1] > 1e-9:
                z = float(sum(float(a - m) * w[j, c - 1] for j, (a, m) in enumerate(zip(x, mean, strict=True)))) / np.sqrt(e[c - 1])
                sign = signs.setdefault(c, np.sign(z * r.whitened) or 1.0) if abs(z) > 1e-6 else signs.get(c, 1.0)
                assert r.whitened == pytest.approx(sign * z, abs=1e-7)
            assert r.identity_error is None or r.identity_error < 1e-9


def test_whitening_equals_exact_arithmetic(spark):
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(20, 20)) * np.linspace(3, 0.2, 20)
    rows = [(i, v) for i, v in enumerate((rng.normal(size=(90, 20)) @ mix).tolist())]
    rows += [(0, rows[0][1]), (500, rows[1][1]), (None, rows[2][1]), (501, None), (502, [1.0, None] + [0.0] * 18), (503, [float("inf")] + [0.0] * 19), (504, [0.5, 1.5]), (505, []), (506, [0.0] * 20)]
    got = whitening.whiten(clashing(spark.createDataFrame(rows, VECTORS))).collect()
    check_whitening(rows, got, 20)
    assert all(r.identity_error is not None for r in got) and len({r.identity_error for r in got}) == 1


def test_whitening_of_large_entries_is_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(i, v) for i, v in enumerate((rng.integers(-(2**30), 2**30, size=(40, 3)) / 4.0).tolist())]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert {r.deviation for r in got} == {None} and len(got) == 120  # beyond a long
    fit = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in rows]
    e = np.linalg.eigvalsh(np.array([[float(c) for c in row] for row in exact_covariance(fit)[1]]))[::-1]
    assert {r.component: r.explained for r in got} == pytest.approx({c + 1: e[c] / e.sum() for c in range(3)}, rel=1e-9)
    assert got[0].identity_error < 1e-9


def test_whitening_without_variance(spark):
    flat = [(i, [1.0, float(i % 3), 2.0]) for i in range(9)]
    got = whitening.whiten(spark.createDataFrame(flat, VECTORS)).collect()
    assert len(got) == 27 and all((r.whitened is None) == (r.component > 1) for r in got) and got[0].n == 3 and got[0].identity_error < 1e-9
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], VECTORS)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [None])], VECTORS)).collect() == []
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).collect() == []


def test_whitening_of_the_given_table(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").where("vec_id < 150")
    check_whitening([(r.vec_id, [float(c) for c in r.embedding]) for r in rows.collect()], whitening.whiten(rows).collect(), 64)


# manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(tree, i):
    out = []
    for level in tree[:-1]:
        other = i ^ 1
        out.append((i % 2 == 1, level[other] if other < len(level) else ""))
        i //= 2
    return out


def plain_manifest(rows):
    """rows: doc_id, source, lang, n_chars, text."""

    def leaf(r, more=0):
        values = [r[0], r[1], r[2], None if r[3] is None else r[3] + more, r[4]]
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    members = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in langs}
    trees = {g: levels([leaf(r) for r in members[g]]) for g in langs}
    top = levels([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for i, r in enumerate(members[g]):
            path = siblings(trees[g], i) + siblings(top, k)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            now = leaf(r, int(bad))
            for left, other in path:
                now = h(other, now) if left else h(now, other)
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], h(*(o for _, o in path)), now, now == top[-1][0]))
    return out


DOCS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("step,per_range", [(1, 7), (2, 1000), (8, 20)])
def test_manifest_equals_a_plain_loop(spark, step, per_range):
    rng = random.Random(7)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice(["de", "en", "en", "en", "", None, "é", "z"]), rng.choice([None, 5, -1]), rng.choice(["", "words " * i, None, "é中"])) for i in range(90)]
    rows += [(3, "a", "en", 5, "again"), (3, "a", "en", 5, "again"), (None, "b", "en", 5, "no id"), (None, None, None, None, None), (200, "s", "solo", 1, "x" * 300_000)]
    got = manifest.manifest(clashing(spark.createDataFrame(rows, DOCS)), step=step, per_range=per_range).collect()
    key = lambda r: tuple(str(c) for c in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(plain_manifest(rows), key=key)
    assert {r.verified for r in got} == {True, False}


def test_manifest_of_one_row_one_group_and_none(spark):
    for rows in ([(1, "a", "en", 3, "abc")], [(i, "a", "en", 3, "abc") for i in range(5)], [(1, "a", None, 3, "abc"), (2, "a", "", 3, "abc")]):
        got = manifest.manifest(spark.createDataFrame(rows, DOCS)).collect()
        assert sorted(map(tuple, got)) == sorted(plain_manifest(rows))
    assert manifest.manifest(spark.createDataFrame([], DOCS)).collect() == []


def test_rows_without_a_count_are_not_tampered_with(spark):
    hit = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 0]
    got = manifest.manifest(spark.createDataFrame([(i, "a", "en", 2**63 - 1 if i == hit[0] else None, "t") for i in range(60)], DOCS)).collect()
    assert [r.doc_id for r in got if not r.verified] == [hit[0]]
