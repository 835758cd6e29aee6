"""Pivot search beside brute force."""

import numpy as np
import pytest

from lumenweave.functions import pivots as P
from lumenweave.functions.vector import knn_batch

SCHEMA = "key long, embedding array<double>"


def made(kind):
    rng = np.random.default_rng(16)
    if kind == "groups":
        x = np.repeat(rng.normal(size=(60, 12)), 50, axis=0) + 0.02 * rng.normal(size=(3000, 12))
    elif kind == "copies":
        x = np.where(rng.random((1500, 1)) < 0.4, np.ones((1, 8)), rng.normal(size=(1500, 8)).round(1))
    else:
        x = rng.normal(size=(2000, 4))
    return x


@pytest.mark.parametrize("kind,most", [("groups", 0.3), ("copies", 1.0), ("flat", 0.5)])
def test_all_queries_find_their_exact_neighbours(spark, kind, most):
    x = made(kind)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], SCHEMA).repartition(6)
    index = P.Index(rows, "key", ring=64)
    queries = rows.where("key % 20 = 0")
    found = P.knn_pivots(queries, index, 7, "key")
    got = {(r["query"], r["rank"]): (r["neighbour"], r["score"]) for r in found.collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, len(x), 20):
        d = 1 - (u * u[q]).sum(axis=1)
        order = np.lexsort((np.arange(len(x)), d.round(12)))[:7]
        assert [got[q, n + 1][1] for n in range(7)] == pytest.approx([d[i] for i in order], abs=1e-9)
        last = d[order[-1]] - 1e-9
        assert {got[q, n + 1][0] for n in range(7) if got[q, n + 1][1] < last} == {int(i) for i in np.flatnonzero(d < last)}
    assert len(got) == 7 * len(range(0, len(x), 20))
    assert P.share(queries, index, found, "key") < most + 1e-9


def test_the_same_as_in_blocks(spark):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(made("flat")[:500].tolist())], SCHEMA)
    queries = rows.where("key < 40")
    want = {(r["query"], r["rank"], r["neighbour"]) for r in knn_batch(queries, rows, 5, "key", "key").collect()}
    assert {(r["query"], r["rank"], r["neighbour"]) for r in P.knn_pivots(queries, P.Index(rows, "key", ring=32), 5, "key").collect()} == want


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (None, [1.0, 1.0]), (5, [0.0, 2.0]), (6, [])], SCHEMA)
    found = P.knn_pivots(rows, P.Index(rows, "key"), 3, "key")
    assert sorted((r["query"], r["rank"], r["neighbour"], round(r["score"], 9)) for r in found.collect()) == [(1, 1, 1, 0.0), (1, 2, 5, 1.0), (5, 1, 5, 0.0), (5, 2, 1, 1.0)]
    none = rows.limit(0)
    assert P.knn_pivots(rows, P.Index(none, "key"), 3, "key").count() == 0 and P.knn_pivots(none, P.Index(rows, "key"), 3, "key").count() == 0
