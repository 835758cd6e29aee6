"""Tables in buckets beside a plain dictionary."""

import random

import pytest
from pyspark.sql import functions as F

from lumenweave.operators.buckets import Buckets

SCHEMA = "k long, path string, v array<float>"


def rows(spark, held):
    return spark.createDataFrame([(k, f"/p/{k % 7}", [float(x), 1.0]) for k, x in held.items()], SCHEMA)


def read(table):
    return {r.k: r.v[0] for r in table.read().collect()}


def test_changes_equal_a_dictionary(spark, tmp_path):
    rng = random.Random(10)
    t = Buckets(spark, str(tmp_path / "t"), ["k"], 8, "v", 2)
    assert t.read() is None and t.versions() == []
    want = {k: 0 for k in range(40)}
    t.upsert(rows(spark, want))
    old = []
    for step in range(1, 5):
        new = {rng.randint(0, 60): step for _ in range(3)}
        old.append(dict(want))
        t.upsert(rows(spark, new))
        want |= new
        gone = {k for k in want if rng.random() < 0.05}
        t.delete(spark.createDataFrame([(k,) for k in gone], "k long"))
        want = {k: x for k, x in want.items() if k not in gone}
        assert read(t) == want
    t.delete_where(F.col("path") == "/p/3")
    want = {k: x for k, x in want.items() if k % 7 != 3}
    assert read(t) == want
    assert {r.k: r.v[0] for r in t.read(0).collect()} == old[0]  # versions stay as they were
    some = list(want)[:2] + [999]
    assert {r.k for r in t.lookup(spark.createDataFrame([(k,) for k in some], "k long")).collect()} == set(some[:2])


def test_one_changed_row_of_many_rewrites_one_bucket(spark, tmp_path):
    t = Buckets(spark, str(tmp_path / "t"), ["k"], 64)
    t.create(spark.range(1_000_000).select(F.col("id").alias("k"), F.lit("old").alias("v")))
    first = t._named(t.versions()[-1])["folders"]
    t.upsert(spark.createDataFrame([(77, "new")], "k long, v string"))
    second = t._named(t.versions()[-1])["folders"]
    assert len(first) == 64 and sum(first[k] != second[k] for k in first) == 1
    assert t.read().count() == 1_000_000 and [r.v for r in t.read().where("k = 77").collect()] == ["new"]
    plan = t.lookup(spark.createDataFrame([(77,)], "k long"))
    assert len(plan.inputFiles()) < 0.1 * len(t.read().inputFiles())
    t.delete(spark.createDataFrame([(-5,)], "k long"))
    assert t.read().count() == 1_000_000


def test_a_wrong_width_publishes_nothing(spark, tmp_path):
    t = Buckets(spark, str(tmp_path / "t"), ["k"], 4, "v", 2)
    t.create(rows(spark, {1: 1, 2: 2}))
    bad = spark.createDataFrame([(3, "/p", [1.0, 2.0]), (4, "/p", [1.0, 2.0, 3.0])], SCHEMA)
    with pytest.raises(Exception, match="a vector is 3 wide, not 2"):
        t.upsert(bad)
    assert read(t) == {1: 1.0, 2: 2.0} and t.versions() == [0]
    with pytest.raises(ValueError):
        Buckets(spark, str(tmp_path / "t"), ["path"], 4).read()


def test_old_versions_are_retired(spark, tmp_path):
    t = Buckets(spark, str(tmp_path / "t"), ["k"], 4)
    for step in range(5):
        t.upsert(rows(spark, {k: step for k in range(12 - step)}))
    want = read(t)
    before = t.read(3).count()
    assert len(t.retire(2)) >= 2 and t.versions() == [3, 4]
    assert read(t) == want and t.read(3).count() == before
    assert t.retire(2) == []


def test_empty_tables_null_keys_and_missing_columns(spark, tmp_path):
    t = Buckets(spark, str(tmp_path / "t"), ["k", "path"], 4)
    t.create(spark.createDataFrame([], SCHEMA))
    assert t.read().count() == 0 and t.read().columns == ["k", "path", "v"]
    t.upsert(spark.createDataFrame([(1, "/a"), (None, "/b")], "k long, path string"))
    assert sorted((r.k or 0, r.path, r.v) for r in t.read().collect()) == [(0, "/b", None), (1, "/a", None)]
    t.upsert(spark.createDataFrame([(1, "/a", [2.0])], SCHEMA))
    assert sorted((r.k or 0, r.path, r.v) for r in t.read().collect()) == [(0, "/b", None), (1, "/a", [2.0])]
