"""Places, pages and transcripts in blocks beside plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from lumenweave.functions import transcripts as P
from lumenweave.functions.text import transcript_chunks
from lumenweave.operators.ranks import Pages, numbered, range_count


def test_places_equal_a_sort(spark):
    rng = random.Random(11)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 20)) for _ in range(500)] + [("a", 7)] * 200
    df = spark.createDataFrame(rows, "g string, x int").repartition(5)
    got = [(r.g, r.x, r.pos) for r in numbered(df, ["g"], ["x"], 40).collect()]
    want = [(g, x, i) for g in ("a", "b", None) for i, x in enumerate(sorted(x for h, x in rows if h == g))]
    assert sorted(got, key=str) == sorted(want, key=str)
    whole = [(r.x, r.pos) for r in numbered(df, [], [F.desc("x"), "g"], 40).orderBy("pos").collect()]
    assert [x for x, _ in whole] == sorted((x for _, x in rows), reverse=True) and [p for _, p in whole] == list(range(700))
    assert numbered(df.limit(0), ["g"], ["x"]).count() == 0


def test_a_page_reads_its_range_alone(spark):
    n = 20_000
    pages = Pages.build(spark.range(n).select("id", (F.col("id") * 7919 % n).alias("x")), ["x"], per_range=500)
    want = [i * 7919 % n for i in range(n)]
    by = sorted(range(n), key=lambda i: want[i])
    for offset, limit in ((0, 10), (9_990, 20), (n - 3, 10), (n, 5), (4_321, 1_500)):
        got = pages.page(offset, limit).collect()
        assert [(r.id, r.rank) for r in got] == [(by[k], k) for k in range(offset, min(offset + limit, n))]
    assert len(pages.page(10_000, 20).inputFiles()) <= 2 and len(pages._rows().inputFiles()) >= 35
    page, total, more = pages.page_with_total(10 * n, 20)
    assert (page.count(), total, more) == (0, n, False)
    assert Pages.build(spark.range(0), ["id"]).page_with_total(0, 5)[1:] == (0, False)


def test_a_large_table_has_few_ranges_and_a_page_passes_over_most_of_one(spark, monkeypatch):
    assert [range_count(n, 2_000) for n in (1, 2_001, 600_000, 36_000_000, 216_000_000, 10**9)] == [1, 2, 256, 256, 256, 1000]
    monkeypatch.setattr("lumenweave.operators.ranks.RANGES", 4)
    n, was = 40_000, spark.conf.get("spark.sql.adaptive.enabled")
    pages = Pages.build(spark.range(n).select("id", (F.col("id") * 7919 % n).alias("x")), [F.desc("x")], per_range=500)
    assert len(pages.index()) <= 4 and pages.total() == n
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for offset, limit in ((0, 7), (9_900, 300), (19_990, 10_100), (n - 3, 10), (500, 0)):
            page = pages.page(offset, limit)
            assert [(r.x, r.rank) for r in page.collect()] == [(n - 1 - k, k) for k in range(offset, min(offset + limit, n))]
            read = page._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()
            assert read <= 2 * (limit + 1_000)  # of ranges of 10,000 rows; twice, as the sort takes its sample first
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)


def plain_ends(sizes, most, many):
    """Where the packing loop ends its chunks, begun at the first segment."""
    out, count, size = [], 0, 0
    for i, n in enumerate(sizes):
        if count and (size + n + 1 > most or count >= many):
            out.append(i)
            count, size = 0, 0
        size, count = (size + n + 1 if count else n), count + 1
    return out, count


@pytest.mark.parametrize("seed", range(5))
def test_tables_of_blocks_are_the_loop(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([3, 40, 100, 250, 500]) for _ in range(rng.randint(30, 200))]
    block, most, many, m, begun, starts = rng.randint(6, 20), 420, 6, 0, 0, [0]
    for at in range(0, len(sizes), block):
        before, own = sizes[max(0, at - many) : at], sizes[at : at + block]
        exits, new, first = P.transitions(before, own, most, many)
        ends, open_ = plain_ends(sizes[: at + len(own)], most, many)
        assert exits[m] == open_
        inside = [e for e in ([0] if at == 0 else []) + ends if at <= e < at + len(own)]
        assert new[m] == len(inside) and first[m] == (inside[0] - at if inside else len(own))
        m, begun = exits[m], begun + new[m]
    assert begun == len(plain_ends(sizes, most, many)[0]) + 1


@pytest.mark.parametrize("block", [6, 50, 4096])
def test_transcripts_in_blocks_equal_the_loop(spark, block):
    rng = random.Random(12)
    rows = []
    for conv, n in (("long", 700), ("short", 4), ("one", 1), (None, 30)):
        for k in range(n):
            text = rng.choice(["", "  ", None, "word " * rng.randint(1, 90), "é" * rng.randint(1, 300), " a b "])
            rows.append((conv, k, float(k), rng.choice([None, k + 0.5]), text))
    segments = spark.createDataFrame([*rows, rows[0]], "conv string, seg_no long, start_s double, end_s double, text string")
    key = lambda r: tuple(str(c) for c in r)
    got = sorted(map(tuple, P.transcript_chunks_in_blocks(segments, ["conv"], block=block).collect()), key=key)
    assert got == sorted(map(tuple, transcript_chunks(segments, ["conv"]).collect()), key=key) and len(got) > 100
    assert P.transcript_chunks_in_blocks(segments.limit(0), ["conv"]).count() == 0


def test_one_transcript_lies_in_several_tasks(spark):
    segments = spark.range(3000).select(F.lit("c").alias("conv"), F.col("id").alias("seg_no"), F.col("id").cast("double").alias("start_s"), F.col("id").cast("double").alias("end_s"), F.repeat(F.lit("word "), F.col("id").cast("int") % 40 + 1).alias("text"))
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        chunks = P.transcript_chunks_in_blocks(segments, ["conv"], block=100)
        assert chunks.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
