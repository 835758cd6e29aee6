"""The resharding query row by row beside plain sizes, checksums and the least that must move."""

import collections
import random
import zlib

import pytest

from lumenweave.llm import resharding


def table(rng, n):
    rows = [(i, rng.choice(["", "word " * rng.randint(1, 60), "é中" * rng.randint(1, 90), None])) for i in range(n)]
    return rows + [rows[1], rows[1], (None, "no id"), (None, "no id"), (n, "x" * 30_000)]


@pytest.mark.parametrize("n,shards,old_shards", [(400, 40, 32), (60, 5, 8), (5, 40, 32)])
def test_every_row_has_its_size_shard_and_slot(spark, n, shards, old_shards):
    rows = table(random.Random(n), n)
    got = resharding.reshard(spark.createDataFrame(rows, "doc_id long, text string"), shards=shards, old_shards=old_shards).collect()
    raw = lambda t: (t or "").encode()
    want = collections.Counter((d, len(raw(t)) + 16, zlib.crc32(raw(t))) for d, t in rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots, sizes = collections.defaultdict(list), collections.Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert set(slots) <= set(range(shards)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    # cuts fall between documents: a shard is off its capacity by less than the documents at its two ends, unless one document is larger than a shard
    total = sum(sizes.values())
    capacity = resharding.even(total, shards)
    small = max((r.size for r in got if r.size <= max(1, total // shards // resharding.LARGE)), default=0)
    if max(r.size for r in got) < min(capacity):
        assert all(abs(sizes[j] - capacity[j]) <= 2 * old_shards * small for j in range(shards))
    # no plan moves fewer bytes than what old shards hold beyond their new capacity, and what shards that go away hold
    supply = collections.Counter()
    for r in got:
        supply[r.old_shard] += r.size
    least = sum(max(0, s - (capacity[i] if i < shards else 0)) for i, s in supply.items())
    moved = sum(r.size for r in got if r.old_shard != r.shard)
    large = sum(r.size for r in got if r.size > max(1, total // shards // resharding.LARGE))
    assert moved <= least + large + 2 * (shards + old_shards) * small


def test_the_same_rows_get_the_same_places(spark):
    rows = table(random.Random(7), 80)
    plan = lambda parts: sorted(str(tuple(r)) for r in resharding.reshard(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), shards=6, old_shards=4).collect())
    assert plan(1) == plan(5)
