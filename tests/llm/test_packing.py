import collections

import numpy as np
import pytest

from lumenweave.llm import packing


def falling(lengths):
    return packing.Bins(lengths, 4096).best_fit(sorted(range(len(lengths)), key=lambda i: -lengths[i]))


@pytest.fixture
def crossovers(monkeypatch):
    seen, plain = [], packing.crossover

    def counted(one, other, rng):
        seen.append(len(one.lengths))
        return plain(one, other, rng)

    monkeypatch.setattr(packing, "crossover", counted)
    return seen


@pytest.mark.parametrize("seed", range(3))
def test_evolution_beats_best_fit_on_hard_blocks(crossovers, seed):
    lengths = np.random.default_rng(seed).integers(1000, 2001, 1000).tolist()
    best = packing.evolve(lengths, 4096, [], np.random.default_rng(seed))
    assert sorted(i for b in best.bins for i in b) == list(range(1000)) and max(best.fills) <= 4096
    assert len(crossovers) > packing.FIRST
    assert len(best.bins) <= 0.97 * len(falling(lengths).bins)  # 403 by best-fit alone, 384 to 386 by evolution


def test_crossover_is_what_finds_fewer_bins(monkeypatch):
    lengths = np.random.default_rng(0).integers(1000, 2001, 1000).tolist()
    monkeypatch.setattr(packing, "crossover", lambda one, other, rng: packing.Bins(lengths, 4096).best_fit(rng.permutation(1000).tolist()))
    assert len(packing.evolve(lengths, 4096, [], np.random.default_rng(0)).bins) == len(falling(lengths).bins)


def test_seeds_at_the_bound_have_crossovers_too(crossovers):
    lengths = [1024] * 400
    assert len(packing.evolve(lengths, 4096, [], np.random.default_rng(1)).bins) == 100
    assert len(crossovers) == packing.FIRST
    packing.evolve(lengths, 4096, [falling(lengths).places()], np.random.default_rng(1))
    assert len(crossovers) == packing.FIRST


def test_company_is_the_best_of_one_or_two():
    rng = np.random.default_rng(3)
    for _ in range(200):
        lengths = rng.integers(1, 100, 12).tolist()
        held = packing.Bins(lengths, 100, [[0]])
        pool = sorted((lengths[i], i) for i in range(1, 12))
        room = 100 - lengths[0]
        sums = [a for a in lengths[1:] if a <= room] + [a + b for i, a in enumerate(lengths[1:]) for b in lengths[i + 2 :] if a + b <= room]
        before = len(pool)
        held._take(0, pool)
        assert len(pool) + len(held.bins[0]) - 1 == before
        assert held.fills[0] - lengths[0] >= max(sums, default=0)


def test_hard_blocks_are_packed_through_islands(spark):
    lengths = np.random.default_rng(7).integers(1000, 2001, 600).tolist()
    cut = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "uid long, length long")
    rows = packing.pack(cut, block=300).collect()
    fills = collections.Counter()
    for r in rows:
        fills[r.sequence_id] += lengths[r.uid]
    assert len(rows) == 600 and max(fills.values()) <= 4096
    assert len(fills) < len(falling(lengths).bins)
