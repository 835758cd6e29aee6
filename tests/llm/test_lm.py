import collections
import random

import numpy as np
import pytest

from lumenweave.llm import lm_score
from tests.llm.test_llm import prose


def plain(rows, good):
    """Losses of each document under models that have counted all documents but itself."""
    ids = {d: [int(x) for x in np.frombuffer(b, "<u4")[:-1]] for d, b in zip([r[0] for r in rows], lm_score.id_bytes([r[1] or "" for r in rows], lm_score.tokenizer_file()), strict=True)}
    out = {}
    for d, seq in ids.items():
        if not seq:
            continue
        out[d] = []
        for members in (good, set(ids)):
            one, two, ctx = collections.Counter(), collections.Counter(), collections.Counter()
            for x in members - {d}:
                two.update(zip([lm_score.IDS, *ids[x]], ids[x], strict=False))
                one.update(ids[x])
                ctx.update(([lm_score.IDS] if ids[x] else []) + ids[x])
            total = sum(one.values())
            p = [0.7 * two[a, b] / max(ctx[a], 1) + 0.3 * (one[b] + 0.5) / (total + 0.5 * lm_score.IDS) for a, b in zip([lm_score.IDS, *seq], seq, strict=False)]
            out[d].append(-np.log(p).mean())
    return out


@pytest.mark.parametrize("slots", [1 << 20, 40])
def test_losses_without_a_document_itself(spark, slots):
    rng = random.Random(31)
    rows = [(i, prose(rng, rng.randint(0, 60))) for i in range(40)] + [(40, None), (41, "once twice once twice"), (42, "only here and nowhere else")]
    good = set(range(0, 43, 3))
    labels = spark.createDataFrame([(i, int(i in good)) for i in range(43)], "doc_id long, quality int")
    marked = lm_score.mark(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    got = {r.doc_id: r for r in lm_score.score(marked, lm_score.count_marked(marked, slots=slots), leave_out="target").collect()}
    want = plain(rows, good)
    assert set(got) == set(range(43)) and got[40].score is None
    for d, (target, background) in want.items():
        assert (got[d].target_loss, got[d].background_loss) == pytest.approx((target, background), rel=1e-9)
        assert got[d].score == pytest.approx(target - background, abs=1e-9)


def test_target_documents_are_not_favoured(spark):
    """Equally good documents in and out of the target score alike."""
    rng = random.Random(32)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(vocabulary[: 150 if i % 2 else 300]) for _ in range(60))) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 == 1)) for i in range(200)], "doc_id long, quality int")
    marked = lm_score.mark(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    got = {r.doc_id: r for r in lm_score.score(marked, lm_score.count_marked(marked), leave_out="target").collect()}
    inside, outside, others = (np.mean([got[i].score for i in range(k, 200, step)]) for k, step in ((1, 4), (3, 4), (0, 2)))
    assert abs(inside - outside) < 0.05 and others > outside + 0.1


def test_a_copy_counts_as_any_other_document(spark):
    """A text of which there is a copy loses exactly what plain counts say, and not more than without the copy."""
    rng = random.Random(33)
    rows = [(i, prose(rng, 30)) for i in range(30)]
    twice = [*rows, (30, rows[0][1])]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(31)], "doc_id long, quality int")

    def losses(docs):
        marked = lm_score.mark(spark.createDataFrame(docs, "doc_id long, text string"), labels)
        return {r.doc_id: r.background_loss for r in lm_score.score(marked, lm_score.count_marked(marked), leave_out="target").collect()}

    once, again, want = losses(rows), losses(twice), plain(twice, set(range(0, 31, 3)))
    assert again[0] == pytest.approx(want[0][1], rel=1e-9) and again[30] == pytest.approx(again[0], rel=1e-9)
    assert again[0] < once[0]
