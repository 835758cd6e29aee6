"""Every stage of the pipeline on rows with clashing column names, beside plain loops."""

import collections
import hashlib
import random
import re

import corpus_pipeline
from lumenweave.llm import exact_dedup, toxicity
from lumenweave.llm.common import settle
from tests.conftest import SMALL
from tests.llm.test_llm import check_packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __id long, __sha string, __keeps boolean, __mark long, __gone long, uid long, key string, size long, gone_id long, __own_0 string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def rows():
    rng = random.Random(41)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ri", "su", "ta") for b in ("ran", "den", "fol", "gis", "hum")]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 60))) for _ in range(40)]
    texts += [texts[0], texts[1].replace(" ", "\n\t"), texts[1]]  # equal texts
    texts += [" ".join(texts[k].split()[:-1]) for k in range(2, 12)]  # near copies, of the longer ones
    texts += [None, "", " ", "one two", "one  two", "x" * 200_000]
    out = []
    for i, t in enumerate(texts):
        out.append((i if i != 45 else None, t, "en", rng.choice(["a", "b", "c", None]), None if t is None else len(t), i % 3, "s", True, 7, None, 0, "k", 9, i % 2, "own"))
    return out + [out[3], out[3], out[-1]]  # repeated rows


def smallest(group):
    return min(group, key=lambda r: (r[0] is None, r[0] or 0))


def plain_exact(held):
    groups = collections.defaultdict(list)
    for r in held:
        groups[SPACE.sub(" ", r[1] or "")].append(r)
    return [smallest(g) for g in groups.values()]


def plain_near(held):
    sets = []
    for r in held:
        w = WORD.findall((r[1] or "").lower())
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root = list(range(len(held)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[max(top(i), top(j))] = min(top(i), top(j))
    groups = collections.defaultdict(list)
    for i, r in enumerate(held):
        groups[top(i)].append(r)
    return [smallest(g) for g in groups.values()]


def plain_mix(held):
    """Weighted fair queueing by sorting the whole queue."""
    size = [len(WORD.findall(r[1] or "")) for r in held]
    names = sorted({r[3] for r in held}, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    whole = {s: sum(n for r, n in zip(held, size, strict=True) if r[3] == s) for s in names}
    budget, target, rest = 1.5 * sum(size), {}, set(names)
    while rest:
        left = budget - sum(target.values())
        share = {s: left / sum(weight[x] for x in rest) * weight[s] for s in rest}
        over = {s for s in rest if share[s] > 2 * whole[s]}
        target |= {s: 2.0 * whole[s] for s in over} if over else share
        rest = rest - over if over else set()
    queue, served = [], collections.Counter()
    spread = lambda r: hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest()
    for r, n in sorted(zip(held, size, strict=True), key=lambda x: (spread(x[0]), x[0][0] or 0, x[1])):
        served[r[3]] += n
        for turn in (0, 1):
            finish = (served[r[3]] + turn * whole[r[3]]) / target[r[3]] if target[r[3]] else 0.0
            queue.append((finish, names.index(r[3]), spread(r), r[0] is not None, r[0] or 0, n, r))
    out, total = [], 0
    for *_, n, r in sorted(queue, key=lambda x: x[:-1]):
        total += n
        if total <= budget:
            out.append(r)
    return out


def counted(held):
    return collections.Counter(tuple(r) for r in held)


def test_stages_on_clashing_columns(spark):
    docs = settle(spark.createDataFrame(rows(), SCHEMA))
    by = dict(corpus_pipeline.STAGES)
    assert list(by) == ["toxicity", "exact dedup", "minhash near-dedup", "mixing", "packing"]

    model = toxicity.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    bad = {(r.doc_id, r.text) for r in toxicity.score(docs, model, ("n_chars",)).where(f"score >= {toxicity.THRESHOLD}").select("doc_id").join(docs, "doc_id").collect()}
    clean = settle(by["toxicity"](spark, docs, SMALL))
    assert clean.columns == docs.columns and counted(clean.collect()) == counted(r for r in rows() if (r[0], r[1]) not in bad)

    everything = settle(docs)
    once = settle(by["exact dedup"](spark, everything, SMALL))
    assert once.columns == docs.columns and counted(once.collect()) == counted(plain_exact(rows()))

    for before in (rows(), once.collect()):  # with repeated rows, and as the stage before leaves them
        held = spark.createDataFrame(before, SCHEMA)
        unique = settle(by["minhash near-dedup"](spark, held, SMALL))
        blank = [r for r in before if not WORD.search(r[1] or "")]
        want = [r for r in plain_near([r for r in before if WORD.search(r[1] or "")])]
        assert unique.columns == docs.columns and counted(unique.collect()) == counted(want + blank)

    mixed = settle(by["mixing"](spark, unique, SMALL))
    assert mixed.columns == docs.columns and counted(mixed.collect()) == counted(plain_mix(unique.collect()))

    packed = by["packing"](spark, mixed, SMALL).collect()
    n, least = check_packing(packed, [(r.doc_id, r.text) for r in mixed.collect()])
    assert n <= least + 1


def test_empty_tables_pass_through(spark):
    none = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, SMALL)
        assert out.count() == 0 and (name == "packing" or out.columns == none.columns)


def test_the_whole_pipeline_is_its_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = settle(stage(spark, docs, SMALL))
    want = collections.Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect())
    got = collections.Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, SMALL).collect())
    assert got == want and 0 < len(got)


def test_huge_texts_are_compared_block_by_block(spark):
    """Units that share a key though one of them differs in its second block, in parts of two levels."""
    block = exact_dedup.BLOCK
    same, other = "a" * block + "b" * 10, "a" * block + "c" * 10
    texts = {i: other if i in (3, 8) else same for i in range(10)}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sha = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}
    units = spark.createDataFrame([(i, sha[i], i, f"k/{i % 4}", 4) for i in texts], "doc_id long, text_sha256 string, unit long, key string, parts long")
    root, odd = exact_dedup._huge_classes(rows, units, 2)
    found = {r.unit: r.ref for r in root.collect()}
    alone = {r.unit for r in odd.collect()}
    for i, ref in found.items():  # who has a reference has one of the same text; the others are left to a comparison of whole texts
        assert texts[i] == texts[ref] and (ref != i or i in alone or i == 0)
    assert len({found[i] for i in texts if texts[i] == same and i not in alone}) == 1 and alone
