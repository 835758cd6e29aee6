import collections
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenweave.llm import exact_dedup, html_tree, jpeg, license_scan, lm_score, media, minhash_dedup, mixing, packing, registry, resharding, toxicity
from lumenweave.llm.components import roots
from lumenweave.llm.shingles import set_name, shingle_sets, word_hashes
from tests.conftest import SMALL
from tests.oracle import spark_rows, sql_rows

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
ODD = [(1, "same text here", "s"), (1, "same text here", "s"), (2, None, None), (3, "", "s"), (4, " \n\t ", "t"), (None, "same  text here", "s"), (5, "x" * 300_000, "t"), (6, "é中" * 50, "t"), (7, "same text\nhere", None)]
SCHEMA = "doc_id long, text string, source string"


def odd(spark):
    """Nulls, blanks, repeats, long texts, and columns that operators use inside."""
    rows = spark.createDataFrame(ODD, SCHEMA)
    return rows.withColumns({"size": F.lit(1), "uid": F.lit(2), "h": F.lit("x"), "key": F.lit("k"), "rows": F.lit(0), "score": F.lit(1.0), "length": F.lit(5)})


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_its_sql(spark, name):
    names, rows = spark_rows(registry.queries()[name](spark, SMALL))
    assert (names, rows) == sql_rows(registry.oracle_sql()[name], SMALL)


# packing


def check_packing(rows, texts):
    """rows of pack_documents beside ids made text by text; texts: list of (doc_id, text)."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_file())
    want = collections.Counter()
    for doc, text in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[(doc, k // 4096, k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = collections.defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for spans in held.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 4096
    return len(held), -(-sum(r.length for r in rows) // 4096)


def test_packing_is_whole_and_tight(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    n, least = check_packing(packing.pack_documents(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert n <= least + 1


def test_packing_of_odd_rows(spark):
    check_packing(packing.pack_documents(odd(spark)).collect(), [(d, t) for d, t, _ in ODD])
    assert packing.pack_documents(odd(spark).limit(0)).count() == 0


def test_packed_ids_are_the_texts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(20)
    plan = packing.pack_documents(docs)
    got = {r.sequence_id: r.ids for r in packing.sequences(docs, plan).collect()}
    for r in plan.collect():
        ids = got[r.sequence_id][r.offset : r.offset + r.length]
        assert zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)) == r.ids_crc32


def test_crossover_keeps_every_item_once():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 4096, 300).tolist()
    order = list(range(300))
    one, other = packing.Bins(lengths, 4096).best_fit(order), packing.Bins(lengths, 4096).best_fit(order[::-1])
    for _ in range(20):
        child = packing.crossover(one, other, rng)
        assert sorted(i for b in child.bins for i in b) == order
        assert all(sum(lengths[i] for i in b) == f <= 4096 for b, f in zip(child.bins, child.fills, strict=True))
        assert packing.Bins.of(lengths, 4096, child.places()).fitness() == pytest.approx(child.fitness())
        one, other = other, child


def test_evolution_beats_or_meets_best_fit():
    lengths = [1500, 1400, 1196] * 20 + [2048] * 11 + [700] * 13
    first = packing.Bins(lengths, 4096).best_fit(sorted(range(len(lengths)), key=lambda i: -lengths[i]))
    best = packing.evolve(lengths, 4096, [], np.random.default_rng(2), children=60)
    assert len(best.bins) <= len(first.bins)


# mixing


def test_mix_meets_its_targets(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(0, 30)), rng.choice(["a", "b", "c", None])) for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), per_bucket=200).collect()
    taken = collections.Counter()
    targets = {}
    for r in got:
        taken[r.target] += r.taken
        targets[r.target] = r.source_size
        assert r.taken <= 2 * r.size
    total = sum(r.size for r in got)
    assert abs(sum(taken.values()) - 1.5 * total) < 60
    for t, size in targets.items():
        assert abs(taken[t] - t) < 120 and t <= 2 * size


def test_mix_of_odd_rows(spark):
    got = mixing.mix(odd(spark).select("doc_id", "text", "source", "size", "h")).collect()
    assert len(got) == len(ODD)
    assert mixing.mix(odd(spark).limit(0)).count() == 0
    kept = mixing.stage(spark, odd(spark), "")
    assert kept.columns == odd(spark).columns


# media


def test_jpeg_round_trips():
    rng = random.Random(5)
    cases = [b"", b"\0", b"a", bytes(range(256)), bytes(64), b"\xff" * 130, bytes(63) + b"\1", b"\1" + bytes(70) + b"z"]
    cases += [bytes(rng.choice([0, 0, 0, 255, 65, 200]) for _ in range(rng.randrange(300))) for _ in range(100)]
    stored = [jpeg.encode(jpeg.pad(c)) for c in cases]
    frames = [jpeg.Frame(f) for f in stored]
    for c, frame, coefs in zip(cases, frames, jpeg.coefficients(stored, frames), strict=True):
        assert jpeg.payload(frame, coefs) == jpeg.pad(c)


def colour_file(across, down, values, restart=0):
    """A three-component file with 2 x 2 sampling by a plain bit writer: values[mcu][unit] is a list of 64 coefficients in zigzag order."""
    bits = []
    out = b""

    def put(code, n):
        bits.extend((code >> (n - 1 - i)) & 1 for i in range(n))

    def flush():
        nonlocal out
        while len(bits) % 8:
            bits.append(1)
        data = bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8))
        out += data.replace(b"\xff", b"\xff\x00")
        bits.clear()

    before, k = [0, 0, 0], 0
    for m, mcu in enumerate(values):
        if restart and m and m % restart == 0:
            flush()
            out += bytes([0xFF, 0xD0 + k % 8])
            k, before = k + 1, [0, 0, 0]
        for part, block in zip([0, 0, 0, 0, 1, 2], mcu, strict=True):
            low, size = jpeg._bits(block[0] - before[part])
            before[part] = block[0]
            put(*jpeg.DC_TABLE.code[size])
            put(low, size) if size else None
            run, last = 0, max((i for i in range(64) if block[i]), default=0)
            for v in block[1 : last + 1]:
                if v == 0:
                    run += 1
                    continue
                while run > 15:
                    put(*jpeg.AC_TABLE.code[0xF0])
                    run -= 16
                low, size = jpeg._bits(v)
                put(*jpeg.AC_TABLE.code[run << 4 | size])
                put(low, size)
                run = 0
            if last < 63:
                put(*jpeg.AC_TABLE.code[0])
    flush()
    seg = jpeg._segment
    head = b"\xff\xd8" + seg(0xFE, b"a comment") + seg(jpeg.DQT, bytes([0] + [8] * 64)) + seg(jpeg.SOF0, struct.pack(">BHHB", 8, down * 16, across * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    head += seg(jpeg.DHT, jpeg.DC_TABLE.segment(0, 0) + jpeg.AC_TABLE.segment(1, 0)) + (seg(jpeg.DRI, struct.pack(">H", restart)) if restart else b"")
    return head + seg(jpeg.SOS, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + out + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 2])
def test_colour_scans_are_decoded(restart):
    rng = random.Random(6)
    blocks = [[[rng.choice([0, 0, 3, -90])] + [rng.choice([0] * 9 + [1, -7, 100]) for _ in range(63)] for _ in range(6)] for _ in range(6)]
    blocks[2][1][1:] = [0] * 63
    data = colour_file(3, 2, blocks, restart)
    frame = jpeg.Frame(data)
    got = jpeg.coefficients([data], [frame])[0]
    assert got.reshape(6, 6, 64).tolist() == blocks
    image = jpeg.thumbnail(frame, got)
    assert image.shape == (4, 6)
    assert image[0, 0] == np.clip(round(blocks[0][0][0] * 8 / 8 + 128), 0, 255) and image[1, 2] == np.clip(blocks[1][2][0] + 128, 0, 255)


def test_media_of_odd_rows(spark):
    got = media.scan(media.store(odd(spark))).collect()
    want = collections.Counter()
    for d, t, _ in ODD:
        raw = (t or "").encode()
        p = raw + b"\0" * (64 if not raw else -len(raw) % 64)
        want[(d, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))] += 1
    assert collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert media.scan(media.store(odd(spark).limit(0))).count() == 0


def test_media_table_is_stored_and_read_again(spark, tmp_path):
    stored = media.write_media(odd(spark), str(tmp_path / "media"))
    assert stored.columns == ["doc_id", "n_bytes", "media"] and "Scan parquet" in stored._jdf.queryExecution().executedPlan().toString().replace("FileScan", "Scan")
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_bytes, r.payload_sha256, r.media_sha256, r.average_hash)
    assert sorted(map(key, media.scan(stored).collect())) == sorted(map(key, media.scan(media.store(odd(spark))).collect()))


def test_files_that_are_no_jpeg(spark):
    good = jpeg.encode(jpeg.pad(b"fine"))
    rows = [(1, 1, bytearray(b"GIF89a")), (2, 1, None), (3, 1, bytearray(good[:-70])), (4, 4, bytearray(good)), (5, 1, bytearray(b""))]
    got = {r.doc_id: r for r in media.scan(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert got[4].error is None and got[4].payload_bytes == 64
    assert all(got[i].error and got[i].average_hash is None for i in (1, 2, 3, 5))


# toxicity


def test_toxicity_learns_on_other_folds(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(1200):
        bad = rng.random() < 0.12
        words = prose(rng, 60).split()
        if bad:
            for k in range(3):
                words[rng.randrange(60)] = rng.choice(["vilework", "grimtalk", "foulish"])
        rows.append((i, " ".join(words), "s"))
        if i % 2:
            labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    truth = {i: any(w in t for w in ("vilework", "grimtalk", "foulish")) for i, t, _ in rows}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i] >= toxicity.THRESHOLD) == truth[i] for i in held]) > 0.97
    again = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, marks)).collect()}
    assert again == got


def test_nnpu_separates_unlabelled():
    rng = np.random.default_rng(8)
    p = rng.normal(2, 1, (300, 2))
    u = np.concatenate([rng.normal(2, 1, (200, 2)), rng.normal(-2, 1, (800, 2))])
    net = toxicity.fit_nnpu(p, u, 0.2, 0, steps=400)
    assert (net(u[:200]) > 0).mean() > 0.9 and (net(u[200:]) < 0).mean() > 0.95


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, None), (99, 1), (None, 1)], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score(odd(spark), toxicity.train(odd(spark), labels)).collect()] == [0.0] * len(ODD)
    some = spark.createDataFrame([(1, 1), (3, 0), (4, 0), (5, 0), (5, 1)], "doc_id long, toxic int")
    got = toxicity.score(odd(spark), toxicity.train(odd(spark), some), ("source",)).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(odd(spark).limit(0), toxicity.train(odd(spark).limit(0), labels)).count() == 0


# language-model scoring


def test_lm_losses_equal_plain_counts(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randint(0, 12)), "s") for i in range(40)] + [(None, "alpha beta", "s"), (41, None, "s")]
    good = {i for i in range(0, 40, 3)}
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i in good)) for i in range(40)], "doc_id long, quality int")
    got = {r.doc_id: r for r in lm_score.score(docs, lm_score.count(docs, labels, slots=1 << 20)).collect()}
    ids = {d: [int(x) for x in np.frombuffer(b, "<u4")[:-1]] for d, b in zip([r[0] for r in rows], lm_score.id_bytes([r[1] or "" for r in rows], lm_score.tokenizer_file()), strict=True)}
    for k, members in (("target_loss", good), ("background_loss", set(ids))):
        one, two, ctx = collections.Counter(), collections.Counter(), collections.Counter()
        for d in members:
            for a, b in zip([lm_score.IDS, *ids[d]], ids[d], strict=False):
                two[a, b] += 1
                one[b] += 1
            ctx.update(([lm_score.IDS] if ids[d] else []) + ids[d])
        total = sum(one.values())
        for d, seq in ids.items():
            if seq:
                p = [0.7 * min(two[a, b] / max(ctx[a], 1), 1) + 0.3 * (one[b] + 0.5) / (total + 0.5 * lm_score.IDS) for a, b in zip([lm_score.IDS, *seq], seq, strict=False)]
                assert got[d][k] == pytest.approx(-np.log(p).mean(), rel=1e-3)
    assert got[41].score is None and got[41].n_tokens == 0


def test_lm_scores_do_not_depend_on_slots(spark):
    rng = random.Random(91)
    docs = spark.createDataFrame([(i, prose(rng, 120)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    few, many = ({r.doc_id: (r.target_loss, r.background_loss, r.score) for r in lm_score.score(docs, lm_score.count(docs, labels, slots=n)).collect()} for n in (64, 1 << 20))
    assert few.keys() == many.keys() and all(few[d] == pytest.approx(many[d], abs=1e-9) for d in few)


def test_lm_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1)], "doc_id long, quality int")
    m = lm_score.count(odd(spark), labels, slots=1 << 16)
    assert lm_score.score(odd(spark), m).count() == len(ODD)
    assert lm_score.score(odd(spark).limit(0), lm_score.count(odd(spark).limit(0), labels, slots=1 << 16)).count() == 0


def test_rewrite_leaves_unaffected_shards_and_drops_emptied_ones(spark, tmp_path):
    path = str(tmp_path / "live")
    old = [(i, f"text {i}", i % 4) for i in range(20)]
    spark.createDataFrame([(*r, 0) for r in old], "doc_id long, text string, shard int, slot long").write.partitionBy("shard").parquet(path)
    new = [(i, s, {3: 0}.get(s, s), i) for i, _, s in old]  # shard 3 goes into shard 0; 1 and 2 stay
    plan = spark.createDataFrame(new, "doc_id long, old_shard int, shard int, slot long")
    got = resharding.rewrite_affected(spark.read.parquet(path), plan, path)
    assert sorted(r.shard for r in got.collect()) == [0, 3]
    rows = spark.read.parquet(path).select("doc_id", "text", "shard").collect()
    assert sorted(map(tuple, rows)) == sorted((i, f"text {i}", {3: 0}.get(s, s)) for i, _, s in old)
    assert not (tmp_path / "live" / "shard=3").exists()


# near duplicates


def plain_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [plain_set(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    ids = collections.defaultdict(list)
    for i in range(len(rows)):
        ids[find(i)].append(rows[i][0])
    return [(rows[i][0], len(sets[i]), min((d for d in ids[find(i)] if d is not None), default=None) if sets[i] else rows[i][0]) for i in range(len(rows))]


def near_rows(seed=10):
    rng = random.Random(seed)
    base, rows = [prose(rng, rng.randint(3, 80)).split() for _ in range(25)], []
    for i in range(260):
        w = list(base[i % 25] if i % 3 else base[0])
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = rng.choice(WORDS) + str(rng.randrange(50))
        rows.append((i * 7 % 263, " ".join(w).title() if i % 5 == 0 else "\n".join(w)))
    return rows + [(900, None), (901, ""), (902, " \t"), (5, rows[0][1]), (None, rows[3][1]), (None, "only one"), (903, "one two"), (904, "ONE two")]


@pytest.mark.parametrize("crowd", [24, 3])
def test_near_duplicates_equal_brute_force(spark, crowd, monkeypatch):
    monkeypatch.setattr(minhash_dedup.candidates, "__defaults__", (crowd,))
    rows = near_rows()
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(brute_components(rows), key=key)
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got)


def form_rows(n=600, pairs=200):
    """Texts that share a form (similarity 0.69, so no link); the first ones are in pairs that share some more (0.76)."""
    form = [f"form{k}" for k in range(100)]
    return [(i, " ".join(form + [f"p{i // 2 if i < 2 * pairs else i}_{k}" for k in range(6)] + [f"own{i}_{k}" for k in range(16)])) for i in range(n)]


def test_near_duplicates_of_a_form_equal_brute_force(spark):
    rows = form_rows()
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_components(rows))
    assert sum(not r.kept for r in got) == 200


def test_near_duplicate_stage_keeps_one_a_group(spark):
    docs = odd(spark)
    out = minhash_dedup.stage(spark, docs, "").collect()
    assert minhash_dedup.stage(spark, docs.limit(0), "").count() == 0
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == [(False, i) for i in (1, 2, 3, 4, 5, 6)]


def test_shingles_are_those_of_words():
    rng = random.Random(11)
    texts = [prose(rng, n) for n in range(12)] + ["A b\x0bC\td  e f", "É É É É É É", None, "x" * 3_000_000 + " y"]
    for t, s in zip(texts, shingle_sets(texts), strict=True):
        assert len(s) == len(plain_set(t))
    a, b = list(shingle_sets(["ONE two three four five six", "one TWO three\nfour five six"]))
    assert set_name(a) == set_name(b) and len(word_hashes(b"a b  c")[0]) == 3


def test_components_of_any_links(spark):
    rng = random.Random(12)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7)]
    got = {r.node: r.root for r in roots(spark.createDataFrame(pairs, "a long, b long")).collect()}
    near = collections.defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    for node, root in got.items():
        seen, todo = {node}, [node]
        while todo:
            todo += [x for x in near[todo.pop()] if x not in seen and not seen.add(x)]
        assert root == min(seen)
    assert set(got) == {x for p in pairs if p[0] != p[1] for x in p}
    assert roots(spark.createDataFrame([], "a long, b long")).count() == 0


# exact duplicates


def test_exact_duplicates_of_odd_rows_and_large_groups(spark):
    rows = [(i, ["a b", "a  b", "c", None, ""][i % 5]) for i in range(60)] + [(3, "c"), (None, "a b"), (70, "z" * 5000), (71, "z" * 5000)]
    got = exact_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), huge=1000, group=4).collect()
    assert len(got) == len(rows)
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(d)
    for r in got:
        members = next(g for n, g in groups.items() if hashlib.sha256(n.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(members) and r.keep_id == min(d for d in members if d is not None)
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert exact_dedup.stage(spark, odd(spark), "").count() == 5


def test_huge_texts_of_several_blocks_and_columns_that_clash(spark):
    block = exact_dedup.CHUNK * 16
    long = "".join(chr(97 + i * i % 23) for i in range(1000)) * (2 * block // 1000 + 70)  # three blocks
    other = long[:-1] + ("a" if long[-1] != "a" else "b")
    rows = [(1, long, "x", 1), (2, other, "x", 1), (3, long.replace("a", "a", 1), "y", 2), (4, "short", "z", 3), (5, "short", "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, unit long").withColumnsRenamed({"fp": "text_sha256", "unit": "ref"})
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.dedup(docs, huge=1 << 20).collect()}
    assert got == {1: (1, 2), 2: (2, 1), 3: (1, 2), 4: (4, 2), 5: (4, 2)}
    kept = exact_dedup.stage(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 4]


def test_large_groups_meet_over_several_levels(spark):
    rows = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "other").otherwise("same").alias("text"))
    got = exact_dedup.dedup(rows, group=3).collect()  # 250 parts, 84, 28, 10, 4, 2, 1
    assert len(got) == 1000 and {(r.keep_id, r.group_size) for r in got} == {(0, 250), (1, 750)} and sum(r.kept for r in got) == 2


def test_fingerprints_combine_in_any_grouping():
    rng = random.Random(13)
    for _ in range(20):
        data = bytes(rng.randrange(256) for _ in range(rng.randrange(1, 3000)))
        cut = rng.randrange(len(data) + 1)
        a, b = (exact_dedup.fingerprint(x) for x in (data[:cut], data[cut:]))
        assert exact_dedup.combine(a, b, len(data) - cut) == exact_dedup.fingerprint(data)
    one, other = b"a" * 70_000, b"a" * 69_999 + b"b"
    assert exact_dedup.fingerprint(one) != exact_dedup.fingerprint(other)


# resharding


def test_reshard_is_even_and_gapless(spark):
    rng = random.Random(14)
    rows = [(i, "y" * rng.choice([0, 5, 40, 100, 3000]), "s") for i in range(2000)]
    got = resharding.reshard(spark.createDataFrame(rows, SCHEMA), per_bucket=100).collect()
    assert len(got) == 2000
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    sizes = [sum(r.size for r in by[s]) for s in range(40)]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in got)
    for members in by.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))


def test_flow_is_cheapest():
    rng = random.Random(15)
    for _ in range(30):
        n = rng.randint(1, 4)
        supply = [rng.randint(0, 6) for _ in range(n)]
        capacity = resharding.even(sum(supply), rng.randint(1, 5))
        flow = resharding.min_cost_flow(supply, capacity, resharding.stay_or_move)
        for i, s in enumerate(supply):
            assert sum(v for (a, _), v in flow.items() if a == i) == s
        for j, c in enumerate(capacity):
            assert sum(v for (_, b), v in flow.items() if b == j) == c
        stays = sum(min(s, capacity[i]) for i, s in enumerate(supply) if i < len(capacity))
        assert sum(v for (a, b), v in flow.items() if a == b) == stays


def test_reshard_of_odd_rows(spark):
    assert resharding.reshard(odd(spark)).count() == len(ODD)
    assert resharding.reshard(odd(spark).limit(0)).count() == 0


# pages


def test_pages_of_all_kinds():
    m = html_tree.trained()
    page = '<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><div class="ad">Buy this now.</div><article><h1>Head &amp; more</h1><p>First <b>bo</b>ld\n text<br>here.<p>Second&nbsp;one.</p><form>f</form><aside>side</aside></article><div id="comments"><p>A reader comment that is long enough to look like prose, really.</p></div><footer>&copy; x</footer></body></html>'
    assert html_tree.main_texts([page, None, "", "  ", "just text", "<p>open <i>tag"], m) == ["Head & more First bold text here. Second one.", "", "", "", "just text", "open tag"]


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(16)
    parent = np.array([-1, 0, 0, 1, 1, -1])
    node, edge = rng.normal(size=(6, 2)), rng.normal(size=(6, 2, 2))
    belief, pair, z = html_tree.marginals(html_tree.Forest(parent), node, edge)
    total, want = 0.0, np.zeros((6, 2))
    for code in range(64):
        y = [(code >> i) & 1 for i in range(6)]
        w = np.exp(sum(node[i, y[i]] for i in range(6)) + sum(edge[i, y[parent[i]], y[i]] for i in range(6) if parent[i] >= 0))
        total += w
        for i in range(6):
            want[i, y[i]] += w
    assert np.allclose(belief, want / total) and np.isclose(z, np.log(total))
    assert np.allclose(pair[1].sum(0), belief[1])


def test_held_out_layouts():
    m, wrong, n = html_tree.trained(), 0, 0
    for page in html_tree.labelled_pages(40, seed=99):
        nodes, _ = html_tree.parse(page)
        x, never = html_tree.describe(nodes)
        parent = np.array([k.parent for k in nodes])
        belief, _, _ = html_tree.marginals(html_tree.Forest(parent), *m.potentials(parent, x, never))
        for k, p in zip(nodes, belief[:, 1], strict=True):
            if k.text:
                n += 1
                wrong += ("xcontent" in k.names) != (p > 0.5)
    assert wrong / n < 0.03


def test_pages_table(spark):
    rows = [(1, "u", "<p>x</p>"), (1, "u", "<p>x</p>"), (None, None, None)]
    got = html_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("t"))).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "", 0), (1, "x", 1), (1, "x", 1)]


# licences


def test_known_licences_are_found_in_any_spelling(spark):
    mit = next(t for i, t in license_scan.KNOWN if i == "MIT")
    rows = [(1, mit), (2, "Copyright (c) 2020 Me\n" + mit.upper().replace(",", " ;")), (3, "x " + mit), (4, None), (5, ""), (6, "... --"), (None, mit)]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), license_scan.catalogue(spark)).collect()}
    assert [got[i].license_id for i in (1, 2, 3, 4, 5, 6, None)] == ["MIT", "MIT", None, None, None, None, "MIT"]


def test_pipeline_runs_every_stage(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns[:4] == ["doc_id", "piece", "start", "length"] and out.count() > 0
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, f in corpus_pipeline.STAGES[:-1]:
        docs = f(spark, docs, SMALL)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == 0


def test_wanted_features_are_counted_as_all_are():
    from collections import Counter
    from types import SimpleNamespace

    import pandas as pd

    from lumenweave.llm import toxicity as X

    texts = [None, "", "Über-alle x9y %% abcdefgh abcdefg", *(f"word{n % 7} wor{n % 30}d, café{n}s plainest plainer" for n in range(300)), *["common " * 40] * 5]
    rows = pd.DataFrame({"text": texts})
    every = pd.concat(X._features()(iter([rows]))).groupby("feature")["n"].sum()
    wanted = frozenset(f for i, f in enumerate(sorted(every.index)) if f and i % 3)
    got = pd.concat(X._wanted_features(SimpleNamespace(value=wanted))(iter([rows[:100], rows[100:]]))).set_index("feature")["n"]
    assert got.to_dict() == {f: n for f, n in every.items() if f in wanted or not f}
    evidence = {f: (i * 37 % 300) / 100 for i, f in enumerate(sorted(wanted))}
    describe, plain = X.Describer(evidence), lambda w: max((evidence.get(f, 0.0) for f in X.features(w)), default=0.0)
    for text in texts:
        n = Counter((text or "").lower().split())
        top = sorted((e for e in map(plain, n) if e > X.LEVELS[2]), reverse=True)[:3]
        assert describe(text)[:3] == [*top, 0.0, 0.0, 0.0][:3]
        assert describe(text)[-1] == float(not n)
