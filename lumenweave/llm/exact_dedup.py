"""Exact dedup by composable polynomial fingerprints.

The white space of a text is normalised, its UTF-8 bytes are cut into chunks, and each
chunk gets a polynomial hash under three primes. Hashes of neighbours combine:
h(ab) = h(a) * base**len(b) + h(b), so the chunks of a huge document are dealt over tasks
and joined in any grouping. Rows of equal fingerprint and length are then compared chunk by
chunk with the first row of their group, in a stream: a task holds one reference text, and
of a huge document one block, as its blocks meet the reference's in tasks of their own. A
large group is dealt over parts of about GROUP rows; the references of GROUP parts meet in
one part of the next level, and so on to a single part, so no task reads a whole group.

Edge cases: a null text counts as empty; null doc_ids order after all others; of repeated
rows (same id and text) the first one read stays; an empty table gives an empty result;
other columns are not read (the pipeline's stage hands them on, whatever their names).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.llm.common import documents, hidden, map_slices, settle, table

PRIMES = (2147483647, 2147483629, 2147483587)
BASES = (1099511, 977443, 1300751)
CHUNK = 1 << 16
HUGE = 1 << 22
#: Bytes of the blocks in which huge texts are hashed and compared.
BLOCK = CHUNK * 16
GROUP = 512
_SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base**(n-1), ..., base, 1 modulo prime, by doubling."""
    out = np.ones(1, np.uint64)
    step = base % prime
    while len(out) < n:
        out = np.concatenate([out * np.uint64(step) % np.uint64(prime), out])
        step = step * step % prime
    return out[len(out) - n :]


_TABLES = [_powers(b, p, CHUNK) for b, p in zip(BASES, PRIMES, strict=True)]


def chunk_hash(data: bytes) -> tuple[int, ...]:
    """Polynomial hashes of at most CHUNK bytes; each byte counts as its value plus 1."""
    x = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    return tuple(int((x * t[CHUNK - len(x) :]).sum() % np.uint64(p)) for t, p in zip(_TABLES, PRIMES, strict=True))


def combine(left: tuple[int, ...], right: tuple[int, ...], right_len: int) -> tuple[int, ...]:
    return tuple((a * pow(b, right_len, p) + c) % p for a, c, b, p in zip(left, right, BASES, PRIMES, strict=True))


def fingerprint(data: bytes) -> tuple[int, ...]:
    out = (0,) * len(PRIMES)
    for i in range(0, len(data), CHUNK):
        part = data[i : i + CHUNK]
        out = combine(out, chunk_hash(part), len(part))
    return out


def normalised(text: str | None) -> bytes:
    return _SPACE.sub(b" ", (text or "").encode("utf-8", "surrogatepass"))


def _name(h: tuple[int, ...], n: int) -> str:
    return ":".join(map(str, (*h, n)))


def _fingerprint_batches(huge: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for text in rows["text"]:
                data = normalised(text)
                out.append((_name(fingerprint(data), len(data)) if len(data) <= huge else None, hashlib.sha256(data).hexdigest()))
            made = pd.DataFrame(out, columns=["fp", "text_sha256"])
            made.insert(0, "doc_id", rows["doc_id"].array)
            yield made

    return run


def _hash_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = []
        for rid, k, piece in zip(rows["rid"], rows["k"], rows["piece"], strict=True):
            data = bytes(piece)
            out.append((rid, k, len(data), *fingerprint(data)))
        yield pd.DataFrame(out, columns=["rid", "k", "n", "h0", "h1", "h2"])


def _cut(*names: str):
    """Rows of names and text as rows of names, k and piece: each normalised text in blocks, which leave the task one by one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for *own, text in zip(*(rows[n] for n in names), rows["text"], strict=True):
                data = normalised(text)
                for k in range(max(1, -(-len(data) // BLOCK))):
                    yield pd.DataFrame([(*own, k, data[k * BLOCK : (k + 1) * BLOCK])], columns=[*names, "k", "piece"])

    return run


def huge_fingerprints(big: DataFrame) -> DataFrame:
    """big: text_sha256, text. Gives text_sha256, fp of texts whose chunks are hashed in tasks of their own.

    Blocks of equal size are dealt over the tasks and combined in order of their number;
    what meets in one row is 40 bytes a block.
    """
    pieces = big.select(F.col("text_sha256").alias("rid"), "text").mapInPandas(_cut("rid"), "rid string, k int, piece binary").repartition("rid", "k")
    hashed = pieces.mapInPandas(_hash_chunks, "rid string, k int, n long, h0 long, h1 long, h2 long").dropDuplicates(["rid", "k"])
    joined = hashed.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("k", "n", "h0", "h1", "h2"))).alias("blocks"))

    def join_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for rid, blocks in zip(rows["rid"], rows["blocks"], strict=True):
                h, total = (0,) * len(PRIMES), 0
                for b in blocks:
                    h, total = combine(h, (b["h0"], b["h1"], b["h2"]), b["n"]), total + b["n"]
                out.append((rid, _name(h, total)))
            yield pd.DataFrame(out, columns=["rid", "fp"])

    return joined.mapInPandas(join_all, "rid string, fp string").withColumnRenamed("rid", "text_sha256")


def _same(a: bytes, b: bytes) -> bool:
    return len(a) == len(b) and all(a[i : i + CHUNK] == b[i : i + CHUNK] for i in range(0, len(a), CHUNK))


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by key. Each is compared with the reference texts of its key; it joins the first equal one.

    A reference of a group of several parts is passed on with its text, to meet those of the other parts.
    """
    key, refs = None, []
    for rows in batches:
        out = []
        for unit, now, text, parts in zip(rows["unit"], rows["key"], rows["text"], rows["parts"], strict=True):
            data = normalised(text)
            if now != key:
                key, refs = now, []
            ref = next((r for r, d in refs if _same(d, data)), None)
            if ref is None:
                ref = unit
                refs.append((ref, data))
            out.append((unit, ref, now, parts, (text or "") if parts > 1 and ref == unit else None))
        yield pd.DataFrame(out, columns=["unit", "ref", "key", "parts", "text"])


def _with_text(rows: DataFrame, units: DataFrame) -> DataFrame:
    """The text of each unit, found by its id and its digest. units grow with the rows, so they are never broadcast."""
    digest = F.sha2(F.encode(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "), "UTF-8"), 256)
    ids = units.select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"), *(c for c in units.columns if c not in ("doc_id", "text_sha256")))
    return rows.join(ids.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id"))).where(digest == F.col("__sha"))


def _classes(rows: DataFrame) -> DataFrame:
    """rows: unit, key, text, parts. Gives unit, ref: the unit whose text its own was found equal to; and the text of references to compare again."""
    dealt = rows.select("unit", "key", "text", "parts").repartition("key").sortWithinPartitions("key", "unit")
    return map_slices(dealt, _compare, "unit long, ref long, key string, parts long, text string")


def _compare_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces come sorted by key, k and unit; each is compared with the first one of its key and k, which is all that is held."""
    at, ref, piece = None, None, b""
    for rows in batches:
        out = []
        for unit, key, k, data in zip(rows["unit"], rows["key"], rows["k"], rows["piece"], strict=True):
            if at != (key, k):
                at, ref, piece = (key, k), unit, bytes(data)
            out.append((unit, ref, bytes(data) == piece))
        yield pd.DataFrame(out, columns=["unit", "ref", "same"])


def _huge_classes(rows: DataFrame, units: DataFrame, group: int) -> tuple[DataFrame, DataFrame]:
    """units of huge texts. Gives unit, ref as found piece by piece, level by level; and the units that differ from the first of their key, for a comparison of whole texts.

    Blocks of a text go to tasks of their own, where they pass the reference's block in a stream: no task holds two texts.
    """
    root, odd, now = None, None, units
    while True:
        pieces = _with_text(rows, now).select("unit", "key", "text").mapInPandas(_cut("unit", "key"), "unit long, key string, k int, piece binary")
        met = pieces.repartition("key", "k").sortWithinPartitions("key", "k", "unit").mapInPandas(_compare_pieces, "unit long, ref long, same boolean")
        found = settle(met.groupBy("unit").agg(F.min("ref").alias("ref"), F.bool_and("same").alias("same")))
        apart = now.join(found.where("NOT same"), "unit", "left_semi")
        odd = apart if odd is None else odd.unionByName(apart)
        here = found.select("unit", F.when(F.col("same"), F.col("ref")).otherwise(F.col("unit")).alias("ref"))
        root = here if root is None else root.join(here.select(F.col("unit").alias("ref"), F.col("ref").alias("up")), "ref", "left").select("unit", F.coalesce("up", "ref").alias("ref"))
        heads = now.where("parts > 1").join(found.where("same AND unit = ref"), "unit", "left_semi")
        if not heads.limit(1).count():
            return root, odd
        part = F.expr(f"CAST(substring_index(key, '/', -1) AS BIGINT) div {group}")
        heads = heads.withColumn("key", F.concat_ws("/", F.substring_index("key", "/", 1), part)).withColumn("parts", F.expr(f"CAST((parts - 1) div {group} + 1 AS BIGINT)"))
        now = settle(heads)


def _next_level(heads: DataFrame, group: int) -> DataFrame:
    """References of group parts of one level share a part of the next."""
    part = F.expr(f"CAST(substring_index(key, '/', -1) AS BIGINT) div {group}")
    return heads.select("unit", F.concat_ws("/", F.substring_index("key", "/", 1), part).alias("key"), "text", F.expr(f"(parts - 1) div {group} + 1").alias("parts"))


def classes(rows: DataFrame, huge: int = HUGE, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """Marks (doc_id, text_sha256, fp per row) and, of texts that have equals, doc_id, text_sha256, keep_id, keep_sha256, group_size.

    A unit is an id with a text; repeated rows are one unit with a count, so that a row is
    found again by what it holds and not by where it was read.
    """
    marks = settle(map_slices(rows, _fingerprint_batches(huge), "doc_id long, fp string, text_sha256 string"))
    if marks.where(F.col("fp").isNull()).limit(1).count():
        late = huge_fingerprints(_with_text(rows, marks.where("fp IS NULL").select("doc_id", "text_sha256").distinct()).select(F.col("__sha").alias("text_sha256"), "text"))
        late = late.withColumnRenamed("fp", "late")
        marks = settle(marks.join(late, "text_sha256", "left").select("doc_id", F.coalesce("fp", "late").alias("fp"), "text_sha256"))
    sizes = marks.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1")
    units = marks.join(sizes, "fp").groupBy("doc_id", "fp", "text_sha256", "n").agg(F.count("*").alias("rows"))
    parts = F.expr(f"(n - 1) div {group} + 1")
    salt = F.pmod(F.xxhash64("doc_id", "text_sha256"), parts)
    units = settle(units.withColumn("unit", F.monotonically_increasing_id()).withColumn("key", F.concat_ws("/", "fp", salt)))
    # each row with the reference of its part of the group, then level by level the references among themselves; huge texts block by block
    places = units.select("doc_id", "text_sha256", "unit", "key", parts.alias("parts"), (F.substring_index("fp", ":", -1).cast("long") > huge).alias("is_huge"))
    small, blockwise = places.where("NOT is_huge").drop("is_huge"), None
    if places.where("is_huge").limit(1).count():
        blockwise, odd = _huge_classes(rows, places.where("is_huge").drop("is_huge"), group)
        small = settle(small.unionByName(odd))
    found = settle(_classes(_with_text(rows, small)))
    root = found.groupBy("unit").agg(F.min("ref").alias("ref"))
    while found.where("text IS NOT NULL").limit(1).count():
        found = settle(_classes(_next_level(found.where("text IS NOT NULL"), group)))
        up = found.groupBy(F.col("unit").alias("ref")).agg(F.min("ref").alias("root"))
        root = root.join(up, "ref", "left").select("unit", F.coalesce("root", "ref").alias("ref"))
    if blockwise is not None:
        up = root.select(F.col("unit").alias("ref"), F.col("ref").alias("up"))
        root = blockwise.join(up, "ref", "left").select("unit", F.coalesce("up", "ref").alias("ref")).unionByName(root.join(blockwise, "unit", "left_anti"))
    member = units.select("unit", "doc_id", "text_sha256", "rows").join(root, "unit")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "unit")).alias("best")
    kept = member.groupBy("ref").agg(best, F.sum("rows").alias("group_size"))
    found = member.join(kept, "ref").select("doc_id", "text_sha256", "rows", "group_size", F.col("best.doc_id").alias("keep_id"), (F.col("best.unit") == F.col("unit")).alias("keeps"))
    return marks, settle(found)


def dedup(docs: DataFrame, huge: int = HUGE, group: int = GROUP) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256. huge: bytes from which chunks are dealt out; group: rows that one task compares with a reference."""
    marks, found = classes(documents(docs), huge, group)
    once = marks.select("doc_id", "text_sha256")
    unit = found.select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"), "rows", "group_size", "keep_id", "keeps")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_sha256") == F.col("__sha"))
    alone = F.col("group_size").isNull()
    out = once.join(unit.hint("merge"), same, "left").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.col("keeps")).alias("kept"), "text_sha256", F.coalesce("rows", F.lit(1)).alias("rows"),
    )
    if not found.where("rows > 1").limit(1).count():
        return out.drop("rows")
    again = out.where("rows > 1").groupBy("doc_id", "keep_id", "group_size", "kept", "text_sha256", "rows").agg(F.count("*"))
    again = again.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).withColumn("kept", F.col("kept") & (F.col("nth") == 1))
    return out.where("rows = 1").drop("rows").unionByName(again.select(*(c for c in out.columns if c != "rows")))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: of equal texts the row with the smallest doc_id stays."""
    _, found = classes(documents(docs))
    held, own = hidden(docs, "doc_id", "text")
    gone = found.where("NOT keeps OR rows > 1").select(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_sha"), "keeps")
    digest = F.sha2(F.encode(F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " "), "UTF-8"), 256)
    out = held.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("gone_id")) & (digest == F.col("gone_sha")), "left")
    stay = out.where("gone_sha IS NULL").select(*own)
    if not found.where("rows > 1 AND keeps").limit(1).count():
        return stay
    return stay.unionByName(out.where("keeps").dropDuplicates(["gone_id", "gone_sha"]).select(*own))


QUERIES = {"op7_exact_dedup": op7_exact_dedup}
SQL = {
    "op7_exact_dedup": r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
h AS (SELECT doc_id, sha256(norm) AS text_sha256 FROM t),
g AS (SELECT *, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
}
