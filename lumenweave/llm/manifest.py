"""A Merkle manifest of a table, and a proof of every row against its root.

Leaves are digests of whole rows. The leaves of a group (here: of a language) stand in
order; each two neighbours become their common digest, level by level, up to one subroot,
and the subroots become the root in the same way.

Bottom-up, a pass groups the nodes of a level into blocks of 2**STEP neighbours and climbs
STEP levels in each (as many as are left, where a group fits one block); its levels are
written as a table, and the blocks' tops are the nodes of the next pass. Top-down, each
persisted level joins its parents: a child prepends its own siblings to the suffix of the
proof that its parent inherited. A block is the most that meets in a row, however large the
group is. All of it is DataFrame functions.

Edge cases: a null field counts as `-`; null languages are a group of their own, first in
order; null doc_ids come first, are never tampered with, and rows of one doc_id are ordered
by their digests; repeated rows are leaves of their own; a group of one row has its leaf for
a subroot, and of a single group the subroot is the root; the only row of a table has no
siblings, so its proof is the digest of nothing; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenweave.llm.common import settle, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that one pass climbs: a block holds 2**STEP nodes.
STEP = 8
#: Rows of a range of leaves.
PER_RANGE = 200_000
TAMPER = 7


def field(c: Column) -> Column:
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame, fields=FIELDS, group: str = "lang", key: str = "doc_id", tamper: int = TAMPER) -> DataFrame:
    """key, grp, leaf, and in bad the leaf of a row that is tampered with (null for the others)."""
    whole = digest(*(field(F.col(c)) for c in fields))
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(21,0)")
    other = digest(*(field(more if c == "n_chars" else F.col(c)) for c in fields))
    hit = F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % tamper == 0
    return docs.select(F.col(key).alias("key"), F.col(group).cast("string").alias("grp"), whole.alias("leaf"), F.when(hit, other).alias("bad"))


def placed(rows: DataFrame, group: list[str], order: list[str], per_range: int = PER_RANGE) -> tuple[DataFrame, DataFrame]:
    """rows with pos, their place (from 0) in the group, and run; and (group, run, before, n) of the ranges.

    Rows are dealt by range and written in order, so places follow from the sizes of the
    ranges; a group of any size lies in as many ranges as it needs.
    """
    n = rows.count()
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())  # equal rows may lie in several ranges
    dealt = tied.repartitionByRange(max(1, -(-n // per_range)), *group, *order, "__tie").sortWithinPartitions(*group, *order).drop("__tie")
    held = settle(dealt.withColumn("__at", F.monotonically_increasing_id()))
    held = held.withColumn("run", F.shiftright("__at", 33))
    runs = held.groupBy(*group, "run").agg(F.min("__at").alias("__first"), F.count("*").alias("n"))
    before = Window.partitionBy(*group).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = settle(runs.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))))
    start = runs.select(*(F.col(c).alias(f"__{c}") for c in group), F.col("run").alias("__run"), "__first", "before")
    same = F.col("run") == F.col("__run")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    out = held.join(start, same).withColumn("pos", F.col("before") + F.col("__at") - F.col("__first"))
    return out.select(*rows.columns, "pos"), runs


def _parents(level: Column) -> Column:
    """Digests of each two neighbours; of the last one alone where it has none."""
    pairs = F.sequence(F.lit(0), ((F.size(level) - 1) / 2).cast("int"))
    return F.transform(pairs, lambda i: digest(F.get(level, 2 * i), F.coalesce(F.get(level, 2 * i + 1), F.lit(""))))


def _levels(first: Column, height: Column) -> Column:
    """The level first and the height levels above it."""
    kind = "array<array<string>>"
    start = F.array(first).cast(kind)
    climbed = F.aggregate(F.sequence(F.lit(1), F.greatest(height, F.lit(1))), start, lambda acc, _: F.concat(acc, F.array(_parents(F.element_at(acc, -1)))).cast(kind))
    return F.when(height == 0, start).otherwise(climbed)


def _height(n: Column) -> Column:
    """Levels above n nodes, up to one."""
    return F.when(n <= 1, F.lit(0)).otherwise(F.length(F.bin(n - 1)))


def climb(nodes: DataFrame, step: int = STEP) -> list[DataFrame]:
    """nodes: grp (long), n (nodes of the group), pos, digest, item. The persisted passes, bottom first: grp, block, n, run (pos, digest, item), levels, top."""
    passes = []
    while True:
        run = F.sort_array(F.collect_list(F.struct("pos", "digest", "item")))  # at most 2**step
        block = nodes.groupBy("grp", "n", F.shiftright("pos", step).alias("block")).agg(run.alias("run"))
        block = block.withColumn("levels", _levels(F.transform("run", lambda x: x["digest"]), F.least(F.lit(step), _height(F.col("n")))))
        passes.append(settle(block.withColumn("top", F.element_at(F.element_at("levels", -1), 1))))
        up = passes[-1].where(F.col("n") > 1 << step)
        if not up.limit(1).count():
            return passes
        nodes = up.select("grp", F.expr(f"(n - 1) div {1 << step} + 1").alias("n"), F.col("block").alias("pos"), F.col("top").alias("digest"), F.lit(None).cast("long").alias("item"))


def tops(passes: list[DataFrame], step: int = STEP) -> DataFrame:
    """grp, top: the one digest that is left of each group."""
    out = None
    for p in passes:
        here = p.where(F.col("n") <= 1 << step).select("grp", "top")
        out = here if out is None else out.unionByName(here)
    return out


def _path(levels: Column, i: Column, suffix: Column) -> Column:
    """The siblings of the i-th node of a block, then those of its ancestors: l left of the path, r right of it, one of them empty."""

    def sibling(level: Column, depth: Column) -> Column:
        at = F.call_function("shiftright", i, depth)
        other = F.coalesce(F.get(level, at.bitwiseXOR(F.lit(1))), F.lit(""))
        left = at % 2 == 1
        return F.struct(F.when(left, other).otherwise("").alias("l"), F.when(left, "").otherwise(other).alias("r"))

    own = F.transform(F.slice(levels, 1, F.size(levels) - 1), sibling)
    return F.concat(own, suffix)


def push(passes: list[DataFrame], suffixes: DataFrame, step: int = STEP) -> DataFrame:
    """The lowest pass with the suffix that each block inherits. suffixes: grp, suffix of the group's top, and columns that are handed down as they are."""
    above, same = None, [c for c in suffixes.columns if c not in ("grp", "suffix")]
    for p in reversed(passes):
        ends = p.where(F.col("n") <= 1 << step).join(suffixes, "grp")
        if above is not None:
            ends = ends.unionByName(p.where(F.col("n") > 1 << step).join(above, ["grp", "block"]))
        if p is passes[0]:
            return ends
        children = F.transform("run", lambda x, i: F.struct(x["pos"].alias("block"), _path(F.col("levels"), i, F.col("suffix")).alias("suffix")))
        above = settle(ends.select("grp", *same, F.explode(children).alias("c")).select("grp", *same, "c.*"))


def proofs(passes: list[DataFrame], suffixes: DataFrame, step: int = STEP) -> DataFrame:
    """grp, pos, digest, item and path of every node of the lowest level."""
    each = F.transform("run", lambda x, i: F.struct(x["pos"].alias("pos"), x["digest"].alias("digest"), x["item"].alias("item"), _path(F.col("levels"), i, F.col("suffix")).alias("path")))
    return push(passes, suffixes, step).select("grp", F.explode(each).alias("c")).select("grp", "c.*")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda acc, s: digest(s["l"], acc, s["r"]))


def manifest(docs: DataFrame, fields=FIELDS, group: str = "lang", key: str = "doc_id", tamper: int = TAMPER, step: int = STEP, per_range: int = PER_RANGE) -> DataFrame:
    """Per row: key, leaf, subroot, root, proof_sha256, folded_root, verified."""
    base, runs = placed(settle(leaves(docs, fields, group, key, tamper)), ["grp"], ["key", "leaf"], per_range)
    groups = runs.groupBy("grp").agg(F.sum("n").alias("n"))
    named, _ = placed(groups, [], ["grp"], per_range)
    named = settle(named.withColumnRenamed("pos", "no"))
    own = named.select(F.col("grp").alias("__grp"), "no", "n")
    nodes = base.join(own, F.col("grp").eqNullSafe(F.col("__grp")))
    nodes = nodes.select(F.col("no").alias("grp"), "n", "pos", F.col("leaf").alias("digest"), F.struct("key", "bad").alias("item"))
    passes = climb(nodes, step)
    subroots = settle(tops(passes, step))
    n = subroots.count()
    over = climb(subroots.select(F.lit(0).cast("long").alias("grp"), F.lit(n).cast("long").alias("n"), F.col("grp").alias("pos"), F.col("top").alias("digest"), F.lit(None).cast("long").alias("item")), step)
    none = F.array().cast("array<struct<l:string,r:string>>")
    root = tops(over, step).first()
    root = root["top"] if root is not None else None
    start = docs.sparkSession.range(1).select(F.lit(0).cast("long").alias("grp"), none.alias("suffix"))
    suffixes = proofs(over, start, step).select(F.col("pos").alias("grp"), F.col("digest").alias("subroot"), F.col("path").alias("suffix"))
    each = lambda x, i: F.struct(x["item"]["key"].alias("key"), x["item"]["bad"].alias("bad"), x["digest"].alias("leaf"), _path(F.col("levels"), i, F.col("suffix")).alias("path"))

    def proven(x: Column) -> Column:
        said = digest(F.array_join(F.transform(x["path"], lambda s: F.concat(s["l"], s["r"])), ""))
        return F.struct(x["key"].alias(key), x["leaf"].alias("leaf"), said.alias("proof_sha256"), folded(F.coalesce(x["bad"], x["leaf"]), x["path"]).alias("folded_root"))

    lowest = push(passes, suffixes, step)
    out = lowest.select("subroot", F.explode(F.transform(F.transform("run", each), proven)).alias("c"))
    return out.select(f"c.{key}", "c.leaf", "subroot", F.lit(root).alias("root"), "c.proof_sha256", "c.folded_root", (F.col("c.folded_root") == F.lit(root)).alias("verified"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


QUERIES = {"op12_manifest": op12_manifest}
_PART = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
SQL = {
    "op12_manifest": f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, sha256({" || ".join(_PART.format(c) for c in FIELDS)}) AS leaf,
    sha256({" || ".join(_PART.format("(n_chars + 1)" if c == "n_chars" else c) for c in FIELDS)}) AS other,
    list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
        lambda s, b: list_reduce(list_prepend(xor(s, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))) AS crc
  FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, xor(crc, 4294967295) % {TAMPER} = 0 AS bad FROM d),
low AS (SELECT lang, 0 AS lvl, list(leaf ORDER BY pos) AS nodes FROM p GROUP BY lang
  UNION ALL SELECT lang, lvl + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM low WHERE len(nodes) > 1),
s AS (SELECT lang, nodes[1] AS subroot, lvl AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS no FROM low WHERE len(nodes) = 1),
top AS (SELECT 0 AS lvl, list(subroot ORDER BY no) AS nodes FROM s
  UNION ALL SELECT lvl + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM top WHERE len(nodes) > 1),
walk AS (SELECT p.lang, p.pos, low.lvl AS hgt, p.pos >> low.lvl AS i, low.nodes[xor(p.pos >> low.lvl, 1) + 1] AS sib FROM p JOIN low ON p.lang IS NOT DISTINCT FROM low.lang WHERE len(low.nodes) > 1
  UNION ALL SELECT p.lang, p.pos, s.height + top.lvl, s.no >> top.lvl, top.nodes[xor(s.no >> top.lvl, 1) + 1] FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang JOIN top ON len(top.nodes) > 1),
path AS (SELECT lang, pos, list({{'odd': i % 2 = 1, 'sib': coalesce(sib, '')}} ORDER BY hgt) AS steps, coalesce(string_agg(sib, '' ORDER BY hgt), '') AS said FROM walk GROUP BY lang, pos),
fold AS (SELECT p.doc_id, p.lang, p.pos, p.leaf, coalesce(path.steps, []) AS steps, sha256(coalesce(path.said, '')) AS proof_sha256, 0 AS k, CASE WHEN p.bad THEN p.other ELSE p.leaf END AS now
    FROM p LEFT JOIN path ON p.lang IS NOT DISTINCT FROM path.lang AND p.pos = path.pos
  UNION ALL SELECT doc_id, lang, pos, leaf, steps, proof_sha256, k + 1, CASE WHEN steps[k + 1].odd THEN sha256(steps[k + 1].sib || now) ELSE sha256(now || steps[k + 1].sib) END FROM fold WHERE k < len(steps)),
r AS (SELECT nodes[1] AS root FROM top WHERE len(nodes) = 1)
SELECT f.doc_id, f.leaf, s.subroot, r.root, f.proof_sha256, f.now AS folded_root, f.now = r.root AS verified
FROM fold f JOIN s ON f.lang IS NOT DISTINCT FROM s.lang CROSS JOIN r WHERE f.k = len(f.steps)
"""
}
