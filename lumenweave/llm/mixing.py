"""Mixing sources to target weights by weighted fair queueing.

Every document gets a virtual finish time: the words of its source up to and with it, in a
shuffled order, divided by the source's target. All documents are put in order of that
time (a source that may be used twice queues its documents a second time behind the
first), and the queue is cut where the running total reaches the whole budget.

Edge cases: a null or empty text has size 0 and takes 0; a null source is a source of its
own, ordered last; a null doc_id shuffles as the empty string; repeated rows count each; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenweave.llm.common import WORD, hex_digits, running_total, settle, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sizes: source, source_size. Adds src_no (by code point, null last), weight and target.

    The budget, share times all sizes, is dealt by weight; no target exceeds most times its
    source's size and what is left over is dealt again. Sorted by cap / weight, the sources
    that hit their cap come first, so one running sum finds them.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.array(*map(F.lit, weights))
    out = sizes.withColumn("src_no", F.row_number().over(by_name)).withColumn("weight", w[(F.col("src_no") - 1) % len(weights)])
    out = out.withColumn("cap", F.col("source_size") * most)
    whole = Window.partitionBy()
    rank = Window.orderBy(F.col("cap") / F.col("weight"), "src_no")
    before = rank.rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("budget", F.sum("source_size").over(whole) * F.lit(share))
    left = F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))
    heavy = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    out = out.withColumn("full", left / heavy * F.col("weight") > F.col("cap"))
    spare = F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(F.lit(0))).over(whole)
    open_w = F.sum(F.when(F.col("full"), F.lit(0)).otherwise(F.col("weight"))).over(whole)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(spare / F.nullif(open_w, F.lit(0)) * F.col("weight"))
    return out.select("source", "src_no", "source_size", "budget", target.alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, per_bucket: int = 50_000, keep: tuple = ()) -> DataFrame:
    """docs: doc_id, source, text and keep. Returns doc_id, keep, size, source_size, target, taken (words the mix takes of it) and turns."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    spread = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    base = settle(docs.select("doc_id", "source", *keep, size.alias("size"), spread.alias("h")))
    targets = settle(source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    first = targets.agg(F.max("budget").alias("b"), F.count("*").alias("n")).first()
    n = base.count()
    k = hex_digits(n, per_bucket)
    named = base.join(targets.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    named = named.withColumn("bucket", F.substring("h", 1, k))
    queued = running_total(named, ["src_no"], "bucket", [F.col("h"), F.col("doc_id"), F.col("size")], F.col("size"), "served").drop("bucket")
    queued = settle(queued)
    turns = [((F.lit(t).cast("long") * F.col("source_size") + F.col("served")) / F.nullif(F.col("target"), F.lit(0.0))) for t in range(most)]
    turns = [F.coalesce(x, F.lit(0.0)) for x in turns]
    cut = _cut(queued, turns, first["b"] or 0.0, max(256, n // per_bucket))
    taken = sum((F.when(_upto(x, cut), 1).otherwise(0) for x in turns), F.lit(0))
    return queued.select("doc_id", *keep, "size", "source_size", "target", (taken * F.col("size")).cast("long").alias("taken"), taken.cast("int").alias("turns"))


ORDER = ("src_no", "h", "doc_id", "size")


def _upto(finish, cut):
    """Whether a place in the queue comes before the one where the budget runs out (None: it never does)."""
    if cut is None:
        return F.lit(True)
    at = F.lit(False)
    for name in reversed(ORDER):  # doc_id may be null: nulls first, as in the sort
        c, v = F.col(name), cut[name]
        less = F.lit(False) if v is None else (c.isNull() | (c < F.lit(v)))
        at = less | (c.eqNullSafe(F.lit(v)) & at)
    return F.coalesce((finish < F.lit(cut["finish"])) | ((finish == F.lit(cut["finish"])) & at), F.lit(False))


def _cut(queued: DataFrame, turns: list, budget: float, slots: int):
    """The first place in the queue whose running total exceeds the budget.

    Totals by slot of virtual time find the slot; only its rows are then put in order.
    """
    places = queued.select(*ORDER, F.explode(F.array(*turns)).alias("finish"))
    places = places.withColumn("slot", F.least(F.floor(F.col("finish") * slots), F.lit(4 * slots)).cast("long"))
    sums = places.groupBy("slot").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("upto", F.sum("words").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)))
    over = sums.where(F.col("upto") > budget).orderBy("slot").first()
    if over is None:
        return None
    so_far = Window.orderBy("finish", *ORDER).rowsBetween(Window.unboundedPreceding, 0)
    here = places.where(F.col("slot") == over["slot"]).withColumn("upto", F.lit(over["upto"] - over["words"]) + F.sum("size").over(so_far))
    return here.where(F.col("upto") > budget).orderBy("finish", *ORDER).first()


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("turns")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: a document stands in the result as often as the mix takes it."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "source"))
    hidden = {c: f"__keep_{i}" for i, c in enumerate(rest)}
    held = docs.select("doc_id", "source", "text", *(F.col(c).alias(h) for c, h in hidden.items()))
    out = mix(held.withColumn("__source", F.col("source")), keep=(*hidden.values(), "__source"))
    out = out.where("turns > 0").withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("turns"))))
    return out.select(*(F.col(hidden[c]).alias(c) if c in hidden else F.col("__source" if c == "source" else c).alias(c) for c in docs.columns))


QUERIES = {"op2_mix": op2_mix}
SQL = {
    "op2_mix": r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS src_no FROM d GROUP BY source),
w AS (SELECT *, CASE (src_no - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 2 AS cap FROM s),
r AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS budget,
    CAST(coalesce(sum(cap) OVER (ORDER BY cap / weight, src_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS caps_before,
    CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, src_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS w_left FROM w),
f AS (SELECT *, (budget - caps_before) / w_left * weight > cap AS is_full FROM r),
t AS (SELECT source, src_no, source_size, budget, CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE
    (budget - CAST(sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER () AS DOUBLE)) / nullif(CAST(sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () AS DOUBLE), 0) * weight END AS target FROM f),
q AS (SELECT d.doc_id, d.h, d.size, t.src_no, t.source_size, t.target, t.budget,
    sum(d.size) OVER (PARTITION BY t.src_no ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS served
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, coalesce(CAST(served + turn * source_size AS DOUBLE) / nullif(target, 0), 0) AS finish FROM q, (VALUES (0), (1)) v(turn)),
c AS (SELECT *, sum(size) OVER (ORDER BY finish, src_no, h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM p)
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN upto <= budget THEN size ELSE 0 END) AS BIGINT) AS taken
FROM c GROUP BY doc_id, size, source_size, target
"""
}
