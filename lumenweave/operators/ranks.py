"""Places of rows in an order, without one task that sorts them all; and pages by place.

Rows are dealt into ranges of the order and written range by range; the sizes of the ranges
are an index from which a row's place follows, and which says in which ranges a page lies. So
page n reads the range or two that hold it, whatever n is, and a group of any size is numbered
by as many tasks as it has ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenweave.sources.shared import new_folder, settle

#: Rows of a range, about.
PER_RANGE = 200_000
#: Ranges of a kept table before they grow beyond the rows asked for, up to LARGEST rows: each is a task and a folder that the driver hears of.
RANGES, LARGEST = 256, 1_000_000


def numbered(rows: DataFrame, group: list[str], order: list[str], per_range: int = PER_RANGE) -> DataFrame:
    """rows with pos, the place (from 0) in the row's group; equal rows in any order."""
    n = rows.count()
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())  # equal rows may lie in several ranges
    dealt = tied.repartitionByRange(max(1, -(-n // per_range)), *group, *order, "__tie").sortWithinPartitions(*group, *order).drop("__tie")
    held = settle(dealt.withColumn("__at", F.monotonically_increasing_id()), "ranges").withColumn("__run", F.shiftright("__at", 33))
    runs = held.groupBy(*group, "__run").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = runs.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0).cast("long")))
    starts = starts.select(*(F.col(c).alias(f"__g{i}") for i, c in enumerate(group)), F.col("__run").alias("__r"), "__first", "__before")
    same = F.col("__run") == F.col("__r")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    return held.join(starts, same).select(*rows.columns, (F.col("__before") + F.col("__at") - F.col("__first")).alias("pos"))


def range_count(n: int, per_range: int) -> int:
    """Ranges of per_range rows, but more than RANGES only of LARGEST rows."""
    return min(-(-n // per_range), max(RANGES, -(-n // LARGEST)))


class Pages:
    """A sorted table kept in ranges, and its index. Ranges hold per_range rows, or more where the table is large; within a range, Parquet's
    pages hold per_range rows at most, and by the numbers of their rows a reader passes over the others. order: column names or Columns (asc, desc, with nulls first or last), the last of which should tell rows apart."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, rows: DataFrame, order: list, path: str | None = None, per_range: int = PER_RANGE) -> Pages:
        spark = rows.sparkSession
        made = cls(spark, path or new_folder(spark, "pages"))
        n = rows.count()
        rows.limit(0).write.parquet(f"{made.path}/columns")
        if not n:
            spark.createDataFrame([], "run long, first long, n long").write.parquet(f"{made.path}/index")
            return made
        dealt = rows.repartitionByRange(range_count(n, per_range), *order).sortWithinPartitions(*order)
        placed = dealt.withColumn("__at", F.monotonically_increasing_id()).withColumn("run", F.shiftright("__at", 33))
        placed.write.option("parquet.page.row.count.limit", per_range).partitionBy("run").parquet(f"{made.path}/rows")
        runs = made._rows().groupBy("run").agg(F.min("__at").alias("first"), F.count("*").alias("n"))
        runs.coalesce(1).write.parquet(f"{made.path}/index")
        return made

    def _rows(self, runs: list[int] | None = None) -> DataFrame:
        """All ranges, or only the folders of some."""
        folders = [f"{self.path}/rows"] if not runs else [f"{self.path}/rows/run={r}" for r in runs]
        return self.spark.read.option("basePath", f"{self.path}/rows").parquet(*folders)

    def index(self) -> list:
        """run, first, n, start (place of its first row); one row a range."""
        found = sorted(self.spark.read.parquet(f"{self.path}/index").collect(), key=lambda r: r["run"])
        out, start = [], 0
        for r in found:
            out.append((r["run"], r["first"], r["n"], start))
            start += r["n"]
        return out

    def total(self) -> int:
        return sum(n for _, _, n, _ in self.index())

    def page(self, offset: int, limit: int) -> DataFrame:
        """Rows of places offset to offset + limit, with rank (their place, from 0); only their ranges are read."""
        offset = max(0, offset)
        own = [(run, first, n, start) for run, first, n, start in self.index() if start < offset + limit and start + n > offset]
        if not own:
            return self.spark.read.parquet(f"{self.path}/columns").withColumn("rank", F.lit(None).cast("long"))
        rows = self._rows([run for run, *_ in own])
        shift, inside = F.lit(None).cast("long"), F.lit(False)
        for run, first, n, start in own:
            shift = F.when(F.col("run") == run, F.lit(start - first)).otherwise(shift)
            least, most = first + max(0, offset - start), first + min(n, offset + limit - start)
            inside = inside | ((F.col("__at") >= least) & (F.col("__at") < most))  # by __at, as Parquet's pages are told apart by it
        held = rows.where(inside).withColumn("rank", F.col("__at") + shift)
        return held.drop("__at", "run").orderBy("rank")

    def page_with_total(self, offset: int, limit: int) -> tuple[DataFrame, int, bool]:
        """A page, the number of all rows, and whether there are more; an offset beyond the end is the end."""
        total = self.total()
        offset = min(max(0, offset), total)
        return self.page(offset, limit), total, offset + limit < total
