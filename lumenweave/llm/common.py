"""What the training-data operators share: settled tables, running totals, whole-table readers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch that are pandas objects at once.
SLICE = 512
#: What a worker keeps between the tasks of one operator, by its name; a task of another one empties it.
WORKER: dict[str, dict] = {}
_KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Only the two columns that an operator reads, so that others may have any name."""
    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))


def hidden(docs: DataFrame, *read: str) -> tuple[DataFrame, list[Column]]:
    """docs with the columns read (as they are) and all of its columns under numbered names, and the columns that give docs again.

    So an operator may add columns of any name in between, whatever names docs has.
    """
    held = docs.select(*(F.col(f"`{c}`") for c in read), *(F.col(f"`{c}`").alias(f"__own_{i}") for i, c in enumerate(docs.columns)))
    return held, [F.col(f"__own_{i}").alias(c) for i, c in enumerate(docs.columns)]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one is made only where none is set (tests)."""
    sc = spark.sparkContext
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get().rstrip("/")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="lumenweave-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage is cut, any executor can be lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lumenweave/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back(f: Callable, keeps: str = "") -> Callable:
    """f over a task's batches, without what the worker keeps of operators but keeps; then what Arrow has kept of the batches is
    given back too, as workers live on from stage to stage.
    """

    def run(batches: Iterator) -> Iterator:
        for other in WORKER.keys() - {keeps}:
            del WORKER[other]
        yield from f(batches)
        pa.default_memory_pool().release_unused()

    return run


def slices(f: Callable, schema: str, keeps: str = "") -> Callable:
    """f, from and to pandas rows, for Arrow batches, of which it gets SLICE rows at a time. Integers with nulls stay integers."""
    to = pa.schema([(name, _KINDS[kind]) for name, kind in (c.split(" ") for c in schema.split(", "))])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                yield batch.slice(at, SLICE).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in f(parts(batches)):
            yield pa.RecordBatch.from_pandas(out, schema=to, preserve_index=False)

    return give_back(run, keeps)


def map_slices(df: DataFrame, f: Callable, schema: str, keeps: str = "") -> DataFrame:
    """df.mapInPandas(f, schema) for texts: a task holds an Arrow batch, but only a slice of it as Python objects."""
    return df.mapInArrow(slices(f, schema, keeps), schema)


def running_total(df: DataFrame, keys: list[str], bucket: str, order: list[Column], value: Column, out: str) -> DataFrame:
    """Adds the running sum of value (own row included) within keys, by bucket and then by order.

    Rows meet only inside one (keys, bucket); across buckets only their sums are ordered,
    so a key that holds a third of all rows is spread over all its buckets. bucket must be
    non-null and follow the order.
    """
    on = [*keys, bucket]
    sums = df.groupBy(*on).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1) if keys else Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*on, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(starts, on).withColumn(out, F.col("__before") + F.sum(value).over(inside)).drop("__before")


def hex_digits(n: int, per_bucket: int = 50_000) -> int:
    """So many leading hex digits of a hash leave about per_bucket of n rows in a bucket, at most 65,536 buckets."""
    k = 1
    while n > per_bucket * 16**k and k < 4:
        k += 1
    return k
