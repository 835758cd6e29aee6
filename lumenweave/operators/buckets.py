"""Tables kept in hash buckets: a change rewrites the buckets that it touches and nothing else.

A version of a table is a list that names, for every bucket, the folder that holds it. A
change reads the touched buckets, writes them anew into a folder of its own, and then writes
the next list, in one file, last. So readers see a whole version or the one before, a job that
dies leaves the table as it was, and what has not changed is not copied. Folders that no kept
version names are retired by retire(). One writer at a time, as for Snapshots.

The key's hash decides the bucket, so rows of one key are together, and an upsert or a delete
by key never needs more than the buckets of its keys. A touched bucket is rewritten by Spark
in parts of about ROWS rows each: a key with very many rows is split over them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.operators.tables import check_width

BUCKETS = 64
#: Rows of a file, about.
ROWS = 1_000_000


class Buckets:
    """keys: the columns whose hash is the bucket. vector, width: every row that is written must have so wide a vector, else nothing of the change is published."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = BUCKETS, vector: str | None = None, width: int | None = None):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets
        self.vector, self.width = vector, width

    # versions

    def _fs(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def versions(self) -> list[int]:
        """Numbers of the published versions, rising."""
        fs, where = self._fs(f"{self.path}/_versions")
        if not fs.exists(where):
            return []
        done = [p.getPath().getName() for p in fs.listStatus(where)]
        return sorted(int(n.split("-")[1]) for n in done if n.startswith("version-") and fs.exists(self._fs(f"{self.path}/_versions/{n}/_SUCCESS")[1]))

    def _named(self, version: int) -> dict:
        """What a version says: the table's columns, how many buckets, and the folder of each bucket that has rows."""
        rows = self.spark.read.text(f"{self.path}/_versions/version-{version:010d}").collect()  # one row
        return json.loads(rows[0]["value"])

    def _publish(self, schema: str, folders: dict[int, str]) -> int:
        last = self.versions()
        number = last[-1] + 1 if last else 0
        said = json.dumps({"schema": schema, "keys": self.keys, "buckets": self.buckets, "folders": {str(k): v for k, v in sorted(folders.items())}})
        self.spark.createDataFrame([(said,)], "value string").coalesce(1).write.text(f"{self.path}/_versions/version-{number:010d}")
        return number

    def _current(self) -> dict | None:
        known = self.versions()
        if not known:
            return None
        now = self._named(known[-1])
        if now["keys"] != self.keys or now["buckets"] != self.buckets:
            raise ValueError(f"the table is kept by {now['keys']} in {now['buckets']} buckets")
        return now

    # reading

    def _read(self, said: dict, only: set[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/{folder}/bucket={k}" for k, folder in said["folders"].items() if only is None or int(k) in only]
        if not paths:
            return self.spark.createDataFrame([], said["schema"])
        return self.spark.read.schema(said["schema"]).parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame | None:
        """A whole version, the last one by default; None where nothing was published."""
        if version is not None:
            return self._read(self._named(version))
        now = self._current()
        return None if now is None else self._read(now)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Rows of the given keys; only their buckets are read."""
        now = self._current()
        if now is None:
            raise ValueError("nothing has been published")
        return self._read(now, self._touched(keys)).join(keys.select(*self.keys).distinct(), self.keys, "left_semi")

    # changes

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _touched(self, rows: DataFrame) -> set[int]:
        return {r["b"] for r in rows.select(self._bucket().alias("b")).distinct().collect()}  # at most as many as buckets

    def _write(self, rows: DataFrame, touched: set[int], said: dict | None, schema: str) -> int:
        """Publishes rows as the whole of the touched buckets."""
        if self.vector is not None:
            rows = check_width(rows, self.width, self.vector)
        folder = f"data-{uuid.uuid4().hex}"
        dealt = rows.withColumn("bucket", self._bucket()).hint("rebalance", "bucket")
        dealt.write.option("maxRecordsPerFile", ROWS).partitionBy("bucket").parquet(f"{self.path}/{folder}")
        fs, where = self._fs(f"{self.path}/{folder}")
        written = {int(p.getPath().getName().split("=")[1]) for p in fs.listStatus(where) if p.getPath().getName().startswith("bucket=")}
        kept = {} if said is None else {int(k): v for k, v in said["folders"].items() if int(k) not in touched}
        return self._publish(schema, kept | dict.fromkeys(written, folder))

    def create(self, rows: DataFrame) -> int:
        """The first version, or one that replaces the whole table."""
        return self._write(rows, set(range(self.buckets)), None, _ddl(rows))

    def upsert(self, new: DataFrame) -> int:
        """new replaces the rows of its keys, as a whole or not at all. Columns that new lacks are null; the table's columns stay."""
        said = self._current()
        if said is None:
            return self.create(new)
        touched = self._touched(new)
        old = self._read(said, touched)
        whole = old.join(new.select(*self.keys).distinct(), self.keys, "left_anti").select(*old.columns)
        added = new.select(*(F.col(c) if c in new.columns else F.lit(None).cast(t).alias(c) for c, t in old.dtypes))
        return self._write(whole.unionByName(added), touched, said, said["schema"])

    def delete(self, keys: DataFrame) -> int:
        """Without the rows of the given keys."""
        said = self._current()
        if said is None:
            raise ValueError("nothing has been published")
        touched = self._touched(keys)
        old = self._read(said, touched)
        return self._write(old.join(keys.select(*self.keys).distinct(), self.keys, "left_anti").select(*old.columns), touched, said, said["schema"])

    def delete_where(self, condition: Column) -> int:
        """Without the rows of which the condition is true; buckets without such a row are kept as they are."""
        said = self._current()
        if said is None:
            raise ValueError("nothing has been published")
        hit = F.coalesce(condition, F.lit(False))
        touched = self._touched(self._read(said).where(hit))
        old = self._read(said, touched)
        return self._write(old.where(~hit), touched, said, said["schema"])

    def retire(self, keep: int = 2) -> list[str]:
        """Deletes all versions but the last keep, and the folders that those do not name; gives these folders."""
        known = self.versions()
        named = {f for v in known[-keep:] for f in self._named(v)["folders"].values()}
        gone = []
        for v in known[:-keep]:
            fs, where = self._fs(f"{self.path}/_versions/version-{v:010d}")
            fs.delete(where, True)
        fs, where = self._fs(self.path)
        for p in fs.listStatus(where):
            name = p.getPath().getName()
            if name.startswith("data-") and name not in named:
                fs.delete(p.getPath(), True)
                gone.append(name)
        return gone


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
