"""Watched folders, and volumes, as keyed state: each scan's listing gives events of what is new, changed and removed.

A scan comes as rows of its files and one row without a path that ends it. The state of a
folder is dealt over buckets of paths, so a folder with a third of all files lies in all
buckets of its own; the end of a scan is sent to each of them, and what the bucket has not
seen in that scan is removed. A batch reads and writes the paths that it lists; only the end
of a scan goes through a bucket's paths. Nothing of earlier scans is kept but a path's last
signature and scan.

Rows of a scan may come in any number of batches; its end comes with or after the last of
them. Scans of a folder are numbered upwards; rows of a scan that has ended are late and are
not read. Folders are independent of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from lumenweave.streaming.timed_queue import rocksdb

LISTING = "folder_id string, scan_no long, file_path string, content_sig string"
EVENTS = "folder_id string, file_path string, content_sig string, old_sig string, state string, scan_no long"
BUCKETS = 16


class Scans(StatefulProcessor):
    """State of a bucket: of each path the signature and the scan that it was last seen in; and the last scan that ended."""

    def init(self, handle) -> None:
        self.seen = handle.getMapState("seen", "file_path string", "content_sig string, scan_no long")
        self.ended = handle.getValueState("ended", "scan_no long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        folder = key[0]
        done = self.ended.get()
        done = -1 if done is None else int(done[0])
        ends, out = [], []
        for part in rows:  # in batches: a bucket's listing is never held whole
            for path, sig, scan in zip(part["file_path"], part["content_sig"], part["scan_no"], strict=True):
                if scan <= done:
                    continue
                if path is None:
                    ends.append(int(scan))
                    continue
                sig = None if pd.isna(sig) else sig
                old = self.seen.getValue((path,)) if self.seen.containsKey((path,)) else None
                if old is not None and scan < old[1]:
                    continue
                if old is None or old[0] != sig:
                    out.append((folder, path, sig, None if old is None else old[0], "new" if old is None else "changed", int(scan)))
                self.seen.updateValue((path,), (sig, int(scan)))
            if len(out) >= 10_000:
                yield self._frame(out)
                out = []
        if ends:
            last = max(ends)
            gone = [(k[0], v[0]) for k, v in self.seen.iterator() if v[1] < last]
            for path, sig in gone:
                self.seen.removeKey((path,))
            out += [(folder, path, None, sig, "removed", last) for path, sig in gone]
            self.ended.update((last,))
        yield self._frame(out)

    def close(self) -> None:
        pass

    @staticmethod
    def _frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[part.split()[0] for part in EVENTS.split(", ")]).astype({"scan_no": "int64"})


def events(listings: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """listings: a stream of LISTING, file_path null for the end of a scan. Gives the stream of EVENTS."""
    every = F.sequence(F.lit(0), F.lit(buckets - 1))
    own = F.array(F.pmod(F.xxhash64("file_path"), F.lit(buckets)).cast("int"))
    dealt = listings.select("folder_id", "scan_no", "file_path", "content_sig", F.explode(F.when(F.col("file_path").isNull(), every).otherwise(own)).alias("bucket"))
    return dealt.groupBy("folder_id", "bucket").transformWithStateInPandas(Scans(), EVENTS, "Append", "None")


def watch(listings: DataFrame, out: str, checkpoint: str, buckets: int = BUCKETS, **trigger) -> StreamingQuery:
    """Appends the events to the Parquet table out."""
    rocksdb(listings.sparkSession)
    return events(listings, buckets).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def as_listing(files: DataFrame, scan_no: int, folder: Column, path: Column, sig: Column, folders: DataFrame | None = None) -> DataFrame:
    """A whole scan as rows of LISTING with their ends; folders (folder_id) also has those that hold no file."""
    rows = files.select(folder.alias("folder_id"), F.lit(scan_no).cast("long").alias("scan_no"), path.alias("file_path"), sig.alias("content_sig"))
    ids = rows.select("folder_id") if folders is None else rows.select("folder_id").unionByName(folders.select("folder_id"))
    none = F.lit(None).cast("string")
    return rows.unionByName(ids.distinct().select("folder_id", F.lit(scan_no).cast("long").alias("scan_no"), none.alias("file_path"), none.alias("content_sig")))


def stored(events_so_far: DataFrame) -> DataFrame:
    """The state that the events leave: folder_id, file_path, content_sig."""
    order = F.struct("scan_no", F.col("state") == "removed")
    last = events_so_far.groupBy("folder_id", "file_path").agg(F.max_by(F.struct("content_sig", "state"), order).alias("last"))
    return last.where("last.state <> 'removed'").select("folder_id", "file_path", "last.content_sig")


def volume_events(found: DataFrame) -> DataFrame:
    """Events of listings of volumes (file_path is the uuid, content_sig the mount path) as connected, moved and disconnected."""
    named = F.create_map(*(F.lit(x) for pair in (("new", "connected"), ("changed", "moved"), ("removed", "disconnected")) for x in pair))
    return found.select(F.col("file_path").alias("uuid"), F.col("content_sig").alias("mount_path"), F.col("old_sig").alias("old_mount_path"), named[F.col("state")].alias("event"), "scan_no")
