"""Directory trees, crawled level by level on the executors.

The folders of a level are dealt over tasks, each task lists its own, and the folders found
make the next level; a level is a table in the folder that executors share. What is hidden,
or a system folder, is pruned before it is listed, so nothing below it is ever read. Empty
folders are kept as rows, links are not followed unless asked for, and a page of a crawl ends
in a cursor, so a tree of any size is read page by page without gaps.

Listing goes through a function of a path (lister), so any store can be crawled: local_lister
for plain paths, arrow_lister for what pyarrow's file systems read (s3, gs, hdfs, ...).
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.functions.classify import IMAGE, TEXT, VIDEO, extension, is_hidden_or_system
from lumenweave.sources.shared import new_folder

#: name, is_dir, is_link, size, mtime_ms of each entry of a folder
Lister = Callable[[str], Iterator[tuple[str, bool, bool, int, int]]]
_FOUND = "folder_id string, root string, parent string, path string, name string, is_dir boolean, is_link boolean, size long, mtime_ms long, error string, depth int"
#: Entries that a task sends on at once.
SOME = 10_000


def local_lister(path: str) -> Iterator[tuple[str, bool, bool, int, int]]:
    with os.scandir(path) as found:
        for e in found:
            link = e.is_symlink()
            try:
                at = e.stat()
                yield e.name, e.is_dir(), link, at.st_size, at.st_mtime_ns // 1_000_000
            except OSError:  # a link to nothing
                yield e.name, False, link, 0, 0


def arrow_lister(path: str) -> Iterator[tuple[str, bool, bool, int, int]]:
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    for e in store.get_file_info(fs.FileSelector(inner, recursive=False)):
        yield e.base_name, e.type == fs.FileType.Directory, False, e.size or 0, (e.mtime_ns or 0) // 1_000_000


def _list(lister: Lister, follow_links: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in _FOUND.split(", ")]
        for folders in batches:
            for folder_id, root, path, depth in zip(folders["folder_id"], folders["root"], folders["path"], folders["depth"], strict=True):
                out = []
                try:
                    for name, is_dir, is_link, size, mtime in lister(path):
                        if is_link and not follow_links:
                            continue
                        out.append((folder_id, root, path, f"{path.rstrip('/')}/{name}", name, is_dir, is_link, size, mtime, None, depth + 1))
                        if len(out) >= SOME:
                            yield pd.DataFrame(out, columns=names)
                            out = []
                except OSError as e:  # a folder that has gone, or may not be read
                    out.append((folder_id, root, path, None, None, None, None, None, None, str(e), depth + 1))
                yield pd.DataFrame(out, columns=names).astype({"is_dir": "boolean", "is_link": "boolean", "size": "Int64", "mtime_ms": "Int64"})

    return run


def crawl_folders(spark: SparkSession, folders: DataFrame, prune: Column | None = None, lister: Lister = local_lister, follow_links: bool = False, after: str | None = None, deepest: int = 64) -> DataFrame:
    """Everything below folders (folder_id, path, recursive): _FOUND, with an error for folders that could not be listed.

    prune: over name, is_dir; entries of which it is true are left out, and folders among them not listed. after: only
    entries whose path comes later; folders that lie before it as a whole are not listed. deepest: levels, so that
    links that are followed in a circle come to an end.
    """
    prune = is_hidden_or_system(F.col("name")) if prune is None else prune
    where, level, paths = new_folder(spark, "crawl"), 0, []
    now = folders.select(F.col("folder_id").cast("string").alias("folder_id"), F.col("path").alias("root"), "path", F.lit(0).alias("depth"), F.col("recursive").alias("recursive"))
    deep = folders.select(F.col("path").alias("root"), F.col("folder_id").cast("string").alias("folder_id"), "recursive").where("recursive")
    while level < deepest:
        dealt = now.select("folder_id", "root", "path", "depth").repartition(spark.sparkContext.defaultParallelism * 4 if level else spark.sparkContext.defaultParallelism, "path")
        found = dealt.mapInPandas(_list(lister, follow_links), _FOUND)
        found = found.where(F.col("error").isNotNull() | ~F.coalesce(prune, F.lit(False)))
        paths.append(f"{where}/{level:03d}")
        found.write.parquet(paths[-1])
        read = spark.read.schema(found.schema).parquet(paths[-1])
        now = read.where("is_dir").join(deep.select("folder_id", "root"), ["folder_id", "root"], "left_semi")
        if after is not None:
            inside = F.concat("path", F.lit("/"))
            now = now.where((inside >= F.lit(after)) | F.startswith(F.lit(after), inside))
        if not now.limit(1).count():
            break
        level += 1
    out = spark.read.schema(_FOUND).parquet(*paths)
    return out if after is None else out.where(F.col("path").isNull() | (F.col("path") > F.lit(after)))


def _one(spark: SparkSession, path: str, recursive: bool) -> DataFrame:
    return spark.createDataFrame([("0", path.rstrip("/") or "/", recursive)], "folder_id string, path string, recursive boolean")


def crawl_tree(spark: SparkSession, path: str, recursive: bool = True, lister: Lister = local_lister, after: str | None = None) -> DataFrame:
    """file_path, file_name, size, mtime_ms of all indexable files, whatever their number; hidden and system folders are never listed, links not followed."""
    found = crawl_folders(spark, _one(spark, path, recursive), lister=lister, after=after)
    files = found.where(~F.col("is_dir") & extension(F.col("name")).isin(IMAGE + VIDEO + TEXT))
    return files.select(F.col("path").alias("file_path"), F.col("name").alias("file_name"), "size", "mtime_ms")


def crawl_page(spark: SparkSession, path: str, most: int = 100_000, after: str | None = None, recursive: bool = True, lister: Lister = local_lister) -> tuple[DataFrame, str | None]:
    """The next files by path, at most so many, and the cursor for the page after it (None: that was the last)."""
    files = crawl_tree(spark, path, recursive, lister, after)
    page = files.orderBy("file_path").limit(most)
    last = page.agg(F.max("file_path"), F.count("*")).first()
    return page, last[0] if last[1] == most else None


def watched_listing(spark: SparkSession, folders: DataFrame, scan_no: int, lister: Lister = local_lister) -> DataFrame:
    """A scan of watched folders (folder_id, path, recursive) as rows of streaming.folder_state, with their ends; a folder that cannot be listed has no end, so nothing of it counts as removed."""
    from lumenweave.operators.watch import signature
    from lumenweave.streaming.folder_state import as_listing

    found = crawl_folders(spark, folders, lister=lister)
    bad = found.where("error IS NOT NULL").select("folder_id").distinct()
    files = found.where(~F.col("is_dir") & extension(F.col("name")).isin(IMAGE + VIDEO + TEXT))
    good = folders.select(F.col("folder_id").cast("string").alias("folder_id")).join(bad, "folder_id", "left_anti")
    listing = as_listing(files, scan_no, F.col("folder_id"), F.col("path"), signature(F.col("size"), F.col("mtime_ms")), good)
    ends = listing.where("file_path IS NULL").join(bad, "folder_id", "left_anti").select(*listing.columns)
    return listing.where("file_path IS NOT NULL").unionByName(ends)


def list_tree(spark: SparkSession, path: str, lister: Lister = local_lister, follow_links: bool = True) -> DataFrame:
    """name, path, is_dir, child_count of all below a folder, empty folders too; what is hidden, and all in it, is left out. Folders first, then by name."""
    hidden = F.startswith("name", F.lit(".")) | F.col("name").isin("DS_Store", "Thumbs.db")
    found = crawl_folders(spark, _one(spark, path, True), hidden, lister, follow_links).where("error IS NULL")
    counts = found.groupBy(F.col("parent").alias("path")).agg(F.count("*").cast("int").alias("n"))
    out = found.join(counts, "path", "left")
    return out.select("name", "path", "is_dir", F.when(F.col("is_dir"), F.coalesce("n", F.lit(0))).alias("child_count")).orderBy(F.desc("is_dir"), "name", "path")
