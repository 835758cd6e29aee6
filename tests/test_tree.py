"""Crawls by level beside os.walk."""

import os

from pyspark.sql import functions as F

from lumenweave.sources import tree

KINDS = {".txt", ".md", ".jpg", ".mp4"}


def make(root):
    for name in ("a.txt", "b.jpg", "c.exe", ".hidden.txt", "x/d.md", "x/y/e.mp4", "x/y/z/f.txt", "x/.git/g.txt", "node_modules/h.txt", "node_modules/deep/i.txt", "w/one.txt", "w/two.txt", "é/ü.txt"):
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(name)
    (root / "empty/inner").mkdir(parents=True)
    (root / "link").symlink_to(root / "x")
    (root / "dead.txt").symlink_to(root / "nothing")
    return root


def walk(root):
    """Indexable files by a plain walk that prunes."""
    out = []
    for at, folders, files in os.walk(root):
        folders[:] = [d for d in folders if not d.startswith(".") and d != "node_modules"]
        out += [os.path.join(at, f) for f in files if os.path.splitext(f)[1] in KINDS and not f.startswith(".") and not os.path.islink(os.path.join(at, f))]
    return sorted(out)


def test_a_crawl_is_a_pruned_walk(spark, tmp_path):
    root = make(tmp_path / "r")
    got = tree.crawl_tree(spark, str(root)).collect()
    assert sorted(r.file_path for r in got) == walk(root)
    assert all(r.size == os.stat(r.file_path).st_size and r.mtime_ms == os.stat(r.file_path).st_mtime_ns // 1_000_000 for r in got)
    flat = tree.crawl_tree(spark, str(root), recursive=False).collect()
    assert sorted(r.file_name for r in flat) == ["a.txt", "b.jpg"]


def test_what_is_pruned_is_never_listed(spark, tmp_path):
    root = make(tmp_path / "r")
    asked = spark.sparkContext.accumulator(0)

    def lister(path):
        asked.add(1)
        if "node_modules" in path or ".git" in path or "link" in path:
            raise AssertionError(path)
        yield from tree.local_lister(path)

    assert sorted(r.file_path for r in tree.crawl_tree(spark, str(root), lister=lister).collect()) == walk(root)
    assert asked.value == 8  # r, x, x/y, x/y/z, w, é, empty, empty/inner: each once


def test_pages_leave_no_gap(spark, tmp_path):
    root = make(tmp_path / "r")
    listed = spark.sparkContext.accumulator(0)

    def lister(path):
        listed.add(1)
        yield from tree.local_lister(path)

    after, seen, pages = None, [], 0
    while True:
        before = listed.value
        page, after = tree.crawl_page(spark, str(root), 3, after, lister=lister)
        seen += [r.file_path for r in page.orderBy("file_path").collect()]
        pages += 1
        if after is None:
            break
        assert listed.value - before <= 8
    assert seen == walk(root) and pages == len(seen) // 3 + 1
    assert listed.value - before < 8  # folders before the cursor are not listed again


def test_listings_keep_empty_folders_and_follow_links(spark, tmp_path):
    root = make(tmp_path / "r")
    got = {r.path.removeprefix(f"{root}/"): r for r in tree.list_tree(spark, str(root)).collect()}
    assert got["empty"].child_count == 1 and got["empty/inner"].child_count == 0 and got["x"].child_count == 2
    assert "link/y/z/f.txt" in got and ".hidden.txt" not in got and "x/.git" not in got and got["c.exe"].child_count is None
    assert "link" not in {r.name for r in tree.list_tree(spark, str(root), follow_links=False).collect()}
    shown = tree.list_tree(spark, str(root)).collect()
    assert [r.is_dir for r in shown] == sorted((r.is_dir for r in shown), reverse=True)


def test_arrow_lists_as_the_local_lister_does(tmp_path):
    root = make(tmp_path / "r")
    plain = sorted((n, d, s) for n, d, link, s, _ in tree.local_lister(str(root)) if not link and not d)
    assert plain == sorted((n, d, s) for n, d, _, s, _ in tree.arrow_lister(f"file://{root}") if not d and n != "dead.txt")


def test_watched_folders_give_listings_with_ends(spark, tmp_path):
    root = make(tmp_path / "r")
    rows = [("1", str(root / "x"), True), ("2", str(root / "w"), False), ("3", str(root / "empty"), True), ("4", str(root / "gone"), True)]
    folders = spark.createDataFrame(rows, "folder_id string, path string, recursive boolean")
    got = tree.watched_listing(spark, folders, 5).collect()
    assert {r.folder_id for r in got if r.file_path is None} == {"1", "2", "3"} and {r.scan_no for r in got} == {5}
    assert sorted(os.path.basename(r.file_path) for r in got if r.file_path) == ["d.md", "e.mp4", "f.txt", "one.txt", "two.txt"]
    errors = tree.crawl_folders(spark, folders).where("error IS NOT NULL").select("folder_id", F.col("parent")).collect()
    assert [(r.folder_id, r.parent) for r in errors] == [("4", str(root / "gone"))]
