"""Files read by ranges of bytes: the last lines of a log, and the frames of a stream of JPEG images.

No file is read as one row, so files of any size work; ranges are dealt over tasks, and what
is read does not depend on where they are cut. Paths are local ones or those of a store that
pyarrow reads.
"""

from __future__ import annotations

from collections.abc import Iterator
from glob import glob

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from lumenweave.operators.ranks import numbered
from lumenweave.sources.files import parse_log

#: Bytes that are read at once, and of a range.
STEP, RANGE = 1 << 16, 64 << 20
SOI, EOI = b"\xff\xd8", b"\xff\xd9"


class Bytes:
    """A file of which any part can be read."""

    def __init__(self, path: str):
        if "://" in path or path.startswith("file:"):
            from pyarrow import fs

            store, inner = fs.FileSystem.from_uri(path)
            self._file, self.size = store.open_input_file(inner), store.get_file_info(inner).size
        else:
            self._file = open(path, "rb")  # noqa: SIM115
            self._file.seek(0, 2)
            self.size = self._file.tell()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self._file.close()

    def read(self, start: int, n: int) -> bytes:
        self._file.seek(start)
        return self._file.read(max(0, min(n, self.size - start)))

    def find(self, what: bytes, start: int, end: int | None = None) -> int:
        """Where what first begins at start or later (before end), or -1; read step by step."""
        end = self.size if end is None else min(end + len(what) - 1, self.size)
        while start < end:
            data = self.read(start, min(STEP, end - start))
            at = data.find(what)
            if at >= 0:
                return start + at
            if start + len(data) >= end:
                return -1
            start += len(data) - len(what) + 1
        return -1


# the end of a log


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of path, start and end as the lines that begin there: at and value. The last one is read on to its end."""
    for ranges in batches:
        for path, start, end in zip(ranges["path"], ranges["start"], ranges["end"], strict=True):
            with Bytes(path) as f:
                end = min(int(end), f.size)
                begin = int(start) and f.find(b"\n", int(start) - 1, end - 1) + 1
                if (start and not begin) or begin >= end:
                    continue
                last = f.find(b"\n", end - 1)
                data = f.read(begin, (f.size if last < 0 else last) - begin)
            at, out = begin, []
            for line in data.split(b"\n"):
                if at < end:
                    out.append((at, line.removesuffix(b"\r").decode("utf-8", "replace")))
                at += len(line) + 1
            yield pd.DataFrame(out, columns=["at", "value"])


def last_lines(spark: SparkSession, path: str, n: int, block: int = 1 << 20) -> DataFrame:
    """at (its place in bytes) and value of the last n lines of a file. Blocks are read from the end, twice as many each time, until they hold n lines."""
    with Bytes(path) as f:
        size = f.size
    schema, many = "at long, value string", 1
    while True:
        first = max(0, size - many * block)
        ranges = [(path, start, min(start + block, size)) for start in range(first, size, block)]
        rows = spark.createDataFrame(ranges, "path string, start long, end long").repartition(max(1, len(ranges))).mapInPandas(_lines, schema)
        found = rows.orderBy(F.desc("at")).limit(n)
        if first == 0 or found.count() >= n:
            return found.orderBy("at")
        many *= 2


def log_tail(spark: SparkSession, path: str, n: int, block: int = 1 << 20) -> DataFrame:
    """sources.files.log_tail of a log of any size: timestamp, level, message, module of its last n entries, in order."""
    return parse_log(last_lines(spark, path, n, block)).orderBy("at").drop("at")


# frames


def settled(f: Bytes, at: int) -> int:
    """The first place at or behind at where no frame is open: the start, or the end of the first end marker from there. Behind such a marker none is open, whatever was before."""
    if at <= 0:
        return 0
    end = f.find(EOI, at)
    return f.size if end < 0 else end + 2


def frames(f: Bytes, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Place and bytes of the whole frames that begin from start to end, neither of which lies in a frame."""
    at = start
    while at < end:
        begin = f.find(SOI, at, end)
        if begin < 0:
            return
        stop = f.find(EOI, begin + 2)
        if stop < 0:
            return
        yield begin, f.read(begin, stop + 2 - begin)
        at = stop + 2


class Part(InputPartition):
    def __init__(self, path: str, start: int, end: int, exact: bool):
        self.path, self.start, self.end, self.exact = path, start, end, exact


class FrameReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.range = options["path"], int(options.get("range", RANGE))

    def paths(self) -> list[str]:
        return [self.path] if "://" in self.path else sorted(glob(self.path)) or [self.path]

    def partitions(self) -> list[Part]:
        out = []
        for path in self.paths():
            with Bytes(path) as f:
                out += [Part(path, start, start + self.range, False) for start in range(0, max(f.size, 1), self.range)]
        return out

    def read(self, part: Part) -> Iterator[tuple]:
        with Bytes(part.path) as f:
            start, end = (part.start, part.end) if part.exact else (settled(f, part.start), settled(f, part.end) if part.end < f.size else f.size)
            for at, data in frames(f, start, end):
                yield part.path, at, data


class FrameStream(FrameReader, DataSourceStreamReader):
    """Files that grow: an offset is, for each file, the end of its last whole frame, so a frame that is being written waits."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for path in sorted(glob(self.path)):
            with Bytes(path) as f:
                end = f.size
                while end > 0:  # the last end marker, from behind
                    start = max(0, end - STEP)
                    at = f.read(start, end - start + 1).rfind(EOI)
                    if at >= 0:
                        out[path] = start + at + 2
                        break
                    end = start
        return out

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [Part(path, start.get(path, 0), to, True) for path, to in end.items() if to > start.get(path, 0)]

    def commit(self, end: dict) -> None:
        pass


class JpegFrames(DataSource):
    """Format jpeg_frames: path, at and frame of concatenated JPEG images; option range: bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "jpeg_frames"

    def schema(self) -> str:
        return "path string, at long, frame binary"

    def reader(self, schema) -> FrameReader:
        return FrameReader(self.options)

    def streamReader(self, schema) -> FrameStream:
        return FrameStream(self.options)


def read_frames(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """path, frame_number (from 0, in each file), frame."""
    spark.dataSource.register(JpegFrames)
    found = spark.read.format("jpeg_frames").option("range", range_bytes).load(path)
    places = numbered(found.select("path", "at"), ["path"], ["at"])
    return found.join(places, ["path", "at"]).select("path", F.col("pos").alias("frame_number"), "frame")


def stream_frames(spark: SparkSession, path: str) -> DataFrame:
    """path, at, frame of files that grow, as a stream."""
    spark.dataSource.register(JpegFrames)
    return spark.readStream.format("jpeg_frames").load(path)
