"""Files as tables: crawls, texts, previews, logs, CSV, frames."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.functions.classify import IMAGE, TEXT, VIDEO, base_name, extension, is_hidden_or_system

#: Files of one crawl.
CAP = 100_000
# Extensions whose files are never shown as text.
BINARY = "png jpg jpeg gif webp bmp ico tiff tif mp4 mov avi mkv webm mp3 wav flac ogg zip tar gz pdf exe".split()
LOG = "timestamp string, level string, message string, module string"


def crawl(spark: SparkSession, path: str, recursive: bool = True, cap: int = CAP) -> DataFrame:
    """file_path, file_name, size, mtime_ms of indexable files; hidden and system folders are pruned. Contents are not read.

    Of more than cap files the first by path are given, so that the next crawl finds the same ones and not some others.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    root = path.rstrip("/").removeprefix("file:")
    inner = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + _plain(root) + "/*", "")
    rows = files.select(F.regexp_replace("path", "^file:/*", "/").alias("file_path"), inner.alias("__in"), F.col("length").alias("size"), (F.unix_micros("modificationTime") / 1000).cast("long").alias("mtime_ms"))
    seen = rows.where(~F.exists(F.split("__in", "/"), is_hidden_or_system)).where(extension(F.col("__in")).isin(IMAGE + VIDEO + TEXT))
    return seen.select("file_path", base_name(F.col("file_path")).alias("file_name"), "size", "mtime_ms").orderBy("file_path").limit(cap)


def _plain(text: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in text)


def list_directory(spark: SparkSession, path: str) -> DataFrame:
    """name, path, is_dir, child_count of what is in a folder, hidden names left out; folders first, then by name. Local listing on the driver, one folder."""
    import os

    rows = []
    with os.scandir(path) as found:
        for e in found:
            if not e.name.startswith("."):
                rows.append((e.name, e.path, e.is_dir(), sum(not n.startswith(".") for n in os.listdir(e.path)) if e.is_dir() else None))
    return spark.createDataFrame(rows, "name string, path string, is_dir boolean, child_count int").orderBy(F.desc("is_dir"), "name")


def list_recursive(spark: SparkSession, path: str) -> DataFrame:
    """name, path, is_dir, child_count of all that is below a folder, in any store; folders first, then by name.

    What is hidden, and all in it, is left out; so are folders without any file, of which a listing of files knows nothing.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = "/" + path.rstrip("/").removeprefix("file:").lstrip("/")
    inner = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + _plain(root) + "/*", "")
    parts = files.select(F.split(inner, "/").alias("p")).where(~F.exists("p", lambda n: n.startswith(".") | n.isin("DS_Store", "Thumbs.db")))
    at = parts.select("p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("k"))
    below = at.select(F.array_join(F.slice("p", 1, F.col("k")), "/").alias("__rel"), F.array_join(F.slice("p", 1, F.col("k") - 1), "/").alias("__up"), F.get("p", F.col("k") - 1).alias("name"), (F.col("k") < F.size("p")).alias("is_dir")).distinct()
    counts = below.groupBy(F.col("__up").alias("__rel")).agg(F.count("*").cast("int").alias("child_count"))
    return below.join(counts, "__rel", "left").select("name", F.concat(F.lit(root + "/"), "__rel").alias("path"), "is_dir", "child_count").orderBy(F.desc("is_dir"), "name", "path")


def file_metadata(spark: SparkSession, path: str) -> DataFrame:
    """name, path, size, modified_at (UTC, ISO) of a file or of the files of a pattern; contents are not read. Stores keep no time of creation."""
    files = spark.read.format("binaryFile").load(path)
    where = F.regexp_replace("path", "^file:/*", "/")
    return files.select(base_name(where).alias("name"), where.alias("path"), F.col("length").alias("size"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("modified_at"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """file_path, text of whole files, lossy UTF-8; blank files are left out."""
    raw = spark.read.format("binaryFile").load(path)
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.make_valid_utf8(F.col("content").cast("string")))
    return nonblank(raw.select(F.regexp_replace("path", "^file:/*", "/").alias("file_path"), text.alias("text")))


def nonblank(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.where(F.col(text).rlike(r"(?U)\S"))


def read_content(files: DataFrame) -> DataFrame:
    """binaryFile rows: base64 of binary kinds, else text (an error if it is not UTF-8)."""
    binary = extension(F.col("path")).isin(BINARY)
    return files.select("path", F.when(binary, F.base64("content")).otherwise(F.validate_utf8(F.col("content").cast("string"))).alias("content"), binary.alias("is_base64"))


def preview(text: Column, most: int) -> Column:
    """struct(content, truncated): the first bytes, as far as they are whole characters."""
    raw = F.encode(text, "UTF-8")
    cut = F.make_valid_utf8(F.substring(raw, 1, most).cast("string"))
    return F.struct(F.regexp_replace(cut, "�+$", "").alias("content"), (F.octet_length(raw) > most).alias("truncated"))


def read_csv(spark: SparkSession, path: str, rows: int = 200, columns: int = 40) -> DataFrame:
    """Quoted fields, doubled quotes and line ends inside quotes; as many rows and columns as are shown."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    return df.select(*df.columns[:columns]).limit(rows)


def parse_log(lines: DataFrame, line: str = "value") -> DataFrame:
    """JSON lines, '[time] [level] message' lines, and any other as an INFO message."""
    j = F.from_json(line, LOG)
    part = lambda i: F.regexp_extract(line, r"^\[?(.*?)\] \[?(.*?)\] (.*)$", i)
    simple = F.struct(part(1).alias("timestamp"), part(2).alias("level"), part(3).alias("message"), F.lit(None).cast("string").alias("module"))
    other = F.struct(F.lit(None).cast("string").alias("timestamp"), F.lit("INFO").alias("level"), F.col(line).alias("message"), F.lit(None).cast("string").alias("module"))
    entry = F.when(j["message"].isNotNull(), j).when(F.col(line).rlike(r"^.*?\] .*?\] "), simple).otherwise(other)
    return lines.withColumn("__e", entry).select(*(c for c in lines.columns if c != line), "__e.*")


def log_tail(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The last n entries. A log file is read whole by one task, as line numbers ask."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n")).alias("n", "value"))
    return parse_log(rows.orderBy(F.desc("n")).limit(n)).orderBy("n").drop("n")


def probe(rows: DataFrame, column: str = "probe_json") -> DataFrame:
    """Sizes, duration and codec out of a media probe's JSON; 0, 0.0 and 'unknown' where missing."""
    shape = "streams array<struct<codec_type:string,codec_name:string,width:long,height:long>>, format struct<duration:string>"
    p = F.from_json(column, shape)
    first = F.get(F.filter(p["streams"], lambda s: s["codec_type"] == "video"), F.lit(0))
    return rows.withColumns({"width": F.coalesce(first["width"], F.lit(0).cast("long")), "height": F.coalesce(first["height"], F.lit(0).cast("long")), "duration": F.coalesce(p["format"]["duration"].try_cast("double"), F.lit(0.0)), "codec": F.coalesce(first["codec_name"], F.lit("unknown"))})


def split_frames(streams: DataFrame, content: str = "content") -> DataFrame:
    """Concatenated JPEG files, cut at their first and last markers: key columns, frame_number, frame. Bytes after the last whole frame are left."""
    keys = [c for c in streams.columns if c != content]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for values in rows.itertuples(index=False):
                row = dict(zip(rows.columns, values, strict=True))
                data, at, n = bytes(row[content] or b""), 0, 0
                while (a := data.find(b"\xff\xd8", at)) >= 0 and (b := data.find(b"\xff\xd9", a + 2)) >= 0:
                    out.append((*(row[k] for k in keys), n, data[a : b + 2]))
                    at, n = b + 2, n + 1
            yield pd.DataFrame(out, columns=[*keys, "frame_number", "frame"])

    kinds = dict(streams.dtypes)
    return streams.mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + (", " if keys else "") + "frame_number long, frame binary")


def extract_with(files: DataFrame, extractor: Callable[[bytes], str | None]) -> DataFrame:
    """path, text of binary documents by a function that can be plugged in (a PDF reader, say); its errors give null and a message."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for path, data in zip(rows["path"], rows["content"], strict=True):
                try:
                    out.append((path, extractor(bytes(data)), None))
                except Exception as e:  # noqa: BLE001  any reader's error is this file's alone
                    out.append((path, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, error string")


def metadata_json(**fields: Column) -> Column:
    """A row's metadata column."""
    return F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())))


def schema_of(spark: SparkSession, table: str) -> dict | None:
    """Column names and types of a catalogue table, None if there is none."""
    return json.loads(spark.table(table).schema.json()) if spark.catalog.tableExists(table) else None


def migration_version(history: DataFrame) -> DataFrame:
    return history.agg(F.coalesce(F.max("version"), F.lit(0).cast("long")).alias("version"))


def migration_history(history: DataFrame | None) -> list:
    """Applied migrations by version: version, name, description, applied_at, execution_time_ms; none where there is no such table."""
    if history is None:
        return []
    return history.select("version", "name", "description", "applied_at", "execution_time_ms").orderBy("version").collect()  # one row a migration


def needs_migration(history: DataFrame | None, version: int) -> bool:
    return version > (0 if history is None else migration_version(history).first()["version"])


def read_wav(files: DataFrame) -> DataFrame:
    """path, content of PCM WAV files: path, rate, channels, samples (interleaved, -1 to 1), error."""
    import io
    import wave

    import numpy as np

    def decode(data: bytes) -> tuple:
        with wave.open(io.BytesIO(data)) as w:
            width, raw = w.getsampwidth(), w.readframes(w.getnframes())
            if width == 1:
                samples = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
            elif width == 3:
                three = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
                samples = ((three[:, 0] << 8 | three[:, 1] << 16 | three[:, 2] << 24) >> 8) / float(1 << 23)
            else:
                samples = np.frombuffer(raw, f"<i{width}") / float(1 << (8 * width - 1))
            return float(w.getframerate()), w.getnchannels(), samples

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for path, data in zip(rows["path"], rows["content"], strict=True):
                try:
                    out.append((path, *decode(bytes(data)), None))
                except (wave.Error, EOFError, TypeError) as e:
                    out.append((path, None, None, None, str(e) or "not a WAV file"))
            yield pd.DataFrame(out, columns=["path", "rate", "channels", "samples", "error"]).astype({"channels": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, rate double, channels int, samples array<double>, error string")
