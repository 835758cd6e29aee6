"""Media columns: whole texts as baseline JPEG files, read back, with thumbnails and digests.

store() makes rows of media files, which the query writes as a table and reads again; scan() reads such a table (any baseline JPEG files, not
only carriers): it parses markers, Huffman-decodes the scans and keeps dimensions, a
thumbnail of the DC luminance and its average hash.

Edge cases: a null or empty text is a payload of 64 zero bytes; null media, and files that
are not baseline JPEG or end early, give null features and an error text; null doc_ids and
repeated rows are kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.llm import jpeg
from lumenweave.llm.common import documents, settle, table

#: Files are decoded side by side in groups of so many bytes.
GROUP = 1 << 20
SCANNED = "doc_id long, n_bytes long, width int, height int, thumbnail binary, average_hash string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, error string"


def _store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        texts = [bytes(t) if t is not None else b"" for t in rows["text"]]
        made = pd.DataFrame({"doc_id": rows["doc_id"].array, "n_bytes": [len(t) for t in texts]})
        made["media"] = [jpeg.encode(jpeg.pad(t)) for t in texts]
        yield made


def store(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes of the text in UTF-8, media (a JPEG file that holds it)."""
    raw = documents(docs).select("doc_id", F.col("text").cast("binary").alias("text"))
    return raw.mapInPandas(_store, "doc_id long, n_bytes long, media binary")


def _describe(frame: jpeg.Frame, coefs, thumbnails: bool) -> tuple:
    image = jpeg.thumbnail(frame, coefs)
    digest = f"{jpeg.average_hash(image):016x}"
    out = (frame.width, frame.height, image.tobytes() if thumbnails else None, digest)
    if frame.payload is None:
        return (*out, None, None, None)
    data = jpeg.payload(frame, coefs)
    return (*out, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))


def _decoded(files: list[bytes | None]) -> Iterator[tuple]:
    """For each file the frame and its coefficients, or an error."""
    parsed = []
    for f in files:
        try:
            parsed.append(jpeg.Frame(f) if f is not None else "no media")
        except (ValueError, IndexError, KeyError, AttributeError, struct.error) as e:
            parsed.append(str(e) or "not a JPEG file")
    good = [i for i, p in enumerate(parsed) if isinstance(p, jpeg.Frame)]
    coefs: dict = {}
    try:
        coefs = dict(zip(good, jpeg.coefficients([files[i] for i in good], [parsed[i] for i in good]), strict=True))
    except (ValueError, IndexError, KeyError):
        for i in good:  # one broken file: each by itself
            try:
                coefs[i] = jpeg.coefficients([files[i]], [parsed[i]])[0]
            except (ValueError, IndexError, KeyError) as e:
                parsed[i] = str(e) or "a broken scan"
    for i, p in enumerate(parsed):
        yield (p, coefs[i]) if i in coefs else (p, None)


def _scan(thumbnails: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            files = [bytes(f) if f is not None else None for f in rows["media"]]
            out, at = [], 0
            while at < len(files):
                end, held = at, 0
                while end < len(files) and (end == at or held + len(files[end] or b"") <= GROUP):
                    held += len(files[end] or b"")
                    end += 1
                for f, (p, coefs) in zip(files[at:end], _decoded(files[at:end]), strict=True):
                    stored = (len(f), hashlib.sha256(f).hexdigest()) if f is not None else (None, None)
                    seen = (None,) * 7 if coefs is None else _describe(p, coefs, thumbnails)
                    out.append((*seen, *stored, p if coefs is None else None))
                at = end
            names = ["width", "height", "thumbnail", "average_hash", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "error"]
            made = pd.DataFrame(out, columns=names).astype({n: "Int64" for n in ("width", "height", "payload_bytes", "tail_crc32", "media_bytes")})
            made.insert(0, "n_bytes", rows["n_bytes"].array)
            made.insert(0, "doc_id", rows["doc_id"].array)
            yield made

    return run


def scan(media: DataFrame, thumbnails: bool = True) -> DataFrame:
    """media: doc_id, n_bytes, media. Dimensions, thumbnail, hash, digests of what a carrier holds, and what is wrong with the others."""
    return media.select("doc_id", "n_bytes", "media").mapInPandas(_scan(thumbnails), SCANNED)


def write_media(docs: DataFrame, path: str) -> DataFrame:
    """Write the media table to a place of the caller's and read it back."""
    store(docs).write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.parquet(path)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = settle(store(table(spark, sf_dir, "documents")))  # the bytes that are described are those that were stored
    seen = scan(media, thumbnails=False)
    feature = F.concat_ws(":", F.concat_ws("x", "width", "height"), "average_hash").alias("feature")
    return seen.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature, "width", "height")


QUERIES = {"op3_media": op3_media}
