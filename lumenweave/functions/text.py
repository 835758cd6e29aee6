"""Text functions: token windows, transcript packing, ids, prompts, formatting."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

WINDOW = 800
OVERLAP = 120
MAX_BYTES = 420
MAX_SEGMENTS = 6
SNIPPET = 360


def is_blank(text: Column) -> Column:
    return F.coalesce(~text.rlike(r"(?U)\S"), F.lit(True))


#: Words by white space as Unicode has it, which is what (?U)\\s is on the JVM.
_WORD = re.compile(r"[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_CHUNKS = (("chunk_index", "long", pa.int64()), ("chunk_text", "string", pa.string()), ("char_start", "long", pa.int64()), ("char_end", "long", pa.int64()), ("token_estimate", "long", pa.int64()))

#: Characters of the chunks that leave a task at once.
GROUP = 1 << 20


def windows(text: str, window: int = WINDOW, overlap: int = OVERLAP) -> list[dict]:
    """The chunks of one text, in one pass: words are found once, and bytes are counted on from chunk to chunk."""
    words = [m.span() for m in _WORD.finditer(text)]
    step, out, places = window - overlap, [], {}
    for first in range(0, max(1, len(words) - overlap) if words else 0, step):
        last = min(first + window, len(words)) - 1
        out.append((words[first][0], words[last][1], last - first + 1))
    at = size = 0
    for place in sorted({p for a, b, _ in out for p in (a, b)}):
        size += len(text[at:place].encode("utf-8", "surrogatepass"))
        at, places[place] = place, size
    return [{"chunk_index": i, "chunk_text": text[a:b], "char_start": places[a], "char_end": places[b], "token_estimate": n} for i, (a, b, n) in enumerate(out)]


def _cut(names: list[str], window: int, overlap: int):
    """Batches of kept columns and, last, texts become batches of kept columns and chunks."""
    kept = len(names) - len(_CHUNKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, rows, size = [], [], 0

            def made() -> pa.RecordBatch:
                at = pa.array(rows, pa.int64())
                own = [batch.column(i).take(at) for i in range(kept)]
                return pa.RecordBatch.from_arrays([*own, *(pa.array([c[name] for c in held], kind) for name, _, kind in _CHUNKS)], names=names)

            for row, value in enumerate(batch.column(kept)):
                t = value.as_py()
                for c in windows(t, window, overlap) if isinstance(t, str) else []:
                    held.append(c)
                    rows.append(row)
                    size += len(c["chunk_text"])
                    if size >= GROUP:
                        yield made()
                        held, rows, size = [], [], 0
            if held:
                yield made()

    return run


def token_chunks(docs: DataFrame, text: str = "text", window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """docs without text, and per window of tokens: chunk_index, chunk_text, char_start and char_end (bytes, as in UTF-8), token_estimate.

    A text of n tokens has one chunk up to window tokens, else ceil((n - window) / step) + 1; blank texts have none. Time
    is linear in a text's length. A task holds Spark's Arrow batch (64 MB, or a longer row), the chunks of one text and
    GROUP characters of chunks; texts are read from the batch one by one.
    """
    kept = [c for c in docs.columns if c != text]
    schema = StructType([docs.schema[c] for c in kept])
    for name, kind, _ in _CHUNKS:
        schema = schema.add(name, kind)

    return docs.select(*kept, text).mapInArrow(_cut(schema.names, window, overlap), schema)


def chunk_count(text: Column, window: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """The number of chunks that token_chunks makes of a text, without making them: by its number of words, in a built-in expression."""
    n = F.length(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\S+", "x"), r"(?U)\s+", ""))
    return F.when(n == 0, 0).when(n <= window, 1).otherwise(F.ceil((n - window) / F.lit(window - overlap)) + 1).cast("long")


def _pack(max_bytes: int, max_segments: int):
    """Rows come by key, in order; the open chunk is all that is held. A chunk may go on in the next batch."""

    def run(batches):
        import pandas as pd

        columns = ["__k", "chunk_index", "chunk_text", "time_start", "time_end"]
        key, index, texts, size, start, end = None, 0, [], 0, None, None
        for rows in batches:
            out = []
            for k, a, b, t in zip(rows["__k"], rows["__a"], rows["__b"], rows["__t"], strict=True):
                n = len(t.encode("utf-8", "surrogatepass"))
                if texts and k == key and size + n + 1 <= max_bytes and len(texts) < max_segments:
                    texts.append(t)
                    size, end = size + n + 1, b
                    continue
                if texts:
                    out.append((key, index, " ".join(texts), start, end))
                key, index = k, index + 1 if texts and k == key else 0
                texts, size, start, end = [t], n, a, b
            yield pd.DataFrame(out, columns=columns)
        if texts:
            yield pd.DataFrame([(key, index, " ".join(texts), start, end)], columns=columns)

    return run


def transcript_chunks(segments: DataFrame, keys: list[str], order: str = "seg_no", max_bytes: int = MAX_BYTES, max_segments: int = MAX_SEGMENTS) -> DataFrame:
    """Packed chunks of each transcript: keys, chunk_index, chunk_text, time_start, time_end, token_estimate.

    A chunk ends before the segment that would carry it past max_bytes (with a joining space), or after max_segments. A
    transcript's rows are sorted in one task, which may spill, and read one by one; none is gathered in a row.
    """
    held = segments.withColumn("__k", F.to_json(F.struct(*keys))).where(F.trim("text") != "").repartition("__k").sortWithinPartitions("__k", order, "start_s", "end_s", "text")
    # a missing end is no number, which greatest() below must not see
    rows = held.select("__k", F.greatest("start_s", F.lit(0.0)).alias("__a"), F.coalesce("end_s", F.lit(float("-inf"))).alias("__b"), F.trim("text").alias("__t"))
    chunks = rows.mapInPandas(_pack(max_bytes, max_segments), "__k string, chunk_index long, chunk_text string, time_start double, time_end double")
    chunks = chunks.withColumn("__k", F.from_json("__k", segments.select(*keys).schema))
    tokens = F.size(F.regexp_extract_all("chunk_text", F.lit(r"((?U)\S+)"), 1))
    return chunks.select(*(F.col("__k")[k].alias(k) for k in keys), "chunk_index", "chunk_text", "time_start", F.greatest("time_end", "time_start").alias("time_end"), tokens.cast("long").alias("token_estimate"))


def chunk_id(kind: str, path: Column, text: Column, index: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), path, F.md5(text), index.cast("string"))


def as_query(text: Column) -> Column:
    return F.concat(F.lit("search_query: "), F.trim(text))


def as_document(text: Column) -> Column:
    return F.concat(F.lit("search_document: "), F.trim(text))


def snippet(text: Column, most: int = SNIPPET) -> Column:
    clean = F.trim(text)
    return F.when(F.length(clean) > most, F.concat(F.substring(clean, 1, most), F.lit("..."))).otherwise(clean)


def one_line(text: Column, most: int = 220) -> Column:
    """White space collapsed, cut with an ellipsis."""
    clean = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(clean) > most, F.concat(F.substring(clean, 1, most), F.lit("..."))).otherwise(clean)


def clock(seconds: Column) -> Column:
    """HH:MM:SS, or MM:SS below an hour."""
    s = F.floor(F.greatest(seconds.cast("double"), F.lit(0.0))).cast("long")
    h, m, rest = F.floor(s / 3600).cast("long"), F.floor((s % 3600) / 60).cast("long"), s % 60
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, rest)).otherwise(F.format_string("%02d:%02d", m, rest))


def bytes_text(n: Column) -> Column:
    """0 B, 512 B, 1.5 KB, ..., GB."""
    x = n.cast("double")
    sized = F.format_string("%.0f B", x)
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        sized = F.when(x >= 1024.0**power, F.format_string(f"%.1f {unit}", x / 1024.0**power)).otherwise(sized)
    return F.when(x.isNull() | F.isnan(x) | (x <= 0), F.lit("0 B")).otherwise(sized)


def url_text(path: Column) -> Column:
    return F.try_url_decode(path)


def strip_markup(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", " "), r"(?U)\s+", " "))


def hash_similarity(a: Column, b: Column) -> Column:
    """Share of equal bits of two 64-bit hashes."""
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)
