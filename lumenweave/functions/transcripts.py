"""Packing of transcripts whose segments fill several tasks.

Packing is a loop: a chunk ends before the segment that would carry it too far. What the loop
carries from one segment to the next is only how many of the last segments are still open, at
most max_segments. So a block of neighbouring segments is a table from what is open on entry
(none, or the last 1 to max_segments segments before the block) to what is open on exit, how
many chunks begin in it and where the first one does; all of these are found without knowing
the entry. The tables of a transcript, a few numbers a block, are then followed in order, and
every block is packed on its own, with the few segments of the next block in which its last
chunk ends. No task reads a transcript.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweave.functions.text import MAX_BYTES, MAX_SEGMENTS
from lumenweave.operators.ranks import numbered
from lumenweave.sources.shared import settle

#: Segments of a block.
BLOCK = 4096


def chunk_ends(sizes: list[int], max_bytes: int = MAX_BYTES, max_segments: int = MAX_SEGMENTS) -> list[int]:
    """For each segment, if a chunk begins with it: the segment before which that chunk ends (len(sizes): not within these)."""
    out = []
    for i, size in enumerate(sizes):
        j = i + 1
        while j < len(sizes) and j - i < max_segments and size + sizes[j] + 1 <= max_bytes:
            size += sizes[j] + 1
            j += 1
        out.append(j)
    return out


def transitions(before: list[int], own: list[int], max_bytes: int = MAX_BYTES, max_segments: int = MAX_SEGMENTS) -> tuple[list[int], list[int], list[int]]:
    """before: sizes of the segments that precede a block (at most max_segments), own: the block's.

    By the number of open segments on entry: the number on exit, the number of chunks that begin in the block, and the
    place of the first of them (len(own): none).
    """
    k, sizes = len(before), before + own
    ends = chunk_ends(sizes, max_bytes, max_segments)
    exits, begun = [0] * len(sizes), [0] * len(sizes)
    for i in range(len(sizes) - 1, -1, -1):
        nxt = ends[i]
        whole = nxt < len(sizes)
        exits[i] = exits[nxt] if whole else len(sizes) - i
        begun[i] = (i >= k) + (begun[nxt] if whole else 0)
    out = ([], [], [])
    for m in range(len(before) + 1):
        start = k - m
        first = start
        while first < k and first < len(sizes):
            first = ends[first]
        values = (exits[start], begun[start], min(first, len(sizes)) - k) if start < len(sizes) else (0, 0, 0)
        for column, v in zip(out, values, strict=True):
            column.append(v)
    return out


def _by_block(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole blocks from batches that are sorted by key and block."""
    held = None
    for part in rows:
        held = part if held is None else pd.concat([held, part], ignore_index=True)
        edges = (held["__k"].ne(held["__k"].shift()) | held["__block"].ne(held["__block"].shift())).to_numpy().nonzero()[0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield held.iloc[a:b]
        held = held.iloc[edges[-1] :].reset_index(drop=True) if len(edges) else held
    if held is not None and len(held):
        yield held


def _tables(max_bytes: int, max_segments: int):
    def run(batches):
        for rows in _by_block(batches):
            before, own = rows.loc[rows["__role"] == 0, "__n"].tolist(), rows.loc[rows["__role"] == 1, "__n"].tolist()
            if own:
                exits, begun, first = transitions(before, own, max_bytes, max_segments)
                yield pd.DataFrame({"__k": [rows["__k"].iloc[0]], "__block": [rows["__block"].iloc[0]], "exits": [exits], "begun": [begun], "first": [first]})

    return run


def _follow(batches):
    """Tables come by key and in order of their blocks."""
    key, m, index = None, 0, 0
    for rows in batches:
        out = []
        for k, block, exits, begun, first in zip(rows["__k"], rows["__block"], rows["exits"], rows["begun"], rows["first"], strict=True):
            if k != key:
                key, m, index = k, 0, 0
            out.append((k, block, index, int(first[m])))
            m, index = int(exits[m]), index + int(begun[m])
        yield pd.DataFrame(out, columns=["__k", "__block", "index", "first"])


def _packed(max_bytes: int, max_segments: int):
    def run(batches):
        for rows in _by_block(batches):
            rows = rows[rows["__role"] > 0]
            own, sizes = int((rows["__role"] == 1).sum()), rows["__n"].tolist()
            if not own:
                continue
            ends = chunk_ends(sizes, max_bytes, max_segments)
            texts, starts, stops = rows["__t"].tolist(), rows["__a"].tolist(), rows["__b"].tolist()
            i, index, out = int(rows["first"].iloc[0]), int(rows["index"].iloc[0]), []
            while i < own:
                j = ends[i]
                out.append((rows["__k"].iloc[0], index, " ".join(texts[i:j]), starts[i], stops[j - 1]))
                i, index = j, index + 1
            yield pd.DataFrame(out, columns=["__k", "chunk_index", "chunk_text", "time_start", "time_end"])

    return run


def transcript_chunks_in_blocks(segments: DataFrame, keys: list[str], order: str = "seg_no", max_bytes: int = MAX_BYTES, max_segments: int = MAX_SEGMENTS, block: int = BLOCK) -> DataFrame:
    """What functions.text.transcript_chunks gives, with every transcript dealt over blocks of so many segments (max_segments at least)."""
    block = max(block, max_segments)
    held = segments.withColumn("__k", F.to_json(F.struct(*keys))).where(F.trim("text") != "")
    rows = numbered(held.select("__k", order, "start_s", "end_s", "text"), ["__k"], [order, "start_s", "end_s", "text"])
    # a missing end is no number, which greatest() below must not see
    rows = rows.select("__k", "pos", F.greatest("start_s", F.lit(0.0)).alias("__a"), F.coalesce("end_s", F.lit(float("-inf"))).alias("__b"), F.trim("text").alias("__t"))
    rows = settle(rows.withColumns({"__n": F.octet_length("__t").cast("long"), "__block": F.expr(f"pos div {block}")}), "segments")
    at = F.col("pos") % block
    # roles: 0 precedes the block, 1 is its own, 2 follows it
    near = lambda role, shift, when: rows.where(when).withColumns({"__role": F.lit(role), "__block": F.col("__block") + shift})
    own, before, after = near(1, 0, F.lit(True)), near(0, 1, at >= block - max_segments), near(2, -1, (at < max_segments) & (F.col("__block") > 0))
    sizes = own.select("__k", "__block", "__role", "pos", "__n").unionByName(before.select("__k", "__block", "__role", "pos", "__n"))
    tables = sizes.repartition("__k", "__block").sortWithinPartitions("__k", "__block", "pos").mapInPandas(_tables(max_bytes, max_segments), "__k string, __block long, exits array<int>, begun array<int>, first array<int>")
    followed = tables.repartition("__k").sortWithinPartitions("__k", "__block").mapInPandas(_follow, "__k string, __block long, index long, first int")  # one row a block
    whole = own.unionByName(after).join(settle(followed, "blocks"), ["__k", "__block"])
    chunks = whole.repartition("__k", "__block").sortWithinPartitions("__k", "__block", "pos").mapInPandas(_packed(max_bytes, max_segments), "__k string, chunk_index long, chunk_text string, time_start double, time_end double")
    chunks = chunks.withColumn("__k", F.from_json("__k", segments.select(*keys).schema))
    tokens = F.size(F.regexp_extract_all("chunk_text", F.lit(r"((?U)\S+)"), 1))
    return chunks.select(*(F.col("__k")[k].alias(k) for k in keys), "chunk_index", "chunk_text", "time_start", F.greatest("time_end", "time_start").alias("time_end"), tokens.cast("long").alias("token_estimate"))
