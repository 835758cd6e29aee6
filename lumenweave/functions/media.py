"""Sampling policies of videos, frame timelines and hashes, and pure audio steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HD = 1920.0 * 1080.0
# Fixed values: (up to so many seconds, frames a second above HD, at or below HD).
FAST = [(5.0, 0.5, 0.5), (30.0, 0.2, 0.33), (300.0, 0.1, 0.15), (None, 0.033, 0.05)]
NORMAL = [(10.0, 1.0, 1.5), (30.0, 0.5, 0.75), (300.0, 0.25, 0.33), (1800.0, 0.1, 0.15), (None, 0.05, 0.1)]
# Fixed values by content type: base frames a second, similarity threshold.
BASE_FPS = {"talking_head": 0.2, "static": 0.05, "action": 1.5, "mixed": 0.8}
SIMILARITY = {"talking_head": 0.95, "static": 0.97, "action": 0.75}


def _ladder(steps, duration: Column, large: Column) -> Column:
    out = None
    for upto, high, low in reversed(steps):
        rate = F.when(large, high).otherwise(low)
        out = rate if out is None else F.when(duration <= upto, rate).otherwise(out)
    return out


def fps_fast(duration: Column, width: Column, height: Column) -> Column:
    return _ladder(FAST, duration, width.cast("double") * height > HD)


def fps_normal(duration: Column, width: Column, height: Column) -> Column:
    return _ladder(NORMAL, duration, width.cast("double") * height > HD)


def _minutes(duration: Column) -> Column:
    return F.floor(F.floor(duration) / 60).cast("long")


def content_type(duration: Column, width: Column, height: Column, size_bytes: Column) -> Column:
    """Whole minutes and whole MB, as rates are judged."""
    ratio, mb, minutes = width.cast("double") / F.nullif(height.cast("double"), F.lit(0.0)), F.floor(size_bytes / (1024 * 1024)).cast("long"), _minutes(duration)
    wide = ratio > 1.7
    return (
        F.when((ratio < 1.0) | (F.abs(ratio - 1.0) < 0.2), "talking_head").when((duration < 120.0) & ~wide, "talking_head").when((duration > 1800.0) & (mb < minutes * 10), "static")
        .when((mb > minutes * 50) & (width >= 1920), "action").when((duration < 60.0) & (mb < 20), "talking_head").when(wide & (duration > 300.0), "action").otherwise("mixed")
    )


def motion_level(kind: Column, duration: Column, size_bytes: Column) -> Column:
    mb, minutes = F.floor(size_bytes / (1024 * 1024)).cast("long"), _minutes(duration)
    return (
        F.when(kind == "talking_head", F.when((duration > 600.0) | (mb < minutes * 5), 0.1).otherwise(0.2)).when(kind == "static", 0.05)
        .when(kind == "action", F.when(mb > minutes * 30, 0.9).otherwise(0.7)).otherwise(0.5)
    )


def _by_kind(kind: Column, values: dict[str, float], other: float) -> Column:
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def smart_fps(kind: Column, motion: Column, requested: Column) -> Column:
    """The floor of 0.1 holds even below the requested rate, but for static content."""
    rate = _by_kind(kind, BASE_FPS, 1.0) * (F.lit(0.5) + motion * 0.5) * F.when(kind == "talking_head", 0.5).otherwise(1.0)
    return F.greatest(F.least(rate, requested), F.when(kind == "static", 0.02).otherwise(0.1))


def similarity_threshold(kind: Column) -> Column:
    return _by_kind(kind, SIMILARITY, 0.85)


def expected_frames(duration: Column, fps: Column) -> Column:
    return F.floor(duration * fps).cast("long")


def frame_numbers(duration: Column, fps: Column) -> Column:
    """Array of frame numbers from 0; their time is number / fps."""
    n = expected_frames(duration, fps)
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))


def kept_frames(hashes: Column, threshold: Column) -> Column:
    """Of an array of 64-bit hashes in order, the places of frames not too like the last kept one."""
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<int>").alias("kept"), F.lit(0).alias("at"))

    def step(s: Column, h: Column) -> Column:
        like = s["last"].isNotNull() & (F.lit(1.0) - F.bit_count(s["last"].bitwiseXOR(h)) / F.lit(64.0) > threshold)
        return F.struct(F.when(like, s["last"]).otherwise(h).alias("last"), F.when(like, s["kept"]).otherwise(F.array_append(s["kept"], s["at"])).alias("kept"), (s["at"] + 1).alias("at"))

    return F.aggregate(hashes, start, step, lambda s: s["kept"])


def kept_frame_rows(frames: DataFrame, keys: list[str], order: str, hash_column: str, threshold: float) -> DataFrame:
    """kept_frames over rows: frames (one row each) that are not too like the last kept one of their video. What is held is one hash, so a video of any length is read in linear time."""
    kinds = dict(frames.dtypes)
    bits = np.array([bin(i).count("1") for i in range(256)], np.uint8)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video, last = None, 0
        for rows in batches:
            keep = []
            for k, h in zip(rows["__k"], rows[hash_column].to_numpy(), strict=True):
                like = k == video and 1.0 - int(bits[np.frombuffer((int(h) ^ last).to_bytes(8, "little", signed=True), np.uint8)].sum()) / 64.0 > threshold
                keep.append(not like)
                if not like:
                    video, last = k, int(h)
            yield rows[keep].drop(columns="__k")

    held = frames.withColumn("__k", F.to_json(F.struct(*keys))).repartition("__k").sortWithinPartitions("__k", order)
    return held.mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in frames.columns))


def signal_stats(samples: Column) -> Column:
    """struct(low, high, mean, rms, quiet) of an array of samples; quiet below an RMS of 0.001."""
    n = F.size(samples)
    total = lambda f: F.aggregate(samples, F.lit(0.0), lambda s, x: s + f(x.cast("double")))
    rms = F.sqrt(F.try_divide(total(lambda x: x * x), n))
    return F.struct(F.array_min(samples).alias("low"), F.array_max(samples).alias("high"), F.try_divide(total(lambda x: x), n).alias("mean"), rms.alias("rms"), (rms < 0.001).alias("quiet"))


def mono(samples: Column, channels: Column) -> Column:
    """Interleaved samples averaged over channels."""
    frames = F.floor(F.size(samples) / channels).cast("int")
    mean = lambda i: F.aggregate(F.slice(samples, i * channels + 1, channels), F.lit(0.0), lambda s, x: s + x.cast("double")) / channels
    return F.when(frames > 0, F.transform(F.sequence(F.lit(0), frames - 1), mean)).otherwise(F.array().cast("array<double>"))


def normalise_peak(samples: Column) -> Column:
    peak = F.array_max(F.transform(samples, lambda x: F.abs(x)))
    return F.when(peak > 0, F.transform(samples, lambda x: x / peak)).otherwise(samples)


def resample(samples: Column, rate: Column, to: int = 16_000) -> Column:
    """Nearest samples at another rate."""
    n = F.floor(F.size(samples) * F.lit(float(to)) / rate).cast("int")
    pick = lambda i: F.get(samples, F.least(F.floor(i * rate / F.lit(float(to))).cast("int"), F.size(samples) - 1))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), pick)).otherwise(F.slice(samples, F.lit(1), F.lit(0)))


def timestamp_tokens(tokens: Column, first: int = 50364, last: int = 51864, step: float = 0.02) -> Column:
    """Array of struct(start_s, end_s, tokens): runs of text tokens between timestamp tokens; a run left open ends a second later."""
    seg = "struct<start_s:double,end_s:double,tokens:array<int>>"
    begin = F.struct(F.array().cast(f"array<{seg}>").alias("done"), F.lit(None).cast("double").alias("start"), F.lit(0.0).alias("last"), F.array().cast("array<int>").alias("held"))

    def made(s: Column, end: Column) -> Column:
        return F.struct(F.coalesce(s["start"], s["last"]).alias("start_s"), end.alias("end_s"), s["held"].alias("tokens")).cast(seg)

    def one(s: Column, t: Column) -> Column:
        is_time, at = (t >= first) & (t < last), (t - first) * F.lit(step)
        full = F.size(s["held"]) > 0
        return F.struct(
            F.when(is_time & full, F.array_append(s["done"], made(s, at))).otherwise(s["done"]).alias("done"),
            F.when(is_time & ~full, at).when(is_time, F.lit(None).cast("double")).otherwise(s["start"]).alias("start"),
            F.when(is_time, at).otherwise(s["last"]).alias("last"),
            F.when(is_time, F.array().cast("array<int>")).otherwise(F.array_append(s["held"], t.cast("int"))).alias("held"),
        )

    end = lambda s: F.when(F.size(s["held"]) > 0, F.array_append(s["done"], made(s, F.coalesce(s["start"], s["last"]) + 1.0))).otherwise(s["done"])
    return F.aggregate(tokens, begin, one, end)


def speech_only(segments: Column, no_speech: float = 0.8, logprob: float = -1.0, most: int = 1000) -> Column:
    """Of an array of structs with no_speech_prob and avg_logprob, those that are not silence; at most the first so many."""
    silent = lambda s: (s["no_speech_prob"] > no_speech) & (s["avg_logprob"] < logprob)
    return F.slice(F.filter(segments, lambda s: ~F.coalesce(silent(s), F.lit(False))), 1, most)


def path_id(path: Column) -> Column:
    """A path as part of an id: everything but letters and digits is '_'."""
    return F.regexp_replace(path, r"[^A-Za-z0-9]", "_")


def frame_row(path: Column, frame: Column, fps: Column, width: Column, height: Column, duration: Column) -> Column:
    """struct(id, timestamp, metadata) of a sampled frame; the id is the same at every run."""
    at = frame / fps
    meta = F.to_json(F.struct(F.lit("video_frame").alias("source_type"), width.alias("width"), height.alias("height"), frame.alias("frame_number"), at.alias("timestamp"), duration.alias("video_duration")))
    return F.struct(F.concat(path_id(path), F.lit(":frame:"), frame.cast("string")).alias("id"), at.alias("timestamp"), meta.alias("metadata"))


def image_metadata(width: Column, height: Column, size: Column) -> Column:
    ratio = F.round(width / F.nullif(height, F.lit(0)), 4)
    return F.to_json(F.struct(F.struct(width.alias("width"), height.alias("height")).alias("dimensions"), ratio.alias("aspect_ratio"), size.alias("file_size")))
