"""Embedders: anything with a width and encode(texts) can be plugged in."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that are embedded at once, and tokens whose buckets a task keeps.
GROUP, KNOWN = 1 << 20, 1 << 16


class Embedder(Protocol):
    width: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Counts of tokens by the first six hex digits of their md5, modulo width, scaled to length 1. It needs no model."""

    def __init__(self, width: int = 64):
        self.width = width
        self._known: dict[str, int] = {}

    def bucket(self, token: str) -> int:
        found = self._known.get(token)
        if found is None:
            if len(self._known) > KNOWN:
                self._known.clear()
            found = self._known[token] = int(hashlib.md5(token.encode()).hexdigest()[:6], 16) % self.width
        return found

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width))
        for row, text in zip(out, texts, strict=True):
            tokens = (text or "").split()
            if tokens:
                row += np.bincount([self.bucket(t) for t in tokens], minlength=self.width)
                row /= np.sqrt((row * row).sum())
        return out


def _groups(texts: pa.Array) -> Iterator[list[str]]:
    """The texts of a batch, null ones as empty, a list for every GROUP characters or a longer text."""
    held, size = [], 0
    for value in texts:
        held.append(value.as_py() or "")
        size += len(held[-1])
        if size >= GROUP:
            yield held
            held, size = [], 0
    if held:
        yield held


def _embedded(embedder: Embedder):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [np.asarray(embedder.encode(group), float) for group in _groups(texts)]
            width = parts[0].shape[1] if parts else 0
            values = pa.array(np.concatenate(parts).ravel() if parts else [], pa.float64())
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * width, pa.int32()), values)

    return run


def embed(text: Column, embedder: Embedder) -> Column:
    """An array<double> column; texts go to the embedder from Arrow batches in groups, once loaded in a task."""

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _embedded(embedder)(batches)

    return run(text)
