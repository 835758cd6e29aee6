"""Sets of 5-word shingles and MinHash signatures of whole texts, in numpy.

Words are hashed by prefix sums of a polynomial over the bytes of many texts at once, so
no word becomes a Python object. Shingles are 64-bit hashes of five word hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

WORDS = 5
_SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(_SPACES)] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
PIECE = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as a piece reaches."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, PIECE + 1)
            up, down = np.full(size, _BASE), np.full(size, _BASE_INVERSE)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up[:n], self.down[:n]


_powers = _Powers()


def _piece_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of lower-cased bytes."""
    raw = np.frombuffer(data, np.uint8)
    inner = np.concatenate([[False], ~_IS_SPACE[raw], [False]])
    edge = np.flatnonzero(inner[1:] != inner[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = _powers.upto(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    return start, _mix(h + (end - start).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """As _piece_words, for bytes of any length, cut at white space."""
    if len(data) <= PIECE:
        return _piece_words(data)
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and data[end] not in _SPACES:
            end += 1
        s, h = _piece_words(data[at:end])
        starts.append(s + at)
        hashes.append(h)
        at = end
    return np.concatenate(starts), np.concatenate(hashes)


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For each text its distinct shingles, in order; empty without words."""
    group: list[bytes] = []
    size = 0
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
        if group and size + len(data) > PIECE:
            yield from _group_sets(group)
            group, size = [], 0
        group.append(data)
        size += len(data) + 1
    if group:
        yield from _group_sets(group)


def _group_sets(group: list[bytes]) -> Iterator[np.ndarray]:
    start, words = word_hashes(b"\n".join(group))
    bounds = np.searchsorted(start, np.cumsum([0] + [len(d) + 1 for d in group]))
    n = len(words) - WORDS + 1
    runs = _mix(sum(words[j : j + n] * _PLACE[j] for j in range(WORDS))) if n > 0 else words[:0]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= WORDS:
            yield np.unique(runs[a : b - WORDS + 1])
        elif b > a:  # the whole sequence, marked by its length
            mark = np.array([(int(b - a) * 0x632BE59BD9B4E019) % (1 << 64)], np.uint64)
            yield _mix((words[a:b] * _PLACE[: b - a]).sum(keepdims=True) + mark)
        else:
            yield words[:0]


def set_name(shingles: np.ndarray) -> str | None:
    """Equal for equal sets only (128 bits); none for the empty set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).hexdigest() if len(shingles) else None


class MinHash:
    """The least value of each of n hash functions over a set."""

    def __init__(self, n: int, seed: int = 20240229):
        self.factors = np.random.default_rng(seed).integers(1, 1 << 32, n, dtype=np.uint32) | np.uint32(1)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        out = np.full(len(self.factors), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(shingles), 512):
            part = shingles[i : i + 512]
            high, low = (part >> np.uint64(32)).astype(np.uint32), part.astype(np.uint32)
            h = high[:, None] * self.factors
            h ^= low[:, None]
            h *= np.uint32(0x9E3779B1)
            np.minimum(out, h.min(axis=0), out=out)
        return out
