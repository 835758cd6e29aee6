"""Token ids of whole texts by a tokenizer file, quickly.

The word tokenizer lower-cases, splits at white space and encodes each word between by
itself. So the ids of each stretch between white space are kept in a bounded table per
worker, and a text's ids are the joined entries of its stretches. Texts with characters on
which Python's lower() or white space could differ from the tokenizer's go through the
tokenizer whole, and so do all texts if the file's tokenizer is of another kind.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import regex
from tokenizers import Tokenizer, pre_tokenizers

from lumenweave.llm.common import WORKER

ENTRIES = 900_000
END = np.array([1], "<u4").tobytes()
#: Anything but Latin letters with accents (no dotted I) and common punctuation.
_ODD = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\u012f\u0131-\u017e\u2010-\u2015\u2018-\u201e\u2022\u2026\u20ac]")
# Fixed value: the pattern by which the word tokenizer's file splits.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORDS = regex.compile(SPLIT)
#: The name of the tables in WORKER.
KEPT = "tokens"


class _Table(dict):
    """Stretch -> its ids as little-endian 32-bit bytes. Emptied when full."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.by_stretch = True
        self.by_stretch = self._joins("Stra\u00dfe, it's 42%--x \n\u00c9T\u00c9\tend_of. \u00b2a")

    def _joins(self, text: str) -> bool:
        """Whether ids of the stretches of a lower-cased text join to the ids of the whole."""
        return b"".join(map(self.__getitem__, text.lower().split())) == self.whole(text)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, stretch: str) -> bytes:
        words = _WORDS.findall(stretch)
        if len(words) == 1:
            seen = stretch if stretch.isascii() else self.to_bytes.pre_tokenize_str(stretch)[0][0]
            ids = [t.id for t in self.model.tokenize(seen)]
            out = struct.pack(f"<{len(ids)}I", *ids)
        else:
            out = b"".join([self[w] for w in words])
        self[stretch] = out
        return out

    def of(self, text: str) -> bytes:
        if not self.by_stretch or _is_odd(text):
            return self.whole(text)
        if len(self) > ENTRIES:
            self.clear()
        return b"".join(map(self.__getitem__, text.lower().split()))


def _is_odd(text: str) -> bool:
    if "<|" in text or "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return True
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _ODD.search(text) is not None
    return False


def id_bytes(texts: list[str], path: str) -> Iterator[bytes]:
    """For each text its ids, then id 1, as little-endian unsigned 32-bit numbers."""
    tables = WORKER.setdefault(KEPT, {})
    known = tables.get(path)
    if known is None:
        known = tables[path] = _Table(path)
    for text in texts:
        yield known.of(text) + END
