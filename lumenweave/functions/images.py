"""Images to vectors: decoding, the size and contrast that embedders expect, and search by an image.

Decoders (bytes to an array of height, width and three colours) and embedders are plugged in; what
comes along needs no library and no model: uncompressed PPM files, and an embedder of mean colours.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweave.operators.search import visual_search

Decoder = Callable[[bytes], np.ndarray]

# The side of an embedder's image, the Lanczos window, the contrast in per cent.
SIDE, LANCZOS, CONTRAST = 224, 3, 1.1


class ImageEmbedder(Protocol):
    width: int

    def encode_images(self, images: list[np.ndarray]) -> np.ndarray: ...


class ColourEmbedder:
    """Mean colours of a grid of cells, less the image's mean, scaled to length 1. It needs no model."""

    def __init__(self, cells: int = 8):
        self.cells, self.width = cells, cells * cells * 3

    def encode_images(self, images: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(images), self.width))
        for row, image in zip(out, images, strict=True):
            h, w = image.shape[0] // self.cells, image.shape[1] // self.cells
            grid = image[: h * self.cells, : w * self.cells].reshape(self.cells, h, self.cells, w, 3).mean(axis=(1, 3))
            x = (grid - grid.mean()).ravel()
            size = np.sqrt((x * x).sum())
            row[:] = x / size if size else 0.0
        return out


def decode_ppm(data: bytes) -> np.ndarray:
    """A binary PPM (P6) or PGM (P5) file of 8 bits."""
    m = re.match(rb"P([56])(?:\s+|\s*#[^\n]*\n)+(\d+)\s+(\d+)\s+(\d+)\s", data)
    if m is None or int(m[4]) != 255:
        raise ValueError("not a PPM file of 8 bits")
    width, height, colours = int(m[2]), int(m[3]), 3 if m[1] == b"6" else 1
    pixels = np.frombuffer(data, np.uint8, width * height * colours, m.end()).reshape(height, width, colours)
    return np.repeat(pixels, 3, axis=2) if colours == 1 else pixels


def _weights(size: int, to: int) -> np.ndarray:
    """Of each pixel of the new line, the weights of the old line's pixels."""
    scale = max(size / to, 1.0)
    at = (np.arange(to) + 0.5) * size / to
    x = (np.arange(size)[None, :] + 0.5 - at[:, None]) / scale
    w = np.where(np.abs(x) < LANCZOS, np.sinc(x) * np.sinc(x / LANCZOS), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def prepare(pixels: np.ndarray, side: int = SIDE) -> np.ndarray:
    """Resized to a square by a Lanczos window, with a little more contrast."""
    resized = np.einsum("yh,hwc->ywc", _weights(pixels.shape[0], side), pixels.astype(float))
    resized = np.clip(np.einsum("xw,ywc->yxc", _weights(pixels.shape[1], side), resized).round(), 0, 255)
    more = ((100 + CONTRAST) / 100) ** 2
    return np.clip(((resized / 255 - 0.5) * more + 0.5) * 255, 0, 255).astype(np.uint8)


def embed_images(files: DataFrame, embedder: ImageEmbedder, decode: Decoder = decode_ppm) -> DataFrame:
    """path, content: path, width, height, embedding, and an error where a file is no image."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for path, data in zip(rows["path"], rows["content"], strict=True):
                try:
                    pixels = decode(bytes(data))
                    vector = embedder.encode_images([prepare(pixels)])[0].tolist()
                    out.append((path, pixels.shape[1], pixels.shape[0], vector, None))
                except Exception as e:  # noqa: BLE001  any decoder's error is this file's alone
                    out.append((path, None, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=["path", "width", "height", "embedding", "error"]).astype({"width": "Int64", "height": "Int64"})

    return files.select("path", "content").mapInPandas(run, "path string, width long, height long, embedding array<double>, error string")


def image_query(image: str, embedder: ImageEmbedder, decode: Decoder = decode_ppm) -> list[float]:
    """The vector of an image that is given as base64."""
    if not image.strip():
        raise ValueError("the image is empty")
    try:
        data = base64.b64decode(image, validate=True)
    except binascii.Error as e:
        raise ValueError("the image is no base64") from e
    try:
        pixels = decode(data)
    except Exception as e:
        raise ValueError("the image cannot be read") from e
    return embedder.encode_images([prepare(pixels)])[0].tolist()


def search_by_image(items: DataFrame, image: str, embedder: ImageEmbedder, k: int = 20, decode: Decoder = decode_ppm) -> DataFrame:
    """The k items nearest to an image, frames of one video each by itself."""
    return visual_search(items.where(F.col("embedding").isNotNull()), image_query(image, embedder, decode), k)
