"""Spectral image files: planes of bands, XOR deltas along rows, compressed, behind a checked header.

A file is one image, so encoding gathers an image's pixels in one task; images are spread over tasks.
Tables: pixels (image, y, x, bands array<float>), files (path or image, content).
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.functions.press import press, unpress
from stratalog.model import IMAGE_MAGIC
from stratalog.operators.container import little_endian

#: Fixed values of the format: magic, version, flags, mode, width, height, bands, bits of a sample, wavelengths, hash.
HEADER = struct.Struct("<4sBBHIIHHff32s4x")
#: Bands of the spectral modes by code.
BANDS_OF_MODE = {0: 4, 1: 8, 2: 16}
PIXELS = "image string, y int, x int, bands array<float>"


def bands_for_mode(mode: Column) -> Column:
    """4, 8 or 16; -1 for an unknown mode."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in BANDS_OF_MODE.items() for x in pair]), mode.cast("int")), F.lit(-1))


def write_image(data: np.ndarray, low: float = 380.0, high: float = 780.0, level: int = 5) -> bytes:
    """data: height x width x bands, float32."""
    height, width, bands = data.shape
    mode = {n: m for m, n in BANDS_OF_MODE.items()}.get(bands)
    if mode is None:
        raise ValueError("an image has 4, 8 or 16 bands")
    data = np.ascontiguousarray(data, "<f4")
    out = [HEADER.pack(IMAGE_MAGIC, 1, 0, mode, width, height, bands, 32, low, high, hashlib.sha3_256(data.tobytes()).digest())]
    bits = data.view("<u4")
    for b in range(bands):
        plane = bits[:, :, b].copy()
        plane[:, 1:] ^= bits[:, :-1, b]
        body = press(plane.tobytes(), level)
        out += [len(body).to_bytes(8, "little"), body]
    return b"".join(out)


def read_image(content: bytes) -> np.ndarray:
    """height x width x bands. Raises ValueError for broken files."""
    if len(content) < HEADER.size or content[:4] != IMAGE_MAGIC or content[4] != 1:
        raise ValueError("no spectral image")
    _, _, _, _, width, height, bands, bits, _, _, digest = HEADER.unpack_from(content)
    if bits != 32 or bands not in BANDS_OF_MODE.values():
        raise ValueError("no spectral image of 32-bit samples")
    out, at = np.empty((height, width, bands), "<u4"), HEADER.size
    for b in range(bands):
        size = int.from_bytes(content[at : at + 8], "little")
        body = content[at + 8 : at + 8 + size]
        if len(body) != size:
            raise ValueError("a plane is cut short")
        plane = np.frombuffer(unpress(body), "<u4")
        if len(plane) != width * height:
            raise ValueError("a plane has the wrong size")
        out[:, :, b] = np.bitwise_xor.accumulate(plane.reshape(height, width), axis=1)
        at += 8 + size
    if hashlib.sha3_256(out.tobytes()).digest() != digest:
        raise ValueError("the pixels are not what the header says")
    return out.view("<f4")


def encode(pixels: DataFrame, *, low: float = 380.0, high: float = 780.0, level: int = 5) -> DataFrame:
    """image, content: a file for each image. Pixels that are missing are 0."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        data = np.zeros((int(rows.y.max()) + 1, int(rows.x.max()) + 1, len(rows.bands.iloc[0])), np.float32)
        data[rows.y.to_numpy(), rows.x.to_numpy()] = np.stack(rows.bands.to_list())
        return pd.DataFrame({"image": [rows.image.iloc[0]], "content": [write_image(data, low, high, level)]})

    return pixels.select(F.col("image").cast("string"), "y", "x", "bands").groupBy("image").applyInPandas(one, "image string, content binary")


def decode(files: DataFrame, name: str = "image") -> DataFrame:
    """The pixels of files (name, content); broken files raise."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for image, content in zip(b[name], b["content"], strict=True):
                data = read_image(bytes(content))
                for y, row in enumerate(data):
                    yield pd.DataFrame({"image": image, "y": y, "x": np.arange(len(row)), "bands": list(row)})

    return files.select(F.col(name).cast("string"), "content").mapInPandas(run, PIXELS)


def pixel(pixels: DataFrame, x: int, y: int) -> DataFrame:
    """That pixel of each image; none out of range."""
    return pixels.where((F.col("x") == x) & (F.col("y") == y))


def info(files: DataFrame, name: str = "image") -> DataFrame:
    """Header fields of spectral images; the planes are not touched."""
    c = F.col("content")
    return files.where((F.octet_length(c) >= HEADER.size) & (F.substring(c, 1, 4) == F.lit(IMAGE_MAGIC))).select(
        name, little_endian(c, 6, 2).cast("int").alias("mode"), little_endian(c, 8, 4).alias("width"), little_endian(c, 12, 4).alias("height"),
        little_endian(c, 16, 2).cast("int").alias("bands"), F.lower(F.hex(F.substring(c, 29, 32))).alias("hash"),
    )
