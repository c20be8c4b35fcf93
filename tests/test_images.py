"""Spectral image files and compressed streams: bit-exact round trips and broken files."""

import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.functions import press
from stratalog.operators import images, spectral


def gauss(bands, height=48, width=64):
    at = np.linspace(380, 780, bands)
    x = np.arange(width)[None, :, None]
    return np.broadcast_to(np.exp(-0.5 * ((at - 550) / 80) ** 2) * (x / 64 + 0.1), (height, width, bands)).astype(np.float32)


@pytest.mark.parametrize("bands", [4, 8, 16])
def test_images_come_back_bit_by_bit(bands):
    data = gauss(bands)
    assert images.read_image(images.write_image(data)).tobytes() == data.tobytes()


def test_broken_images_are_refused():
    odd = np.array([[[np.nan, -0.0, np.inf, 1e-45]]], np.float32)
    content = images.write_image(odd)
    assert images.read_image(content).tobytes() == odd.tobytes()
    for broken in (b"", content[:63], content[:-3], b"X" + content[1:], content[:30] + b"x" + content[31:]):
        with pytest.raises(ValueError):
            images.read_image(broken)
    with pytest.raises(ValueError):
        images.write_image(np.zeros((1, 1, 5), np.float32))


def test_images_as_tables(spark):
    data = gauss(8, 3, 5)
    rows = [("a", y, x, data[y, x].tolist()) for y in range(3) for x in range(5)] + [("b", 0, 0, [1.0] * 4), ("b", 1, 1, [2.0] * 4)]
    files = images.encode(spark.createDataFrame(rows, "image string, y int, x int, bands array<float>"))
    back = images.decode(files)
    got = {(r.image, r.y, r.x): r.bands for r in back.collect()}
    assert len(got) == 15 + 4 and got["b", 0, 1] == [0.0] * 4 and got["b", 1, 1] == [2.0] * 4
    assert all(np.float32(got["a", y, x]).tobytes() == data[y, x].tobytes() for y in range(3) for x in range(5))
    assert {(r.image, r["mode"], r.width, r.height, r.bands) for r in images.info(files).collect()} == {("a", 1, 5, 3, 8), ("b", 0, 2, 2, 4)}
    assert [r.image for r in images.pixel(back, 4, 2).collect()] == ["a"] and images.pixel(back, 9, 9).count() == 0
    modes = spark.range(4).select(images.bands_for_mode(F.col("id")).alias("n")).collect()
    assert [r.n for r in modes] == [4, 8, 16, -1]
    assert images.encode(spark.createDataFrame([], "image string, y int, x int, bands array<float>")).count() == 0


def test_streams():
    r = random.Random(1)
    cases = [b"", b"a", b"\xfe\xff" * 50, bytes(i & 15 for i in range(4096)), os.urandom(3000), b"the quick brown fox " * 999, bytes(300_000), bytes(r.choice(b"abcab") for _ in range(20_000))]
    for raw in cases:
        for level in (1, 9):
            packed = press.press(raw, level)
            assert press.unpress(packed) == raw and press.original_size(packed) == len(raw)
    packed = press.press(cases[5])
    assert len(packed) < 1000 and press.original_size(b"no stream") == 0
    for broken in (b"", packed[:15], packed[:-12], packed[:40] + bytes([packed[40] ^ 1]) + packed[41:], b"PRSX" + packed[4:]):
        with pytest.raises(ValueError):
            press.unpress(broken)


def test_streams_of_the_first_version():
    items = b"ab\xfe\x02\x00\x00\xff\xfe"
    raw = b"ababab\xfe"
    assert press.unmatched(items) == raw
    block = items
    stream = struct.pack("<4sBBHQ", b"PRSS", 1, 0, 0, len(raw)) + struct.pack("<II", len(block), press.xxhash.xxh32_intdigest(raw)) + block + bytes(8)
    assert press.unpress(stream) == raw


def test_longest_match_takes_the_first_of_equal_length():
    raw = b"abcdX" + b"abcdY" + b"abcdZ"
    assert press.longest_match(raw, 10, [5, 0]) == (5, 4) and press.longest_match(raw, 10, [0, 5]) == (10, 4) and press.longest_match(raw, 4, [0]) == (0, 0)


def test_matching_functions_from_a_table(spark):
    table = [(380.0, 0.0, 1.0, 2.0), (385.0, 1.0, 1.0, 0.0), (390.0, 3.0, 0.0, 0.0)]
    at = spark.createDataFrame([(379.0,), (380.0,), (382.5,), (386.0,), (390.0,), (391.0,)], "w double")
    got = at.select(*[spectral.matching(c, F.col("w"), table).alias(c) for c in "xyz"]).collect()
    assert [r.x for r in got] == pytest.approx([0, 0, 0.5, 1.4, 3, 0]) and [r.y for r in got] == pytest.approx([0, 1, 1, 0.8, 0, 0]) and [r.z for r in got] == pytest.approx([0, 2, 1, 0, 0, 0])
