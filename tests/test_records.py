"""Small records: round trips, cut data, published one-time codes."""

import pytest
from pyspark.sql import functions as F

from stratalog.functions import records


def test_sections(spark):
    data = records.write_sections([("PART", b"abc"), ("FBOX", b""), ("PART", b"second")])
    assert records.read_sections(data) == {"PART": b"abc", "FBOX": b""}
    assert records.read_sections(data[:-1]) == {"PART": b"abc", "FBOX": b""} and records.read_sections(data[:9]) == {}
    got = spark.createDataFrame([(bytearray(data),), (None,)], "trailer binary").select(records.sections("trailer").alias("s")).collect()
    assert bytes(got[0].s["PART"]) == b"abc" and got[1].s is None


def test_wraps():
    wraps, variants, refs = [(1, b"image"), (2, b"")], [("hdr", 1, 0, 1000000), ("proxy", 1, 1000000, 50000)], [(b"h" * 32, 1)]
    data = records.write_wraps(wraps, variants, refs)
    assert records.read_wraps(data) == {"wraps": wraps, "variants": variants, "refs": refs}
    assert records.read_wraps(data[:-1])["refs"] == [] and records.read_wraps(data[:20])["wraps"] == [] and records.read_wraps(b"") == {"wraps": [], "variants": [], "refs": []}
    with pytest.raises(ValueError):
        records.write_wraps([(1, b"")] * 17)


def test_tokens():
    data = records.write_token(5, 2, 9, b"claims")
    assert records.read_token(data) == (5, 2, 9, b"claims")
    for bad in (data[:-1], data + b"x", b"", b"\x02" + data[1:]):
        with pytest.raises(ValueError):
            records.read_token(bad)


@pytest.mark.parametrize("seconds,code", [(59, "94287082"), (1111111109, "07081804"), (20000000000, "65353130")])
def test_published_codes(seconds, code):
    secret = b"12345678901234567890"
    assert records.one_time_code(secret, seconds, digits=8) == code
    assert records.code_fits(secret, code, seconds + 30) and not records.code_fits(secret, code, seconds + 90)


@pytest.mark.parametrize("size", [0, 1, 255, 256, 257, 5000])
def test_block_order(size):
    data = bytes(i % 251 for i in range(size))
    mixed = records.shuffle_blocks(data, b"key")
    assert len(mixed) == size and records.unshuffle_blocks(mixed, b"key") == data
    assert size < 1000 or mixed != data


def test_expressions(spark):
    r = spark.range(1).select(records.vault_size(F.lit(0)), records.vault_size(F.lit(3)), records.commitment(F.lit(1), F.lit(None))).first()
    assert tuple(r)[:2] == (0, 220) and len(r[2]) == 64
