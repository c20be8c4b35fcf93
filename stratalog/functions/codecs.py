"""Hashes and codecs that Spark has no expression for, as Arrow-batched UDFs, and byte statistics."""

from __future__ import annotations

import base64
import hashlib
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.functions import press as streams
from stratalog.functions.press import SCALE, normalise

BLOCK = 256 << 10


def _raw(x) -> bytes | None:
    return None if x is None else x.encode() if isinstance(x, str) else bytes(x)


@F.pandas_udf(T.StringType())
def sha3_256(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else hashlib.sha3_256(_raw(x)).hexdigest())


@F.pandas_udf(T.StringType())
def shake_256(values: pd.Series, sizes: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else hashlib.shake_256(_raw(x)).hexdigest(int(n)) for x, n in zip(values, sizes, strict=True)])


@F.pandas_udf(T.LongType())
def xxhash32(values: pd.Series, seeds: pd.Series) -> pd.Series:
    import xxhash

    return pd.Series([None if x is None else xxhash.xxh32_intdigest(_raw(x), int(s)) for x, s in zip(values, seeds, strict=True)], dtype="Int64")


@F.pandas_udf(T.BinaryType())
def base32_decode(values: pd.Series) -> pd.Series:
    """Without regard to case, blanks and missing padding; null for other characters."""

    def one(x):
        if x is None:
            return None
        x = x.replace(" ", "").replace("-", "").rstrip("=").upper()
        try:
            return base64.b32decode(x + "=" * (-len(x) % 8))
        except ValueError:
            return None

    return values.map(one)


def pack_bytes(raw: bytes, level: int = 5) -> bytes:
    """Blocks of at most 256 KiB, each with its sizes and checksum, after a header with the whole size."""
    out = [b"SLPK\x01", len(raw).to_bytes(8, "little")]
    for at in range(0, len(raw), BLOCK):
        part = raw[at : at + BLOCK]
        packed = zlib.compress(part, level)
        kind, body = (1, packed) if len(packed) < len(part) else (0, part)
        out += [bytes([kind]), len(body).to_bytes(4, "little"), zlib.crc32(part).to_bytes(4, "little"), body]
    return b"".join(out)


def unpack_bytes(data: bytes) -> bytes:
    """Raises ValueError where data is cut short or a checksum differs."""
    if data[:5] != b"SLPK\x01" or len(data) < 13:
        raise ValueError("not a packed stream")
    whole, at, out = int.from_bytes(data[5:13], "little"), 13, []
    while at < len(data):
        if len(data) < at + 9:
            raise ValueError("cut short")
        kind, size, check = data[at], int.from_bytes(data[at + 1 : at + 5], "little"), int.from_bytes(data[at + 5 : at + 9], "little")
        body = data[at + 9 : at + 9 + size]
        if len(body) != size:
            raise ValueError("cut short")
        try:
            part = zlib.decompress(body) if kind else body
        except zlib.error as e:
            raise ValueError("broken block") from e
        if zlib.crc32(part) != check:
            raise ValueError("broken block")
        out.append(part)
        at += 9 + size
    raw = b"".join(out)
    if len(raw) != whole:
        raise ValueError("cut short")
    return raw


@F.pandas_udf(T.BinaryType())
def pack(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else pack_bytes(_raw(x)))


@F.pandas_udf(T.BinaryType())
def unpack(values: pd.Series) -> pd.Series:
    """Null for what can't be unpacked."""

    def one(x):
        try:
            return None if x is None else unpack_bytes(bytes(x))
        except ValueError:
            return None

    return values.map(one)


@F.pandas_udf(T.BinaryType())
def press(values: pd.Series) -> pd.Series:
    """The compressed stream format of packed assets."""
    return values.map(lambda x: None if x is None else streams.press(_raw(x)))


@F.pandas_udf(T.BinaryType())
def unpress(values: pd.Series) -> pd.Series:
    """Null for what is no whole stream."""

    def one(x):
        try:
            return None if x is None else streams.unpress(bytes(x))
        except ValueError:
            return None

    return values.map(one)


def byte_histogram(payloads: DataFrame, payload: str, *by: str) -> DataFrame:
    """symbol (0 to 255), n of the bytes of a binary or text column, per group: counted a batch at a time, then summed."""
    import numpy as np
    import pyarrow as pa

    keys = payloads.select(*by).schema
    schema = T.StructType([*keys.fields, T.StructField("symbol", T.IntegerType()), T.StructField("n", T.LongType())])

    def run(batches):
        for batch in batches:
            held: dict = {}
            columns = [batch.column(i).to_pylist() for i in range(len(by))]
            for key, data in zip(zip(*columns, strict=True) if by else ((),) * batch.num_rows, batch.column(len(by)).cast(pa.binary()), strict=True):
                if data.is_valid:
                    held[key] = held.get(key, 0) + np.bincount(np.frombuffer(data.as_buffer(), np.uint8), minlength=256)
            rows = [(*key, s, int(n)) for key, counts in held.items() for s, n in enumerate(counts) if n]
            fields = [*[batch.schema.field(i) for i in range(len(by))], pa.field("symbol", pa.int32()), pa.field("n", pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)], schema=pa.schema(fields))

    counted = payloads.select(*by, payload).mapInArrow(run, schema)
    return counted.groupBy(*by, "symbol").agg(F.sum("n").alias("n"))


def packed_size_bound(size: Column) -> Column:
    """Bytes that a packed stream of size bytes can have at most."""
    return size + 13 + 9 * F.ceil(size / BLOCK)


def histogram(texts: DataFrame, text: str, *by: str) -> DataFrame:
    """symbol, n, before (the counts of smaller symbols) of the characters of texts, per group. Counted where the texts are, then summed."""
    counted = texts.select(*by, F.explode(F.split(text, "")).alias("symbol")).where(F.col("symbol") != "").groupBy(*by, "symbol").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*by).orderBy("symbol").rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long"))


def normalised_frequencies(counted: DataFrame, *by: str) -> DataFrame:
    """symbol, freq from (by, symbol, n): a group has at most 256 symbols."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        scaled = normalise(dict(zip(g["symbol"].astype(int), g["n"].astype(int), strict=True)))
        return pd.DataFrame({**{c: g[c].iloc[0] for c in by}, "symbol": list(scaled), "freq": list(scaled.values())})

    fields = ", ".join(f"`{c}` {counted.schema[c].dataType.simpleString()}" for c in by)
    return counted.groupBy(*by).applyInPandas(one, f"{fields}, symbol int, freq int")
