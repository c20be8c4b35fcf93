"""Containers: type by magic bytes and header fields as expressions over binary columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.model import COMPRESSED, CONTAINER_MAGIC, CONTENT_TYPES, ENCRYPTED, IMAGE_MAGIC, PRESS_MAGIC, WRAP_TYPES, WRAPS_OF_EXTENSIONS
from stratalog.operators.archive import extension


def little_endian(content: Column, at: int, size: int) -> Column:
    """Unsigned little-endian integer of up to 7 bytes at a byte offset; of 8 bytes beyond 2^63 null."""
    return F.conv(F.hex(_reversed(content, at, size)), 16, 10).cast("decimal(20,0)").try_cast("bigint")


def _reversed(content: Column, at: int, size: int) -> Column:
    return F.concat(*[F.substring(content, at + 1 + k, 1) for k in reversed(range(size))])


def content_type(content: Column) -> Column:
    """Code of the content type; 0 if unknown or shorter than 6 bytes."""
    magic = F.substring(content, 1, 4)
    version = F.conv(F.hex(F.substring(content, 5, 1)), 16, 10).cast("int")
    code = F.conv(F.hex(F.substring(content, 6, 1)), 16, 10).cast("int")
    own = F.when(version >= 5, code).when(version == 1, 3).when(version.between(2, 4), 5).otherwise(0)
    return F.when(F.octet_length(content) < 6, 0).when(magic == F.lit(CONTAINER_MAGIC), own).when(magic == F.lit(IMAGE_MAGIC), 4).when(magic == F.lit(PRESS_MAGIC), 2).otherwise(0)


def type_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in CONTENT_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, code), F.lit("unknown"))


def header(files: DataFrame) -> DataFrame:
    """Header fields of containers of version 5 in files (path, content); the payload is not touched."""
    c = F.col("content")
    return files.where((F.octet_length(c) >= 64) & (F.substring(c, 1, 4) == F.lit(CONTAINER_MAGIC)) & (little_endian(c, 4, 1) >= 5)).select(
        "path", little_endian(c, 4, 1).cast("int").alias("version"), type_name(little_endian(c, 5, 1).cast("int")).alias("type"),
        (little_endian(c, 6, 2).bitwiseAND(COMPRESSED) != 0).alias("compressed"), (little_endian(c, 6, 2).bitwiseAND(ENCRYPTED) != 0).alias("encrypted"),
        little_endian(c, 8, 8).alias("payload_size"), little_endian(c, 16, 8).alias("original_size"), little_endian(c, 24, 4).alias("meta_size"), F.lower(F.hex(F.substring(c, 29, 32))).alias("hash"),
    )


def wrap_type_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in WRAP_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, code.cast("int")), F.lit("unknown"))


def wrap_find(wraps: Column, code: int) -> Column:
    """The first wrap of a type in an array of structs (type, body), null without one."""
    return F.get(F.filter(wraps, lambda w: w["type"] == code), F.lit(0))


def press_info(files: DataFrame) -> DataFrame:
    """path, original_size, ratio of compressed streams; 0 for files that are none."""
    c = F.col("content")
    known = (F.octet_length(c) >= 16) & (F.substring(c, 1, 4) == F.lit(PRESS_MAGIC)) & little_endian(c, 4, 1).isin(1, 2)
    size = F.when(known, little_endian(c, 8, 8)).otherwise(0)
    return files.select("path", size.alias("original_size"), F.when(size > 0, F.octet_length(c) / size).alias("ratio"))


def summary(headers: DataFrame) -> DataFrame:
    """path, text: a line for people about each container."""
    kinds = F.concat_ws(", ", F.col("type"), F.when(F.col("compressed"), "compressed"), F.when(F.col("encrypted"), "encrypted"))
    sizes = F.concat(F.col("payload_size").cast("string"), F.lit(" of "), F.col("original_size").cast("string"), F.lit(" bytes"))
    return headers.select("path", F.concat(F.lit("version "), F.col("version").cast("string"), F.lit(", "), kinds, F.lit(", "), sizes).alias("text"))


def wraps_of(path: Column) -> Column:
    """Default wraps of a path by its extension, null if there are none. The file isn't opened."""
    of = F.create_map(*[F.lit(x) for wraps, all_of in WRAPS_OF_EXTENSIONS.items() for e in all_of.split() for x in (e, wraps)])
    return F.split(F.try_element_at(of, extension(path)), " ")


def info(headers: DataFrame) -> DataFrame:
    """path, info: the header as JSON."""
    return headers.select("path", F.to_json(F.struct(*[c for c in headers.columns if c != "path"])).alias("info"))
