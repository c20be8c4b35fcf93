"""Locked files: header fields, trailer sections, the ledger inside, integrity, directories and messages.

Layout: header, binding (of remotely counted files), vault, payload, ledger, trailer sections. All here are
expressions over a binary column `content`, without a key; hashes are SHA-2, as everywhere in the engine.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.functions.records import read_sections
from stratalog.model import CONTAINER_MAGIC, LEDGER_ACTIONS, LOCK_FLAGS, table_of
from stratalog.operators.container import little_endian

#: Fixed values of the format: place and size of the header's fields.
FIELDS = {
    "version": (4, 1), "flags": (5, 1), "created": (50, 8), "epoch_length": (58, 4), "valid_from": (62, 4), "valid_until": (66, 4), "max_fuses": (70, 2), "remaining": (72, 2),
    "rounds": (138, 4), "heartbeat": (174, 4), "vault_size": (210, 4), "payload_size": (214, 4), "ledger_count": (218, 2),
}
HEADER, BINDING, LEDGER_ROW = 220, 32, 48
#: The fields that change while a file is used, which its authentication leaves out.
MUTABLE = ((72, 2), (74, 32), (174, 4), (218, 2))
#: Layout of a directory's row after its path: type, role, original size, offset, length, nonce, hash, permissions, mtime.
ENTRY = struct.Struct("<BBQQQ12s32sIQ")
ENTRIES = T.ArrayType(table_of("path string, type int, role_level int, original_size long, offset long, length long, hash binary, permissions long, mtime long"))


def little_endian_bytes(value: Column, size: int) -> Column:
    """The lowest bytes of a number, the lowest first."""
    digits = F.right(F.lpad(F.hex(value.cast("long")), 16, "0"), F.lit(2 * size))
    return F.unhex(F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))]))


def is_locked(content: Column) -> Column:
    return (F.octet_length(content) >= HEADER) & (F.substring(content, 1, 4) == F.lit(CONTAINER_MAGIC))


def header(files: DataFrame) -> DataFrame:
    """files (path, content) with the header's fields and flags; files that aren't locked ones are left out."""
    c = F.col("content")
    found = files.where(is_locked(c)).select("path", "content", *[little_endian(c, at, size).alias(name) for name, (at, size) in FIELDS.items()])
    binding = F.when(F.col("flags").bitwiseAND(LOCK_FLAGS["remote"]) != 0, BINDING).otherwise(0)
    return found.withColumns({
        **{f"is_{name}": F.col("flags").bitwiseAND(bit) != 0 for name, bit in LOCK_FLAGS.items()},
        "ledger_at": F.lit(HEADER) + binding + F.col("vault_size") + F.col("payload_size"),
        "trailer_at": F.lit(HEADER) + binding + F.col("vault_size") + F.col("payload_size") + LEDGER_ROW * F.col("ledger_count"),
    })


def prepared(content: Column) -> Column:
    """The header as its authentication sees it: mutable fields are zero."""
    parts, at = [], 0
    for place, size in MUTABLE:
        parts += [F.substring(content, at + 1, place - at), F.lit(bytes(size))]
        at = place + size
    return F.concat(*parts, F.substring(content, at + 1, HEADER - at))


@F.pandas_udf(T.StructType([T.StructField("names", T.ArrayType(T.StringType())), T.StructField("whole", T.BooleanType())]))
def sections(trailers: pd.Series) -> pd.DataFrame:
    """Names of the trailer's sections in order, and whether each has all the bytes that it claims."""

    def one(data):
        names, at = [], 0
        while data is not None and at + 8 <= len(data):
            size = int.from_bytes(data[at + 4 : at + 8], "little")
            if at + 8 + size > len(data):
                return names, False
            names.append(bytes(data[at : at + 4]).decode("latin-1"))
            at += 8 + size
        return names, True

    return pd.DataFrame([one(x) for x in trailers], columns=["names", "whole"])


def trailer(content: Column, at: Column) -> Column:
    return F.substr(content, (at + 1).cast("int"), F.greatest(F.lit(0), F.octet_length(content) - at).cast("int"))


def verify(files: DataFrame) -> DataFrame:
    """path, errors, found: what is wrong with each file (no locked file, cut short, broken trailer, a ledger that does not begin)."""
    c = F.col("content")
    others = files.where(~F.coalesce(is_locked(c), F.lit(False))).select("path", F.lit(1).alias("errors"), F.array(F.lit("magic")).alias("found"))
    h = header(files).withColumn("short", F.octet_length(c) < F.col("trailer_at"))
    # a file that is cut short has no trailer to look at
    h = h.withColumn("sections", sections(F.when(~F.col("short"), trailer(c, F.col("trailer_at")))))
    genesis = F.substr(c, (F.col("ledger_at") + 1).cast("int"), F.lit(8))
    started = (F.col("ledger_count") == 0) | F.col("short") | (genesis != F.lit(bytes(8)))
    found = F.array_compact(F.array(F.when(F.col("short"), "cut short"), F.when(~F.col("sections.whole"), "trailer"), F.when(~started, "ledger")))
    return h.select("path", F.size(found).alias("errors"), found.alias("found")).unionByName(others)


def info(files: DataFrame) -> DataFrame:
    """path, info: header fields, flags and the names of the trailer's sections as JSON."""
    h = header(files).withColumn("sections", sections(trailer(F.col("content"), F.col("trailer_at")))["names"])
    return h.select("path", F.to_json(F.struct(*FIELDS, *[f"is_{n}" for n in LOCK_FLAGS], "sections")).alias("info"))


def ledger_rows(files: DataFrame) -> DataFrame:
    """path, sequence, ts, hash, action, epoch of the ledgers inside files."""
    h = header(files).where("ledger_count > 0")
    rows = h.select("path", "content", "ledger_at", F.explode(F.sequence(F.lit(0), (F.col("ledger_count") - 1).cast("int"))).alias("sequence"))
    row = rows.withColumn("row", F.substr("content", (F.col("ledger_at") + LEDGER_ROW * F.col("sequence") + 1).cast("int"), F.lit(LEDGER_ROW)))
    r = F.col("row")
    names = F.create_map(*[F.lit(x) for pair in LEDGER_ACTIONS.items() for x in pair])
    action = F.coalesce(F.try_element_at(names, little_endian(r, 40, 4).cast("int")), F.lit("unknown"))
    return row.select("path", "sequence", little_endian(r, 0, 8).alias("ts"), F.substring(r, 9, 32).alias("hash"), action.alias("action"), little_endian(r, 44, 4).alias("epoch"))


def entry_hash(previous: Column, ts: Column, action: Column, epoch: Column) -> Column:
    """32 bytes over the hash before and the entry's own fields."""
    return F.unhex(F.sha2(F.concat(previous, little_endian_bytes(ts, 8), little_endian_bytes(action, 4), little_endian_bytes(epoch, 4)), 256))


GENESIS = bytes(32)


def ledger_chain(events: DataFrame, key: str) -> DataFrame:
    """key, sequence, ts, action, epoch, hash: a hash chain for each key over its events (ts, action, epoch, event), from a zero hash.

    A chain can only be built in order, so the events of a key are folded in one row; keys are spread.
    """
    ordered = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ts", "event", "action", "epoch"))).alias("es"))
    start = F.struct(F.lit(GENESIS).alias("last"), F.array().cast("array<binary>").alias("all"))

    def step(a: Column, e: Column) -> Column:
        own = entry_hash(a["last"], e["ts"], e["action"], e["epoch"])
        return F.struct(own.alias("last"), F.concat(a["all"], F.array(own)).alias("all"))

    hashes = F.aggregate("es", start, step, lambda a: a["all"])
    return ordered.select(key, F.posexplode(F.arrays_zip("es", hashes.alias("hash"))).alias("sequence", "x")).select(key, "sequence", "x.es.ts", "x.es.action", "x.es.epoch", "x.hash")


def verify_ledger(rows: DataFrame, key: str) -> DataFrame:
    """key, entries, broken: entries whose hash isn't that over the one before. Parallel over the entries of a key, too."""
    before = F.coalesce(F.lag("hash").over(Window.partitionBy(key).orderBy("sequence")), F.lit(GENESIS))
    fits = rows.withColumn("fits", F.col("hash") == entry_hash(before, F.col("ts"), F.col("action"), F.col("epoch")))
    return fits.groupBy(key).agg(F.count("*").alias("entries"), F.count_if(~F.col("fits")).alias("broken"))


def last_hash(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by("hash", "sequence").alias("hash"))


def with_failures(events: DataFrame, decisions: DataFrame) -> DataFrame:
    """events and one of action 2 (attempt) for each decision that did not grant and of action 3 (consumed) for each that did."""
    more = decisions.select("key", "event", "ts", "epoch", F.when(F.col("granted"), 3).otherwise(2).alias("action"))
    return events.select("key", "event", "ts", "epoch", "action").unionByName(more)


def refreshed(counters: DataFrame, requests: DataFrame) -> DataFrame:
    """counters (key, remaining, max_fuses, refresh_hash) after requests (key, refresh_key): full again where a key's SHA-256 fits."""
    fits = counters.join(requests, "key").where(F.sha2(F.col("refresh_key").cast("binary"), 256) == F.col("refresh_hash")).select("key", F.lit(True).alias("fits")).distinct()
    return counters.join(fits, "key", "left").withColumn("remaining", F.when(F.col("fits"), F.col("max_fuses")).otherwise(F.col("remaining"))).drop("fits")


def role_keys(master: Column, levels: int = 4) -> Column:
    """Keys of the roles 0 to levels - 1, each the hash of the one before: who has one can derive those below, never those above."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(levels - 1)), F.array(F.sha2(master, 256)), lambda a, _: F.concat(a, F.array(F.sha2(F.element_at(a, -1), 256))))


def file_key(master: Column, path: Column) -> Column:
    return F.sha2(F.concat(master.cast("binary"), F.lit(b"\0"), path.cast("binary")), 256)


def fuse_chain(secret: Column, depth: int) -> Column:
    """Preimages of a hash chain, the secret first, the public tip last."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.array(F.sha2(secret, 256)), lambda a, _: F.concat(a, F.array(F.sha2(F.element_at(a, -1), 256))))


def fuse_split(chain: Column, count: int) -> tuple[Column, Column]:
    """The child's part of a chain, its newest count fuses behind their tip, and what the parent keeps."""
    return F.slice(chain, F.size(chain) - count, F.lit(count + 1)), F.slice(chain, F.lit(1), F.size(chain) - count)


def fuse_fits(preimage: Column, tip: Column) -> Column:
    return F.sha2(preimage, 256) == tip


def write_directory(entries: list[tuple]) -> bytes:
    """entries: path, type, role, original size, offset, length, nonce, hash, permissions, mtime."""
    out = [len(entries).to_bytes(2, "little")]
    for path, *rest in entries:
        name = path.encode()
        out += [len(name).to_bytes(2, "little"), name, ENTRY.pack(*rest)]
    return b"".join(out)


def read_directory(data: bytes) -> list[tuple]:
    """The entries; raises ValueError where the directory is cut short."""
    out, at = [], 2
    for _ in range(int.from_bytes(data[:2], "little")):
        size = int.from_bytes(data[at : at + 2], "little")
        if at + 2 + size + ENTRY.size > len(data):
            raise ValueError("the directory is cut short")
        out.append((data[at + 2 : at + 2 + size].decode(), *ENTRY.unpack_from(data, at + 2 + size)))
        at += 2 + size + ENTRY.size
    return out


@F.pandas_udf(ENTRIES)
def directory(values: pd.Series) -> pd.Series:
    """Entries of a locked archive's directory section; null where it is broken."""

    def one(data):
        try:
            names = ("path", "type", "role_level", "original_size", "offset", "length", "nonce", "hash", "permissions", "mtime")
            return None if data is None else [{k: v for k, v in zip(names, e, strict=True) if k != "nonce"} for e in read_directory(bytes(data))]
        except ValueError:
            return None

    return values.map(one)


def archive_list(files: DataFrame) -> DataFrame:
    """path, and an entry a row, of the locked archives among files; needs no key."""

    @F.pandas_udf(T.BinaryType())
    def of_archive(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else read_sections(bytes(x)).get("ARCV"))

    found = header(files).select("path", of_archive(trailer(F.col("content"), F.col("trailer_at"))).alias("d"))
    return found.where("d is not null").select("path", F.explode(directory("d")).alias("e")).select("path", F.col("e.path").alias("entry"), *[f"e.{n}" for n in ("type", "role_level", "original_size", "permissions", "mtime")])


@F.pandas_udf(T.ArrayType(table_of("ts long, text string")))
def messages(values: pd.Series) -> pd.Series:
    """Messages of a public message section: time and text; stops where it is cut short."""

    def one(data):
        if data is None:
            return None
        data, out, at = bytes(data), [], 2
        for _ in range(int.from_bytes(data[:2], "little")):
            size = int.from_bytes(data[at + 8 : at + 10], "little")
            if at + 10 + size > len(data):
                break
            out.append({"ts": int.from_bytes(data[at : at + 8], "little"), "text": data[at + 10 : at + 10 + size].decode("utf-8", "replace")})
            at += 10 + size
        return out

    return values.map(one)


def write_messages(rows: list[tuple[int, str]]) -> bytes:
    texts = [(ts, text.encode()) for ts, text in rows]
    return len(texts).to_bytes(2, "little") + b"".join(ts.to_bytes(8, "little") + len(t).to_bytes(2, "little") + t for ts, t in texts)
