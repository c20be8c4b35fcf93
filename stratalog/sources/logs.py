"""Data source `rail`: log entries in files of fixed-size records between a head and a foot that carry the size."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter
from pyspark.sql.types import StructType

from stratalog.model import LOG_ENTRIES, LOG_MAGIC
from stratalog.sources.archives import OneFile, Written
from stratalog.sources.files import listed, opened, publish, tail

#: Layout of an entry's 128 bytes.
ENTRY = struct.Struct("<BBHIQBxHHxxQQ16sI32s8s28x")
HEAD, FOOT, SUMMARY = struct.Struct("<4sIII"), struct.Struct("<4sI"), 64


def write_rail(entries: list[tuple]) -> bytes:
    """entries: type, version, flags, sequence, timestamp, content_type, layer_flags, wrap_count, original_size, stored_size, collection_id, collection_seq, content_hash, prev_hash."""
    body = b"".join(ENTRY.pack(*e) for e in entries)
    size = HEAD.size + len(body) + SUMMARY + FOOT.size
    last = entries[-1] if entries else (0,) * 14
    summary = struct.pack("<QQBxHHxxQQ", entries[0][4] if entries else 0, last[4], last[5], last[6], last[7], last[8], last[9]).ljust(SUMMARY, b"\0")
    return HEAD.pack(LOG_MAGIC, size, len(entries), 0) + body + summary + FOOT.pack(LOG_MAGIC, size)


def read_rail(data: bytes) -> Iterator[tuple]:
    """Entries of the rail that data ends with."""
    if len(data) < HEAD.size + SUMMARY + FOOT.size:
        raise ValueError("too short for a rail")
    magic, size = FOOT.unpack_from(data, len(data) - FOOT.size)
    start = len(data) - size
    if magic != LOG_MAGIC or start < 0 or size < HEAD.size + SUMMARY + FOOT.size:
        raise ValueError("no rail at the end")
    first, again, count, _ = HEAD.unpack_from(data, start)
    if first != LOG_MAGIC or again != size or size != HEAD.size + count * ENTRY.size + SUMMARY + FOOT.size:
        raise ValueError("head and foot of the rail differ")
    for i in range(count):
        yield ENTRY.unpack_from(data, start + HEAD.size + i * ENTRY.size)


def rail_size(foot: bytes) -> int:
    return FOOT.unpack(foot)[1] if len(foot) == FOOT.size and foot[:4] == LOG_MAGIC else len(foot)


class RailReader(DataSourceReader):
    """Reads the rail at a file's end and nothing before it; takes equality filters on type and sequence for itself."""

    def __init__(self, path: str):
        self.path = path
        self.equal: dict[int, int] = {}

    def pushFilters(self, filters: list[Filter]):
        places = {("type",): 0, ("sequence",): 3}
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in places and places[f.attribute] not in self.equal:
                self.equal[places[f.attribute]] = f.value
            else:
                yield f

    def partitions(self) -> list[OneFile]:
        return [OneFile(name) for name, _ in listed(self.path)]

    def read(self, partition: OneFile) -> Iterator[tuple]:
        for e in read_rail(tail(self.path, partition.name, FOOT.size, rail_size)):
            if all(e[i] == value for i, value in self.equal.items()):
                yield (partition.name, *e)


class RailWriter(DataSourceWriter):
    def __init__(self, path: str, names: list[str], overwrite: bool):
        self.path, self.names, self.overwrite = path, names, overwrite

    def write(self, rows: Iterator) -> Written:
        files, own = opened(self.path)
        files.create_dir(own, recursive=True)
        place = {n: i for i, n in enumerate(self.names)}
        wanted = LOG_ENTRIES.names[1:]
        blank = lambda n: b"" if n in ("collection_id", "content_hash", "prev_hash") else 0
        entries = [tuple(bytes(v) if isinstance(v := (r[place[n]] if n in place and r[place[n]] is not None else blank(n)), bytearray) else v for n in wanted) for r in rows]
        final = f"{own}/part-{uuid.uuid4().hex}.rail"
        temporary = f"{own}/_{final.rsplit('/', 1)[1]}"
        with files.open_output_stream(temporary) as f:
            f.write(write_rail(entries))
        return Written(temporary, final)

    def commit(self, messages: list) -> None:
        publish(self.path, [(m.temporary, m.final) for m in messages if m], self.overwrite)

    def abort(self, messages: list) -> None:
        files, _ = opened(self.path)
        for m in messages:
            if m:
                files.delete_file(m.temporary)


class RailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rail"

    def schema(self) -> StructType:
        return LOG_ENTRIES

    def reader(self, schema: StructType) -> RailReader:
        return RailReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> RailWriter:
        return RailWriter(self.options["path"], schema.names, overwrite)
