"""Data source `archive`: entries of zip and tar files (plain, gzip, bzip2, xz), read and written.

Options: content (false: the directory only), format for writing (zip or tar). One file is one
partition; filters on path (equality and prefix) are applied while the directory is walked, so that
contents of other entries are never read. Files are read and written entry by entry. Rows may bring
mtime (unix seconds) and permissions along.
"""

from __future__ import annotations

import io
import tarfile
import uuid
import zipfile
import zlib
from calendar import timegm
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from time import gmtime
from typing import BinaryIO

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from stratalog.model import ARCHIVE_ENTRIES
from stratalog.sources.files import listed, opened, publish

FIRST_DAY = 315532800  # 1980-01-01, before which zip knows no time


@dataclass
class OneFile(InputPartition):
    name: str


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str


def zip_entries(file: BinaryIO, wanted: Callable[[str], bool], content: bool) -> Iterator[tuple]:
    """Reads the directory, and of the wanted entries their contents."""
    with zipfile.ZipFile(file) as z:
        for i, x in enumerate(z.infolist()):
            if not wanted(x.filename):
                continue
            encrypted = bool(x.flag_bits & 1)
            body = z.read(x) if content and not encrypted and not x.is_dir() and x.compress_type in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) else None
            mode = x.external_attr >> 16
            yield i, x.filename, x.file_size, x.compress_size, timegm((*x.date_time, 0, 0, 0)), x.CRC, mode & 0o7777, x.compress_type, x.is_dir(), encrypted, (mode & 0o170000) == 0o120000, body


def tar_entries(file: BinaryIO, wanted: Callable[[str], bool], content: bool) -> Iterator[tuple]:
    """Goes through the file entry by entry; no more than one content is held."""
    with tarfile.open(fileobj=file, mode="r:*") as t:
        for i, x in enumerate(t):
            if not wanted(x.name.rstrip("/")):
                continue
            body = t.extractfile(x).read() if content and x.isfile() else None
            yield i, x.name.rstrip("/"), x.size, x.size, int(x.mtime), None if body is None else zlib.crc32(body), x.mode, 0, x.isdir(), False, x.issym(), body


class PathFilters(DataSourceReader):
    """A reader that takes filters on path (equality and prefix) for itself."""

    equal: str | None = None
    prefix = ""

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("path",) and self.equal is None:
                self.equal = f.value
            elif isinstance(f, StringStartsWith) and f.attribute == ("path",) and not self.prefix:
                self.prefix = f.value
            else:
                yield f

    def wanted(self, path: str) -> bool:
        return (self.equal is None or path == self.equal) and path.startswith(self.prefix)


class ArchiveReader(PathFilters):
    def __init__(self, path: str, content: bool):
        self.path, self.content = path, content

    def partitions(self) -> list[OneFile]:
        return [OneFile(name) for name, _ in listed(self.path)]

    def read(self, partition: OneFile) -> Iterator[tuple]:
        files, _ = opened(self.path)
        with files.open_input_file(partition.name) as f:
            head = f.read(1024)
            f.seek(0)
            if head[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
                entries = zip_entries
            elif head[:2] in (b"\x1f\x8b", b"BZ") or head[:6] == b"\xfd7zXZ\x00" or head[257:262] == b"ustar" or head == bytes(1024):
                entries = tar_entries
            else:
                raise ValueError(f"{partition.name} is no zip or tar archive")
            for row in entries(f, self.wanted, self.content):
                yield (partition.name, *row)


class ArchiveWriter(DataSourceWriter):
    """One archive for each partition; rows need path and content. Files get their names when the job commits."""

    def __init__(self, path: str, format_name: str, names: list[str], overwrite: bool):
        if format_name not in ("zip", "tar"):
            raise ValueError("format is zip or tar")
        self.path, self.format, self.names, self.overwrite = path, format_name, names, overwrite

    def write(self, rows: Iterator) -> Written:
        files, own = opened(self.path)
        files.create_dir(own, recursive=True)
        place = {n: i for i, n in enumerate(self.names)}
        final = f"{own}/part-{uuid.uuid4().hex}.{self.format}"
        temporary = f"{own}/_{final.rsplit('/', 1)[1]}"
        is_zip = self.format == "zip"
        told = lambda row, name: row[place[name]] if name in place else None
        with (
            files.open_output_stream(temporary, compression=None) as out,
            zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) if is_zip else tarfile.open(fileobj=out, mode="w|", format=tarfile.USTAR_FORMAT) as z,
        ):
            for row in rows:
                name, body, mtime, mode = row[place["path"]], row[place["content"]], told(row, "mtime"), told(row, "permissions")
                body = body.encode() if isinstance(body, str) else bytes(body or b"")
                folder = name.endswith("/")
                mode = mode or (0o755 if folder else 0o644)
                if is_zip:
                    at = gmtime(max(mtime or 0, FIRST_DAY))[:6]
                    info = zipfile.ZipInfo(name, at)
                    info.external_attr = mode << 16
                    z.writestr(info, body)
                else:
                    x = tarfile.TarInfo(name.rstrip("/"))
                    x.size, x.mode, x.mtime, x.type = (0, mode, mtime or 0, tarfile.DIRTYPE) if folder else (len(body), mode, mtime or 0, tarfile.REGTYPE)
                    z.addfile(x, None if folder else io.BytesIO(body))
        return Written(temporary, final)

    def commit(self, messages: list) -> None:
        publish(self.path, [(m.temporary, m.final) for m in messages if m], self.overwrite)

    def abort(self, messages: list) -> None:
        files, _ = opened(self.path)
        for m in messages:
            if m:
                files.delete_file(m.temporary)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> StructType:
        return ARCHIVE_ENTRIES

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options["path"], self.options.get("content", "true").lower() == "true")

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], self.options.get("format", "zip"), schema.names, overwrite)
