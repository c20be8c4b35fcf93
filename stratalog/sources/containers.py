"""Data sources `container` and `volume`: files of one payload, and files of many assets behind a manifest.

Options for reading: content (volumes; false: the manifest only). For writing: layers (1: compressed), codec
(block or press), level (1 to 9), type, created (volumes; unix seconds, adds a log).
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceWriter, Filter
from pyspark.sql.types import StructType

from stratalog.functions.codecs import pack_bytes, unpack_bytes
from stratalog.functions.press import press, unpress
from stratalog.model import COMPRESSED, CONTAINER_MAGIC, CONTAINER_VERSION, CONTAINERS, PRESS_MAGIC, VOLUME_ASSETS, VOLUME_MAGIC
from stratalog.sources.archives import OneFile, PathFilters, Written
from stratalog.sources.files import below, listed, opened, publish, read
from stratalog.sources.logs import write_rail

#: Layout of a container's header: magic, version, type, layers, stored and original size, size of the meta data, hash.
HEADER = struct.Struct("<4sBBHQQI32s4x")
#: Layout of a manifest's rows: path, offset, stored and original size, flags, wrap type, group, hash; padded.
ENTRY = struct.Struct("<256sQQQIHH32s8x")


def _stored(raw: bytes, codec: str, level: int) -> bytes:
    return press(raw, level) if codec == "press" else pack_bytes(raw, level)


def _original(data: bytes) -> bytes:
    """Of either codec; ValueError for broken data."""
    return unpress(data) if data[:4] == PRESS_MAGIC else unpack_bytes(data)


def write_container(payload: bytes, type_code: int = 1, meta: bytes = b"", layers: int = 0, codec: str = "block", level: int = 5) -> bytes:
    """codec: block (the engine's own, fast) or press (the format of packed assets, which others read)."""
    stored = _stored(payload, codec, min(9, max(1, level))) if layers & COMPRESSED else payload
    return HEADER.pack(CONTAINER_MAGIC, CONTAINER_VERSION, type_code, layers, len(stored), len(payload), len(meta), hashlib.sha3_256(payload).digest()) + meta + stored


def read_container(data: bytes) -> tuple:
    """version, type, layers, stored size, original size, meta size, hash, meta, payload, intact. Other files are a payload as a whole."""
    if len(data) < HEADER.size or data[:4] != CONTAINER_MAGIC or data[4] < CONTAINER_VERSION:
        return 0, 0, 0, len(data), len(data), 0, None, None, data, None
    _, version, kind, layers, stored, original, meta, digest = HEADER.unpack_from(data)
    body = data[HEADER.size + meta : HEADER.size + meta + stored]
    if len(body) != stored:
        return version, kind, layers, stored, original, meta, digest, None, None, False
    try:
        payload = _original(body) if layers & COMPRESSED else body
    except ValueError:
        payload = None
    intact = payload is not None and len(payload) == original and hashlib.sha3_256(payload).digest() == digest
    return version, kind, layers, stored, original, meta, digest, data[HEADER.size : HEADER.size + meta], payload, intact


def write_volume(assets: list[tuple[str, bytes, bool, int, int]], created: int | None = None, codec: str = "block") -> bytes:
    """assets: path, content, whether to compress, wrap type, group. With a time of creation a log ends the payload:

    an entry for the volume and one for each asset, whose collection is the start of its content's hash.
    """
    rows, bodies, at = [], [], 0
    for path, content, compress, wrap, group in assets:
        name = path.encode()
        if len(name) > 255:
            raise ValueError(f"path of over 255 bytes: {path[:40]}")
        body = _stored(content, codec, 5) if compress else content
        rows.append(ENTRY.pack(name, at, len(body), len(content), int(compress), wrap, group, hashlib.sha3_256(content).digest()))
        bodies.append(body)
        at += len(body)
    manifest = VOLUME_MAGIC + struct.pack("<I", len(rows)) + b"".join(rows)
    if created is not None:
        total = sum(len(content) for _, content, *_ in assets)
        entry = lambda kind, k, of, size, stored, digest: (kind, 1, 0, k, created, 5, 0, 0, size, stored, of, k, digest, bytes(8))
        digests = [hashlib.sha3_256(content).digest() for _, content, *_ in assets]
        log = [entry(1, 0, bytes(16), total, at, bytes(32))]
        log += [entry(8, k + 1, d[:16], len(a[1]), len(b), d) for k, (a, b, d) in enumerate(zip(assets, bodies, digests, strict=True))]
        bodies.append(write_rail(log))
    return write_container(b"".join(bodies), 5, manifest)


def read_volume(data: bytes, content: bool = True, wanted: Callable[[str], bool] = lambda path: True) -> Iterator[tuple]:
    """idx, path, offset, stored, original, flags, wrap type, group, hash, content of each asset; content is null where it is broken."""
    *_, meta, payload, _ = read_container(data)
    if not meta or meta[:4] != VOLUME_MAGIC:
        raise ValueError("no manifest")
    (count,) = struct.unpack_from("<I", meta, 4)
    for i in range(count):
        if 8 + (i + 1) * ENTRY.size > len(meta):
            raise ValueError("the manifest is cut short")
        name, at, stored, original, flags, wrap, group, digest = ENTRY.unpack_from(meta, 8 + i * ENTRY.size)
        path, body = name.rstrip(b"\0").decode(), None
        if not wanted(path):
            continue
        if content and payload is not None and at + stored <= len(payload):
            body = payload[at : at + stored]
            try:
                body = _original(body) if flags & 1 else body
            except ValueError:
                body = None
            if body is not None and hashlib.sha3_256(body).digest() != digest:
                body = None
        yield i, path, at, stored, original, flags, wrap, group, digest, body


class _Reader(PathFilters):
    def __init__(self, path: str, content: bool, volumes: bool):
        self.path, self.content, self.volumes = path, content, volumes

    def pushFilters(self, filters: list[Filter]):
        # a container's path is its file's name, which a filter may go on to test
        return super().pushFilters(filters) if self.volumes else iter(filters)

    def partitions(self) -> list[OneFile]:
        return [OneFile(name) for name, _ in listed(self.path)]

    def read(self, partition: OneFile) -> Iterator[tuple]:
        data = read(self.path, partition.name)
        if self.volumes:
            for row in read_volume(data, self.content, self.wanted):
                yield (partition.name, *row)
        else:
            yield (partition.name, *read_container(data))


class _Writer(DataSourceWriter):
    """container: a file for each row (payload); volume: a file for each partition (path, content)."""

    def __init__(self, path: str, names: list[str], volumes: bool, overwrite: bool, options: dict):
        self.path, self.names, self.volumes, self.overwrite = path, names, volumes, overwrite
        self.layers, self.type_code = int(options.get("layers", "0")), int(options.get("type", "1"))
        self.codec, self.level, created = options.get("codec", "block"), int(options.get("level", "5")), options.get("created")
        self.created = None if created is None else int(created)

    def write(self, rows: Iterator) -> list | Written:
        files, own = opened(self.path)
        files.create_dir(own, recursive=True)
        place = {n: i for i, n in enumerate(self.names)}
        raw = lambda x: x.encode() if isinstance(x, str) else bytes(x or b"")
        if self.volumes:
            data = [write_volume([(r[place["path"]], raw(r[place["content"]]), bool(self.layers & COMPRESSED), r[place["wrap_type"]] if "wrap_type" in place else 0, r[place["grp"]] if "grp" in place else 0) for r in rows], self.created, self.codec)]
        else:
            data = (write_container(raw(r[place["payload"]]), self.type_code, raw(r[place["meta"]]) if "meta" in place else b"", self.layers, self.codec, self.level) for r in rows)
        folder = f"{own}/_{uuid.uuid4().hex}"
        files.create_dir(folder)
        for i, x in enumerate(data):
            with files.open_output_stream(f"{folder}/{i:06d}.bin") as f:
                f.write(x)
        return Written(folder, own)

    def commit(self, messages: list) -> None:
        files, _ = opened(self.path)
        done = [m for m in messages if m]
        publish(self.path, [(x, f"{m.final}/{m.temporary.rsplit('_', 1)[1]}-{name}") for m in done for x, name in below(self.path, m.temporary)], self.overwrite)
        for m in done:
            files.delete_dir(m.temporary)

    def abort(self, messages: list) -> None:
        files, _ = opened(self.path)
        for m in messages:
            if m:
                files.delete_dir(m.temporary)


class ContainerSource(DataSource):
    volumes = False

    @classmethod
    def name(cls) -> str:
        return "container"

    def schema(self) -> StructType:
        return CONTAINERS

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"], self.options.get("content", "true").lower() == "true", self.volumes)

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], schema.names, self.volumes, overwrite, dict(self.options))


class VolumeSource(ContainerSource):
    volumes = True

    @classmethod
    def name(cls) -> str:
        return "volume"

    def schema(self) -> StructType:
        return VOLUME_ASSETS
