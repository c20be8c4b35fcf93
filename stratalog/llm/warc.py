"""WARC archives: writing, gzip normalising with a sidecar index, reading back.

A crawler's archive often is one gzip stream over the whole file, in which no record can be reached
by itself. The normaliser inflates such a stream once, piece by piece, and rewrites every record as
a gzip member of its own; a sidecar index (JSON lines beside the archive) has each member's offset
and length. Records whose payload another record has already can be rewritten as revisits.

Archives and indexes are files in the shared folder, written under names of their own by each task
attempt; which of them count is known only from the rows of attempts that Spark committed, so lost
executors and second attempts leave nothing behind that is read.

Defined cases: a null html is an empty payload; null urls become ``urn:page:<page_id>``, and control
characters in urls are percent-encoded in the header; of several rows with one page_id each has its
record, and the duplicates are told by their place in the archive; an empty table writes and gives
nothing; rows with a null page_id are left out; other columns are passed over.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import new_folder, saved

VERSION = b"WARC/1.1"
DATE = "1970-01-01T00:00:00Z"  # pages has no time of capture
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PIECE = 1 << 20
LEVEL = 3
TASKS = 20_000
ARCHIVE_BYTES = 64 << 20  # of records in an archive before the next one is begun


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: dict[str, str], block: bytes) -> bytes:
    lines = [VERSION, *[f"{k}: {v}".encode() for k, v in headers.items()], f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def response_headers(page_id: int, url: str | None, payload: bytes) -> dict[str, str]:
    uri = re.sub(r"[\x00-\x20\x7f-￿]", lambda m: "".join(f"%{x:02X}" for x in m[0].encode()), url) if url else f"urn:page:{page_id}"
    return {
        "WARC-Type": "response", "WARC-Record-ID": f"<urn:page:{page_id}>", "WARC-Date": DATE, "WARC-Target-URI": uri,
        "WARC-Payload-Digest": f"sha1:{payload_digest(payload)}", "WARC-Payload-Length": str(len(payload)), "Content-Type": "text/html; charset=utf-8",
    }


class RecordReader:
    """Records of an inflated stream, which is read in pieces; no more than a record is held."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, bytearray()

    def _more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.held += piece
        return True

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        while True:
            while (end := self.held.find(b"\r\n\r\n")) < 0:
                if not self._more():
                    if self.held.strip():
                        raise ValueError("the archive ends inside a record's header")
                    return
            first, *lines = bytes(self.held[:end]).split(b"\r\n")
            if not first.startswith(b"WARC/"):
                raise ValueError(f"no WARC record begins with {first[:40]!r}")
            headers = dict(x.decode().split(": ", 1) for x in lines)
            size = int(headers["Content-Length"])
            while len(self.held) < end + 4 + size + 4:
                if not self._more():
                    raise ValueError("the archive ends inside a record")
            yield headers, bytes(self.held[end + 4 : end + 4 + size])
            del self.held[: end + 8 + size]


def inflated(file: BinaryIO) -> Iterator[bytes]:
    """Pieces of a gzip file of one or several members."""
    unpack = zlib.decompressobj(31)
    while chunk := file.read(PIECE):
        while chunk:
            if out := unpack.decompress(chunk, PIECE):
                yield out
            chunk = unpack.unconsumed_tail
            if unpack.eof:
                chunk, unpack = unpack.unused_data, zlib.decompressobj(31)
                if chunk and not chunk.strip(b"\0"):
                    chunk = b""
    if out := unpack.flush():
        yield out


def _files(folder: str):
    """The file system of a folder in the shared place, and the folder's path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_monolithic(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages (page_id, url, html) as archives of one gzip stream each; archive, ordinal, page_id, digest, bytes of each record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _files(folder)
        files.create_dir(path, recursive=True)
        out, name, pack, held = None, None, None, 0
        rows: list[tuple] = []
        ordinal = 0

        def close() -> None:
            out.write(pack.flush())
            out.close()

        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                for page, url, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist(), strict=True):
                    if out is None:
                        name, pack, held, ordinal = f"{uuid.uuid4().hex}.warc.gz", zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0, 0
                        out = files.open_output_stream(f"{path}/{name}", compression=None)
                    payload = html or b""
                    data = record(headers := response_headers(page, url, payload), payload)
                    out.write(pack.compress(data))
                    held += len(data)
                    rows.append((name, ordinal, page, headers["WARC-Payload-Digest"][5:], len(payload)))
                    ordinal += 1
                    if held > ARCHIVE_BYTES:
                        close()
                        out = None
        if out is not None:
            close()
        for k in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 10_000], strict=True), _WRITTEN.types, strict=True)], _WRITTEN.names)

    return pages.where("page_id is not null").select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "archive string, ordinal long, page_id long, digest string, bytes long")


_WRITTEN = pa.schema([("archive", pa.string()), ("ordinal", pa.int64()), ("page_id", pa.int64()), ("digest", pa.string()), ("bytes", pa.int64())])
_INDEXED = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64())])
_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def revisits(written: DataFrame, least_bytes: int = 0) -> DataFrame:
    """written and refers_to: the page whose record holds the payload, null for responses.

    Of the records with one payload that with the smallest page_id, and of that the first in its archive, is the response.
    """
    long_enough = F.col("bytes") >= least_bytes
    place = F.struct("page_id", "archive", "ordinal")
    first = written.where(long_enough).groupBy("digest", "bytes").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "bytes", "first")
    # written first: only a join of two plain exchanges can be split where many records have one payload
    first = saved(first, "warc-first")
    joined = written.join(first, ["digest", "bytes"], "left")
    other = F.col("first").isNotNull() & long_enough & (place != F.col("first"))
    return joined.select(*written.columns, F.when(other, F.col("first.page_id")).alias("refers_to"))


def normalise(decisions: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrites each archive of source into target with a member a record; archive, offset, length, page_id of each record.

    decisions has archive, ordinal, refers_to. A record with refers_to becomes a revisit. Only revisits
    are sent along: an archive's rows are as many as its records, whose bytes are bounded.
    """

    def rewrite(archive: str, refers: dict[int, int]) -> pa.RecordBatch:
        files, path = _files(source)
        to_files, to_path = _files(target)
        to_files.create_dir(to_path, recursive=True)
        name = f"{archive.removesuffix('.warc.gz')}-{uuid.uuid4().hex[:8]}.warc.gz"
        rows, offset = [], 0
        with files.open_input_stream(f"{path}/{archive}", compression=None) as f, to_files.open_output_stream(f"{to_path}/{name}", compression=None) as out:
            for ordinal, (headers, block) in enumerate(RecordReader(inflated(f))):
                page = int(headers["WARC-Record-ID"].strip("<>").rsplit(":", 1)[1])
                if ordinal in refers:
                    headers = headers | {"WARC-Type": "revisit", "WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{refers[ordinal]}>"}
                    block = b""
                headers.pop("Content-Length")
                member = gzip.compress(record(headers, block), LEVEL, mtime=0)
                out.write(member)
                rows.append((name, offset, len(member), page))
                offset += len(member)
        with to_files.open_output_stream(f"{to_path}/{name}.index.jsonl", compression=None) as side:
            side.write("".join(json.dumps({"offset": o, "length": n, "page_id": p}) + "\n" for _, o, n, p in rows).encode())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _INDEXED.types, strict=True)], _INDEXED.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, refers = None, {}
        for batch in batches:
            for a, ordinal, to in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if a != archive:
                    if archive is not None:
                        yield rewrite(archive, refers)
                    archive, refers = a, {}
                if to is not None:
                    refers[ordinal] = to
        if archive is not None:
            yield rewrite(archive, refers)

    # the first record of an archive stands for it, so that archives without revisits come too
    needed = decisions.where("refers_to is not null or ordinal = 0").select("archive", "ordinal", "refers_to")
    # a few rows stand for the work of an archive, so tasks are counted by archives and not by bytes
    return needed.repartition(_archives(decisions), "archive").sortWithinPartitions("archive", "ordinal").mapInArrow(run, "archive string, offset long, length long, page_id long")


def _archives(rows: DataFrame) -> int:
    """Tasks for archives, which a task takes one after another."""
    return max(1, min(TASKS, rows.select("archive").distinct().count()))


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Reads all records of archives (archive) by the offsets and lengths in the index file beside each; digests are taken again from the payloads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _files(folder)
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                rows = []
                with files.open_input_stream(f"{path}/{archive}.index.jsonl", compression=None) as side:
                    index = [json.loads(line) for line in side.read().splitlines()]
                with files.open_input_file(f"{path}/{archive}") as file:
                    for x in index:
                        file.seek(x["offset"])
                        data = gzip.decompress(file.read(x["length"]))
                        ((headers, block),) = RecordReader(iter([data]))
                        page = int(headers["WARC-Record-ID"].strip("<>").rsplit(":", 1)[1])
                        digest, size = headers["WARC-Payload-Digest"][5:], int(headers["WARC-Payload-Length"])
                        refers = headers.get("WARC-Refers-To")
                        if page != x["page_id"]:
                            raise ValueError(f"the index of {archive} has page {x['page_id']} where page {page} is")
                        if refers is None and (payload_digest(block) != digest or len(block) != size):
                            raise ValueError(f"the payload of page {page} is not what its record says")
                        rows.append((page, size, digest, headers["WARC-Type"], refers and int(refers.strip("<>").rsplit(":", 1)[1]), archive, x["offset"], x["length"]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _READ.types, strict=True)], _READ.names)

    names = archives.select("archive").distinct()
    return names.repartition(_archives(names), "archive").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long")


def archive_pages(pages: DataFrame, *, least_bytes: int = 0) -> DataFrame:
    """Writes pages as monolithic archives, normalises them with revisits, and reads all records back through the index."""
    spark = pages.sparkSession
    source, target = new_folder(spark, "warc-monolithic"), new_folder(spark, "warc")
    written = saved(write_monolithic(pages, source), "warc-written")
    # written as it comes: a retried task gives its archive another name, so no shuffle may stand between
    rewritten = saved(normalise(saved(revisits(written, least_bytes), "warc-decisions"), source, target), "warc-rewritten")
    return read_archives(rewritten, target)
