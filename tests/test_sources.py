"""Data sources against Python's own archive modules, and broken files."""

import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from stratalog import sources
from stratalog.sources.containers import read_container, read_volume, write_container, write_volume
from stratalog.sources.logs import read_rail, write_rail

FILES = {"a.txt": b"hello", "d/b.bin": bytes(range(256)), "empty": b"", "d/ü.txt": b"x"}


@pytest.fixture(scope="module")
def registered(spark):
    sources.register(spark)
    return spark


def make(path, kind):
    if kind == "zip":
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for k, v in FILES.items():
                z.writestr(k, v)
    else:
        with tarfile.open(path, f"w:{kind}") as t:
            for k, v in FILES.items():
                x = tarfile.TarInfo(k)
                x.size = len(v)
                t.addfile(x, io.BytesIO(v))


@pytest.mark.parametrize("kind", ["zip", "", "gz", "bz2", "xz"])
def test_reads_what_python_wrote(registered, tmp_path, kind):
    make(tmp_path / "x.bin", kind)
    df = registered.read.format("archive").load(str(tmp_path / "x.bin"))
    assert {r.path: bytes(r.content) for r in df.collect()} == FILES
    assert df.where(F.col("content").isNotNull() & (F.crc32("content") != F.col("crc32"))).count() == 0
    assert [r.path for r in df.where(F.col("path") == "a.txt").collect()] == ["a.txt"]
    assert df.where(F.col("path").startswith("d/")).count() == 2
    assert registered.read.format("archive").option("content", "false").load(str(tmp_path / "x.bin")).where("content is null").count() == 4


@pytest.mark.parametrize("kind", ["zip", "tar"])
def test_python_reads_what_was_written(registered, tmp_path, kind):
    rows = [(k, bytearray(v)) for k, v in FILES.items() if k.isascii()]
    registered.createDataFrame(rows, "path string, content binary").coalesce(1).write.format("archive").option("format", kind).mode("append").save(str(tmp_path / "out"))
    (file,) = (tmp_path / "out").glob(f"*.{kind}")
    if kind == "zip":
        with zipfile.ZipFile(file) as z:
            assert {n: z.read(n) for n in z.namelist()} == {k: bytes(v) for k, v in rows}
    else:
        with tarfile.open(file) as t:
            assert {x.name: t.extractfile(x).read() for x in t} == {k: bytes(v) for k, v in rows}


def test_containers(registered, tmp_path):
    df = registered.createDataFrame([(bytearray(bytes(i & 15 for i in range(4096))),), (bytearray(b"short"),)], "payload binary").coalesce(1)
    df.write.format("container").option("layers", "1").option("type", "4").mode("append").save(str(tmp_path / "c"))
    got = registered.read.format("container").load(str(tmp_path / "c")).collect()
    assert sorted(len(r.payload) for r in got) == [5, 4096] and all(r.intact and r.type_code == 4 and r.version == 5 for r in got)


def test_broken_containers():
    data = write_container(b"x" * 1000, 1, b"m", 1)
    assert read_container(data)[-1] is True
    assert read_container(data[:-1])[-1] is False
    assert read_container(data[:-1] + bytes([data[-1] ^ 1]))[-1] is False
    assert read_container(b"other file")[-2] == b"other file"


def test_volumes(registered, tmp_path):
    rows = [("tex/a.png", bytearray(b"p" * 500), 16, 1), ("b.glsl", bytearray(b"void"), 22, 2), ("tex/a.png", bytearray(b"again"), 16, 1)]
    registered.createDataFrame(rows, "path string, content binary, wrap_type int, grp int").coalesce(1).write.format("volume").option("layers", "1").mode("append").save(str(tmp_path / "v"))
    got = registered.read.format("volume").load(str(tmp_path / "v")).orderBy("idx").collect()
    assert [(r.path, bytes(r.content), r.wrap_type, r.grp) for r in got] == [(p, bytes(c), w, g) for p, c, w, g in rows]
    assert [r.offset for r in got][0] == 0 and got[1].offset == got[0].stored_size
    data = write_volume([("x", b"abc", False, 0, 0)])
    assert next(read_volume(data[:-1] + b"X"))[-1] is None
    with pytest.raises(ValueError):
        list(read_volume(write_container(b"")))


def test_rails(registered, tmp_path):
    entry = (1, 1, 0, 0, 1700000000, 4, 1, 0, 1000000, 120000, b"c" * 16, 3, b"\xab" * 32, b"p" * 8)
    data = write_rail([entry, (3, *entry[1:])])
    assert list(read_rail(b"payload before" + data))[1][0] == 3
    for broken in (data[:-1], data[:100], b"", data[:4] + b"\xff" + data[5:]):
        with pytest.raises(ValueError):
            list(read_rail(broken))
    df = registered.createDataFrame([(1, i, 10 * i) for i in range(3)], "type int, sequence long, timestamp long").coalesce(1)
    df.write.format("rail").mode("append").save(str(tmp_path / "w"))
    assert [r.timestamp for r in registered.read.format("rail").load(str(tmp_path / "w")).orderBy("sequence").collect()] == [0, 10, 20]
