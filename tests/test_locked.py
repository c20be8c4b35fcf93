"""Locked files and the engine's small records as columns."""

import hashlib
import zipfile

import pytest
from pyspark.sql import functions as F

from stratalog import sources
from stratalog.functions import records
from stratalog.operators import archive, container, locked
from stratalog.sources.containers import read_container, read_volume, write_container, write_volume
from stratalog.sources.logs import read_rail


def locked_file(flags=0, payload=b"payload", ledger=(), sections=()):
    head = bytearray(220)
    head[:6] = b"CUTE\x04" + bytes([flags])
    head[214:218], head[218:220] = len(payload).to_bytes(4, "little"), len(ledger).to_bytes(2, "little")
    rows = b"".join(ts.to_bytes(8, "little") + bytes(32) + action.to_bytes(4, "little") + epoch.to_bytes(4, "little") for ts, action, epoch in ledger)
    return bytes(head) + bytes(32 if flags & 128 else 0) + payload + rows + records.write_sections(list(sections))


ENTRIES = [("a/b.txt", 0, 3, 10, 0, 26, b"n" * 12, b"h" * 32, 0o644, 1700000000), ("ü", 1, 0, 0, 0, 0, bytes(12), bytes(32), 0o755, 0)]


def test_locked_files(spark):
    files = {
        "plain": locked_file(), "remote": locked_file(128, ledger=[(5, 0, 0), (6, 3, 1)], sections=[("TOTP", b"x")]),
        "archive": locked_file(sections=[("PMSG", locked.write_messages([(7, "hé"), (8, "")])), ("ARCV", locked.write_directory(ENTRIES))]),
        "short": locked_file()[:-1], "bad trailer": locked_file(sections=[("TOTP", b"xyz")])[:-1], "no start": locked_file(ledger=[(0, 0, 0)]), "other": b"something else" * 99, "empty": b"",
    }
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()] + [("null", None)], "path string, content binary")
    found = {r.path: (r.errors, r.found) for r in locked.verify(df).collect()}
    assert found == {"plain": (0, []), "remote": (0, []), "archive": (0, []), "short": (1, ["cut short"]), "bad trailer": (1, ["trailer"]), "no start": (1, ["ledger"]), **{k: (1, ["magic"]) for k in ("other", "empty", "null")}}
    rows = locked.ledger_rows(df.where("path = 'remote'")).orderBy("sequence").collect()
    assert [(r.ts, r.action, r.epoch) for r in rows] == [(5, "created", 0), (6, "consumed", 1)]
    listed = locked.archive_list(df).collect()
    assert [(r.path, r.entry, r.type, r.role_level, r.original_size, r.permissions, r.mtime) for r in listed] == [("archive", e[0], *e[1:4], *e[8:]) for e in ENTRIES]
    assert '"sections":["PMSG","ARCV"]' in locked.info(df.where("path = 'archive'")).first().info
    assert locked.verify(df.limit(0)).collect() == []


def test_prepared_header(spark):
    content = bytes(range(220)) + b"more"
    want = bytearray(content[:220])
    for a, b in ((72, 74), (74, 106), (174, 178), (218, 220)):
        want[a:b] = bytes(b - a)
    got = spark.createDataFrame([(bytearray(content),)], "content binary").select(locked.prepared(F.col("content")).alias("x")).first().x
    assert bytes(got) == bytes(want)


def test_directories_and_messages(spark):
    data = locked.write_directory(ENTRIES)
    assert locked.read_directory(data) == ENTRIES
    with pytest.raises(ValueError):
        locked.read_directory(data[:-1])
    got = spark.createDataFrame([(bytearray(data),), (bytearray(data[:-1]),), (None,)], "d binary").select(locked.directory("d").alias("x")).collect()
    assert [e.path for e in got[0].x] == ["a/b.txt", "ü"] and got[1].x is None and got[2].x is None
    said = locked.write_messages([(7, "hé"), (8, "zwei")])
    got = spark.createDataFrame([(bytearray(said),), (bytearray(said[:-1]),), (None,)], "m binary").select(locked.messages("m").alias("x")).collect()
    assert [[(m.ts, m.text) for m in r.x] if r.x is not None else None for r in got] == [[(7, "hé"), (8, "zwei")], [(7, "hé")], None]


def test_records_as_columns(spark):
    token, wraps = records.write_token(9, 4, 2, b"claims"), records.write_wraps([(1, b"i"), (8, b"d"), (8, b"e")], [("v", 1, 0, 5)], [(b"h" * 32, 2)])
    df = spark.createDataFrame([(bytearray(token), bytearray(wraps)), (bytearray(token[:-1]), bytearray(b"")), (None, None)], "t binary, w binary")
    got = df.select(records.tokens("t").alias("t"), records.wrap_sets("w").alias("w")).collect()
    assert (got[0].t.epoch, got[0].t.window, got[0].t.uses, bytes(got[0].t.claims)) == (9, 4, 2, b"claims") and got[1].t.epoch is None
    first = df.select(container.wrap_find(records.wrap_sets("w")["wraps"], 8).alias("x"), container.wrap_find(records.wrap_sets("w")["wraps"], 9).alias("none")).first()
    assert bytes(first.x.body) == b"d" and first.none is None and got[0].w.variants[0].name == "v" and got[0].w.refs[0].kind == 2
    made = spark.range(1).select(records.token_of(F.lit(9), F.lit(4), F.lit(2), F.lit(b"claims")).alias("x")).first().x
    assert bytes(made) == token
    codes = spark.range(1).select(records.one_time_codes(F.lit(b"12345678901234567890"), F.lit(59)).alias("c"), records.codes_fit(F.lit(b"12345678901234567890"), F.lit("287082"), F.lit(89)).alias("fits")).first()
    assert codes.c == "287082" and codes.fits
    data = bytes(range(256)) * 9 + b"rest"
    x = spark.createDataFrame([(bytearray(data),)], "d binary").select(records.shuffled("d", F.lit(b"key")).alias("s")).select("s", records.unshuffled("s", F.lit(b"key")).alias("back")).first()
    assert bytes(x.back) == data and sorted(bytes(x.s)) == sorted(data)


def test_press_information(spark):
    from stratalog.functions.press import press

    df = spark.createDataFrame([("a", bytearray(press(b"x" * 1000))), ("b", bytearray(b"other"))], "path string, content binary")
    got = {r.path: r.original_size for r in container.press_info(df).collect()}
    assert got == {"a": 1000, "b": 0}
    one = container.header(spark.createDataFrame([("c", bytearray(write_container(b"abc", 4)))], "path string, content binary"))
    assert container.summary(one).first().text == "version 5, film, 3 of 3 bytes"


def test_either_codec_is_read():
    for codec in ("block", "press"):
        data = write_container(b"payload " * 99, 1, b"m", 1, codec=codec)
        assert read_container(data)[-2:] == (b"payload " * 99, True) and len(data) < 300
        volume = write_volume([("x", b"abc" * 99, True, 0, 0), ("y", b"", True, 0, 0)], created=5, codec=codec)
        assert [r[-1] for r in read_volume(volume)] == [b"abc" * 99, b""]
        entries = list(read_rail(volume))
        assert [(e[0], e[4], e[11]) for e in entries] == [(1, 5, 0), (8, 5, 1), (8, 5, 2)] and entries[1][10] == hashlib.sha3_256(b"abc" * 99).digest()[:16]


def test_overwrite_extract_and_convert(spark, tmp_path):
    sources.register(spark)
    rows = [("a.txt", bytearray(b"one"), 1700000000, 0o600), ("d/b.txt", bytearray(b"two"), 1700000000, 0o644)]
    df = spark.createDataFrame(rows, "path string, content binary, mtime long, permissions int").coalesce(1)
    for _ in range(2):
        df.write.format("archive").option("format", "zip").mode("overwrite").save(str(tmp_path / "z"))
    (file,) = (tmp_path / "z").glob("*.zip")
    with zipfile.ZipFile(file) as z:
        assert [(x.filename, x.date_time[0], x.external_attr >> 16) for x in z.infolist()] == [("a.txt", 2023, 0o600), ("d/b.txt", 2023, 0o644)]
    archive.convert(spark, str(tmp_path / "z"), str(tmp_path / "t"), "tar")
    back = spark.read.format("archive").load(str(tmp_path / "t"))
    assert {(r.path, bytes(r.content), r.mtime, r.permissions) for r in back.collect()} == {(p, bytes(c), t, m) for p, c, t, m in rows}
    archive.extract_to(back.unionByName(back.withColumn("path", F.lit("../x"))), str(tmp_path / "out"))
    assert (tmp_path / "out/a.txt").read_bytes() == b"one" and (tmp_path / "out/a.txt").stat().st_mode & 0o777 == 0o600 and (tmp_path / "out/d/b.txt").exists()
    for name, made in (("container", df.select(F.col("content").alias("payload"))), ("volume", df.select("path", "content")), ("rail", spark.createDataFrame([(1, 0)], "type int, sequence long"))):
        for _ in range(2):
            made.write.format(name).mode("overwrite").save(str(tmp_path / name))
        assert spark.read.format(name).load(str(tmp_path / name)).count() == made.count()
    volume = spark.read.format("volume").load(str(tmp_path / "volume"))
    assert [r.path for r in volume.where("path = 'a.txt'").collect()] == ["a.txt"] and volume.where(F.col("path").startswith("d/")).count() == 1
    assert spark.read.format("rail").load(str(tmp_path / "rail")).where("sequence = 1").count() == 0


def test_log_files_as_a_stream(spark, tmp_path):
    from stratalog.streaming.tails import log_tail

    sources.register(spark)
    for k in range(2):
        spark.createDataFrame([(1, i, 10 * k + i) for i in range(3)], "type int, sequence long, timestamp long").coalesce(1).write.format("rail").mode("append").save(str(tmp_path / "rails"))
        stream = log_tail(spark, f"file://{tmp_path}/rails").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out")
        stream.trigger(availableNow=True).start().awaitTermination()
        assert sorted(r.timestamp for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [*range(3), *range(10, 13)][: 3 * (k + 1)]
