"""Cases of the engine's operators that the supplied tables don't hold."""

import hashlib

import pytest
from pyspark.sql import functions as F

from stratalog.functions import codecs, registry
from stratalog.model import FILM_CURVES
from stratalog.operators import archive, catalog, chunk, container, ledger, locked, log, overlay, spectral


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def volume(spark):
    """Ten tiles and five sounds, and one path twice."""
    tiles = [(i, f"textures/tile_{i:02d}.png", 10, 20, 16, 1) for i in range(10)]
    sounds = [(10 + i, f"audio/sfx_{i:02d}.wav", 5, 9, 3, 2) for i in range(5)]
    return spark.createDataFrame([*tiles, *sounds, (15, "audio/sfx_00.wav", 7, 7, 3, 2)], "idx int, path string, stored_size long, original_size long, wrap_type int, grp int")


def test_catalog_lookups(volume):
    assert catalog.find_prefix(volume, "audio/").count() == 6
    assert catalog.find_prefix(volume, "").count() == 16
    assert catalog.find_group(volume, 1).count() == 10
    assert [r.idx for r in catalog.find_type(volume, 16, 3).collect()] == [0, 1, 2]
    assert catalog.find_first(volume, "audio/sfx_00.wav").collect()[0].idx == 10
    assert catalog.find_first(volume, "none").count() == 0
    assert rows(catalog.totals(volume)) == [(16, 132, 252, 0.52381)]


def test_catalog_prefix_reaches_the_scan(spark, volume, tmp_path):
    volume.write.parquet(str(tmp_path / "v"))
    plan = catalog.find_prefix(spark.read.parquet(str(tmp_path / "v")), "audio/")._jdf.queryExecution().toString()
    assert "StringStartsWith(path,audio/)" in plan


def test_offsets_and_load(spark):
    assets = spark.createDataFrame([("v", 0, "a", 3), ("v", 1, "b", 0), ("v", 2, "c", 4)], "volume string, idx int, path string, stored_size long")
    payload = spark.createDataFrame([("v", bytearray(b"abcdefg"))], "volume string, payload binary")
    found = catalog.load(catalog.with_offsets(assets, "volume"), payload, "volume")
    assert rows(found.select("path", "offset", F.col("content").cast("string"))) == [("a", 0, "abc"), ("b", 3, ""), ("c", 3, "defg")]


def test_log_chain_finds_each_tampered_entry(spark):
    entries = spark.createDataFrame([("x", i, 1, 100 + i) for i in range(4)] + [("y", 0, 1, 5)], "log string, sequence long, type int, timestamp long")
    built = log.chained(entries)
    assert {(r.log, r.broken) for r in log.verify_chain(built).collect()} == {("x", 0), ("y", 0)}
    for k in range(3):
        bad = built.withColumn("body", F.when((F.col("log") == "x") & (F.col("sequence") == k), "tampered").otherwise(F.col("body")))
        assert ("x", 4, 1, k + 1) in rows(log.verify_chain(bad))


def test_log_summary_of_last_entry(spark):
    e = spark.createDataFrame([("x", 0, 10, 4, 3, 0, 4096000, 512000), ("x", 1, 20, 4, 3, 5, 4096000, 512000)], "log string, sequence long, timestamp long, content_type int, layer_flags int, wrap_count int, original_size long, stored_size long")
    assert rows(log.summary(e)) == [("x", 2, 10, 20, 4, 3, 5, 4096000, 512000)]
    assert rows(log.summary(e.limit(0))) == []


def test_children_take_the_prefix_literally(spark):
    e = spark.createDataFrame([("a", i, p) for i, p in enumerate(["d/x", "d/y/", "d/y/z", "d/", "dx", "e"])], "archive string, idx int, path string")
    assert [r.path for r in archive.children(e, "d/").collect()] == ["d/x", "d/y/"]
    assert {r.path for r in archive.children(e, "d").collect()} == {"dx", "d/"}  # no slash is implied
    assert {r.path for r in archive.children(e, "").collect()} == {"d/", "dx", "e"}


def test_extraction_report(spark):
    e = spark.createDataFrame([("a", "x", bytearray(b"123456789"), 3421780262, False), ("a", "../y", None, None, False), ("a", "z", bytearray(b"1"), 5, False), ("a", "w", None, 1, True)], "archive string, path string, content binary, crc32 long, encrypted boolean")
    assert rows(archive.extraction_report(e)) == [("a", 4, 1, 2)]


@pytest.mark.parametrize("magic,name", [(b"PK\x03\x04", "zip"), (b"PK\x05\x06", "zip"), (b"7z\xbc\xaf\x27\x1c", "7z"), (b"Rar!", "rar"), (b"\x1f\x8b\x08\x00", "tar.gz"), (b"\xfd7zXZ\x00", "tar.xz"), (b"BZh9", "tar.bz2"), (bytes(257) + b"ustar\x00", "tar"), (b"PK", None), (b"", None)])
def test_formats(spark, magic, name):
    assert spark.createDataFrame([(bytearray(magic),)], "c binary").select(archive.format_of_content(F.col("c"))).first()[0] == name


def test_overlay_layers(spark):
    base = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, content string")
    over = spark.createDataFrame([("a", "x"), ("b", ""), ("d", "y")], "path string, content string")
    assert rows(overlay.resolve(base, over)) == [("a", "x", "overlay"), ("b", "2", "base"), ("c", "3", "base"), ("d", "y", "overlay")]
    gone = overlay.delete(over, spark.createDataFrame([("a",)], "path string"))
    assert ("a", "1", "base") in rows(overlay.resolve(base, gone))
    versions = spark.createDataFrame([("a", "1", 1), ("a", "3", 3)], "path string, content string, version int")
    assert rows(overlay.write(versions, spark.createDataFrame([("a", "2", 2)], "path string, content string, version int"))) == [("a", "3", 3)]
    assert rows(overlay.listing(spark.createDataFrame([("s/.hidden", ""), ("s/b", ""), ("t/c", "")], "path string, content string"), "s/")) == [("s/b", "")]


def test_parts_that_are_missing_broken_or_doubled(spark):
    d = spark.createDataFrame([(i, "abcdefghij" * 3) for i in range(5)] + [(9, "")], "id int, payload string")
    parts = chunk.split(d, 8)
    assert parts.where("id = 9").count() == 1
    bad = parts.where("not (id = 1 and part = 3)").withColumn("chunk", F.when((F.col("id") == 2) & (F.col("part") == 0), "tampered").otherwise(F.col("chunk")))
    bad = bad.withColumn("part_hash", F.when((F.col("id") == 3) & (F.col("part") == 0), F.sha2(F.lit("x"), 256)).otherwise(F.col("part_hash")))
    bad = bad.unionByName(parts.where("id = 4 and part = 0"))
    got = {r.id: r.status for r in chunk.join(bad).collect()}
    assert got == {0: "whole", 1: "missing", 2: "broken part", 3: "broken part", 4: "missing", 9: "whole"}


def test_ledger_rules(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(ledger.epoch(F.lit(50), F.lit(100), 60)) == 0
    assert value(ledger.epoch(F.lit(219), F.lit(100), 60)) == 1
    access = lambda now, a, b, n: value(ledger.access(F.lit(now), F.lit(a), F.lit(b), F.lit(n)))
    assert [access(1, 2, 5, 1), access(5, 2, 5, 1), access(6, 2, 5, 1), access(3, 2, 5, 0), access(3, None, None, None)] == ["delayed", "open", "expired", "exhausted", "open"]
    names = F.array(*[F.lit(x) for x in ("ARCV", "PKEY", "TOTP")])
    assert value(ledger.label(F.lit(8 + 16 + 2), names, F.lit(3), F.lit(False))) == "app fused ledger totp purge timed"
    assert value(ledger.label(F.lit(0), F.array().cast("array<string>"), F.lit(0), F.lit(True))) == "unlocked"


def test_spectral(spark):
    flat = spark.createDataFrame([(1, [1.0] * 16), (2, [0.0] * 16)], "pixel int, bands array<double>")
    got = {r.pixel: r for r in flat.select("pixel", *spectral.integrate(F.col("bands"), 16)).collect()}
    assert got[1].Y == pytest.approx(1.0) and got[2].X == 0.0
    density = spark.createDataFrame([(0.0,), (1e-6,), (0.01,), (1.0,), (1e6,)], "e double").select(spectral.film_density(F.col("e"), F.lit(1.0), FILM_CURVES["default"])).collect()
    assert density[0][0] == -0.15 and density[2][0] < density[3][0] and density[3][0] == density[-1][0] == 3.0
    samples = spark.createDataFrame([(1, x, v) for x, v in enumerate([5, 5, 9, 0])], "img int, x int, v int")
    coded = spectral.xor_encode(samples, ["img"], "x", "v")
    assert [r.delta for r in coded.orderBy("x").collect()] == [5, 0, 12, 9]
    assert [r.value for r in spectral.xor_decode(coded.drop("v"), ["img"], "x").orderBy("x").collect()] == [5, 5, 9, 0]


def test_published_hashes(spark):
    r = spark.createDataFrame([("abc", 0), ("", 0), (None, 0)], "t string, s int").select(codecs.sha3_256("t"), codecs.xxhash32("t", "s")).collect()
    assert r[0][0] == "3a985da74fe225b2045c172d6bd390bd855f086e3e9d525b46bfe24511431532"
    assert r[0][1] == 0x32D153FF and r[1][1] == 0x02CC5D05 and r[2][0] is None
    assert spark.createDataFrame([("mzxw 6ytb",), ("1",)], "t string").select(codecs.base32_decode("t")).collect()[0][0] == b"fooba"


@pytest.mark.parametrize("raw", [b"", b"a", b"\x00" * 700_000, bytes(range(256)) * 2000])
def test_packed_streams(raw):
    data = codecs.pack_bytes(raw)
    assert codecs.unpack_bytes(data) == raw
    for cut in (5, 12, len(data) - 1):
        if 0 < cut < len(data) and data[:cut] != data:
            with pytest.raises(ValueError):
                codecs.unpack_bytes(data[:cut])
    if raw:
        with pytest.raises(ValueError):
            codecs.unpack_bytes(data[:-1] + bytes([data[-1] ^ 1]))


def test_normalised_frequencies_sum_up():
    for counts in ({1: 1}, {1: 5, 2: 5}, {i: 1 + i**3 for i in range(256)}, {0: 10**9, **{i: 1 for i in range(1, 256)}}):
        scaled = codecs.normalise(counts)
        assert sum(scaled.values()) == 4096 and min(scaled.values()) >= 1 and scaled.keys() == counts.keys()
    assert set(codecs.normalise({}).values()) == {16}


def test_fuse_chain(spark):
    chain = locked.fuse_chain(F.lit(b"secret"), 4)
    child, kept = locked.fuse_split(chain, 1)
    row = spark.range(1).select(chain.alias("c"), child.alias("child"), kept.alias("kept"), locked.fuse_fits(F.get(chain, F.lit(3)), F.get(chain, F.lit(4))).alias("fits"), locked.fuse_fits(F.get(chain, F.lit(2)), F.get(chain, F.lit(4))).alias("skips")).first()
    want = [hashlib.sha256(b"secret").hexdigest()]
    for _ in range(4):
        want.append(hashlib.sha256(want[-1].encode()).hexdigest())
    assert row.c == want and row.child == want[3:] and row.kept == want[:4] and row.fits and not row.skips


def test_registry(spark):
    r = registry.Registry()
    assert r.register(registry.Module("one", 1)) and not r.register(registry.Module("again", 1)) and not r.register(registry.Module("old", 2, version=2))
    d = registry.default()
    assert d.find(1).name == "raw" and d.find(9) is None and d.probe(codecs.pack_bytes(b"x")).name == "press" and d.probe(b"x").name == "raw"
    d.install(spark)
    assert spark.sql("SELECT unpack_bytes(pack_bytes('abc')) = CAST('abc' AS BINARY)").first()[0]
    assert d.listing(spark).count() == 2


def test_container_expressions(spark):
    from stratalog.sources.containers import write_container

    data = write_container(b"payload", 4, b"meta", 1)
    files = spark.createDataFrame([("f", bytearray(data)), ("short", bytearray(b"CUTE\x05"))], "path string, content binary")
    r = container.header(files).collect()
    assert len(r) == 1 and (r[0].version, r[0].type, r[0].compressed, r[0].encrypted, r[0].original_size, r[0].meta_size) == (5, "film", True, False, 7, 4)
    assert r[0].hash == hashlib.sha3_256(b"payload").hexdigest()
    assert '"type":"film"' in container.info(container.header(files)).first().info
