"""Registered queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions import codecs
from stratalog.model import FILM_CURVES
from stratalog.operators import archive, catalog, chunk, container, images, ledger, locked, log, overlay, spectral
from stratalog.plans import adapters, packed
from stratalog.plans.adapters import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_ASSETS = """WITH assets AS (SELECT doc_id AS idx, concat_ws('/', lang, source, doc_id) AS path, (strlen(coalesce(text, '')) + 2) // 3 AS stored_size,
  strlen(coalesce(text, '')) AS original_size, 8 AS wrap_type, lang AS grp, source FROM documents)
"""
_LOG = """WITH e AS (SELECT user_id AS log, ts, event_id, cast(event_id % 9 AS INT) AS type, cast(floor(epoch(ts)) AS BIGINT) AS timestamp, cast(floor(value * 100) AS BIGINT) AS stored_size, event_type,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sequence FROM events)
"""
_PAGES = """WITH r AS (SELECT page_id AS idx, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS rest, strlen(html) AS size FROM pages),
p AS (SELECT split_part(rest, '/', 1) AS archive, idx, regexp_replace(rest, '^[^/]*', '') AS path, size FROM r)
"""
_LEDGER = """WITH o AS (SELECT o_custkey AS key, o_orderkey AS event, cast(floor(epoch(o_orderdate)) AS BIGINT) AS ts FROM orders),
l AS (SELECT *, greatest(0, (ts - min(ts) OVER (PARTITION BY key)) // 2592000) AS epoch FROM o)
"""


@query(_ASSETS + "SELECT grp, count(*) AS assets, sum(stored_size)::BIGINT AS stored, sum(original_size)::BIGINT AS original, round(sum(stored_size) / nullif(sum(original_size), 0), 6) AS ratio FROM assets WHERE starts_with(path, 'en/') GROUP BY grp")
def asset_prefix_totals(spark, sf_dir):
    return catalog.totals(catalog.find_prefix(adapters.assets(spark, sf_dir), "en/"), "grp")


@query(_ASSETS + "SELECT count(*) AS assets, sum(stored_size)::BIGINT AS stored, sum(original_size)::BIGINT AS original, round(sum(stored_size) / nullif(sum(original_size), 0), 6) AS ratio FROM assets")
def asset_totals(spark, sf_dir):
    return catalog.totals(adapters.assets(spark, sf_dir))


@query(_ASSETS + "SELECT idx, path, original_size FROM assets WHERE path = 'en/src1/1' ORDER BY idx LIMIT 1")
def asset_find_first(spark, sf_dir):
    return catalog.find_first(adapters.assets(spark, sf_dir), "en/src1/1").select("idx", "path", "original_size")


@query(_ASSETS + "SELECT idx, path FROM assets WHERE grp = 'fr' ORDER BY idx LIMIT 25")
def asset_find_group(spark, sf_dir):
    return catalog.find_group(adapters.assets(spark, sf_dir), "fr", 25).select("idx", "path")


@query(_ASSETS + "SELECT idx, path FROM assets WHERE wrap_type = 8 ORDER BY idx LIMIT 40")
def asset_find_type(spark, sf_dir):
    return catalog.find_type(adapters.assets(spark, sf_dir), 8, 40).select("idx", "path")


@query(_ASSETS + "SELECT idx, path, source, stored_size, coalesce(sum(stored_size) OVER (PARTITION BY source ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM assets")
def asset_offsets(spark, sf_dir):
    return catalog.with_offsets(adapters.assets(spark, sf_dir), "source").select("idx", "path", "source", "stored_size", "offset")


def _picked(id_column: str, *values: str):
    """One of the values for each row, by turns."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(id_column) % len(values) + 1).cast("int"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN 'image' WHEN 1 THEN 'scene' WHEN 2 THEN 'model' WHEN 3 THEN 'image exr-ext' WHEN 4 THEN NULL WHEN 5 THEN 'spreadsheet' WHEN 6 THEN 'document' END AS wraps FROM part""")
def wrap_probe(spark, sf_dir):
    paths = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(".", F.col("p_brand"), _picked("p_partkey", "png", "usd", "onnx", "exr", "MD", "csv", "md", "none")).alias("path"))
    return paths.select("id", F.array_join(container.wraps_of(F.col("path")), " ").alias("wraps"))


@query("SELECT p_partkey AS id, CASE p_size % 50 WHEN 1 THEN 'image' WHEN 2 THEN 'spectral' WHEN 3 THEN 'audio' WHEN 8 THEN 'document' WHEN 10 THEN 'font' WHEN 43 THEN 'vector' WHEN 49 THEN 'aces' ELSE 'unknown' END AS wrap FROM part WHERE p_size % 50 IN (0, 1, 2, 3, 8, 10, 43, 44, 45, 49)")
def wrap_names(spark, sf_dir):
    code = (F.col("p_size") % 50).cast("int")
    return table(spark, sf_dir, "part").where(code.isin(0, 1, 2, 3, 8, 10, 43, 44, 45, 49)).select(F.col("p_partkey").alias("id"), container.wrap_type_name(code).alias("wrap"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'zip' WHEN p_partkey % 5 = 1 THEN 'tar.gz' WHEN p_partkey % 5 = 2 THEN 'tar.bz2'
  ELSE CASE p_partkey % 8 WHEN 0 THEN 'zip' WHEN 1 THEN 'tar.gz' WHEN 3 THEN 'zip' WHEN 4 THEN 'zip' WHEN 6 THEN '7z' ELSE 'unknown' END END AS format FROM part""")
def archive_detect(spark, sf_dir):
    """Magic bytes go before the extension."""
    p = table(spark, sf_dir, "part")
    path = F.concat_ws(".", "p_brand", _picked("p_partkey", "zip", "tgz", "txt", "jar", "ZIP", "TAR", "7z", "none"))
    magic = F.unhex(_picked("p_partkey", "504B0304", "1F8B0800", "425A6839", "00000000", ""))
    return p.select(F.col("p_partkey").alias("id"), archive.format_of_file(path, magic).alias("format"))


@query("SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN 'zip' WHEN 1 THEN 'tar.gz' WHEN 2 THEN 'tar.xz' WHEN 3 THEN 'unknown' WHEN 4 THEN 'tar' WHEN 5 THEN 'container' WHEN 6 THEN 'rar' ELSE 'tar.bz2' END AS format FROM part")
def archive_format_of_name(spark, sf_dir):
    name = F.concat("p_brand", _picked("p_partkey", ".ZIP", ".Tar.gz", ".TXZ", ".jar", ".TAR", ".cute", ".RAR", ".tbz2"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), archive.format_of_name(name).alias("format"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN 'unknown' WHEN p_partkey % 4 = 2 THEN 'film' WHEN p_partkey % 4 = 3 THEN 'press' WHEN p_size % 7 >= 5 THEN
  CASE p_partkey % 6 WHEN 1 THEN 'raw' WHEN 2 THEN 'press' WHEN 3 THEN 'crypt' WHEN 4 THEN 'film' WHEN 5 THEN 'depo' ELSE 'unknown' END
  WHEN p_size % 7 = 1 THEN 'crypt' WHEN p_size % 7 BETWEEN 2 AND 4 THEN 'depo' ELSE 'unknown' END AS type FROM part""")
def container_detect(spark, sf_dir):
    """Headers of all versions and types; every eleventh is cut short."""
    byte = lambda n: F.unhex(F.lpad(F.hex(n.cast("long")), 2, "0"))
    whole = F.concat(_picked("p_partkey", "CUTE", "CUTE", "CFSP", "PRSS").cast("binary"), byte(F.col("p_size") % 7), byte(F.col("p_partkey") % 6))
    content = F.when(F.col("p_partkey") % 11 == 0, F.substring(whole, 1, 5)).otherwise(whole)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), container.type_name(container.content_type(content)).alias("type"))


@query("SELECT page_id::VARCHAR AS path, 5 AS version, 'raw' AS type, true AS compressed, false AS encrypted, strlen(html) AS original_size, 0 AS meta_size, sha256(html) AS payload FROM pages WHERE html IS NOT NULL")
def container_round_trip(spark, sf_dir):
    """Pages as containers: the header read by expressions, the payload unpacked."""
    files = table(spark, sf_dir, "pages").where("html is not null").select(F.col("page_id").cast("string").alias("path"), packed.containers("html").alias("content"))
    fields = container.header(files).select("path", "version", "type", "compressed", "encrypted", "original_size", "meta_size")
    return fields.join(files.select("path", F.sha2(packed.payloads("content"), 256).alias("payload")), "path")


@query("""SELECT lang || '-' || doc_id // 500 AS volume, concat_ws('/', lang, source, doc_id) AS path, strlen(coalesce(text, '')) AS original_size, 8 AS wrap_type, sha256(coalesce(text, '')) AS content FROM documents""")
def volume_round_trip(spark, sf_dir):
    """Documents as volumes of at most 500 assets, mounted again."""
    d = table(spark, sf_dir, "documents")
    volume = F.concat_ws("-", "lang", F.floor(F.col("doc_id") / 500).cast("string"))
    rows = d.select(volume.alias("volume"), F.col("doc_id").alias("idx"), F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"), F.lit(8).alias("wrap_type"))
    return packed.mounted(packed.volumes(rows)).select("volume", "path", "original_size", "wrap_type", F.sha2("content", 256).alias("content"))


@query(_LOG + "SELECT log, sequence, type, timestamp, stored_size FROM e")
def rail_round_trip(spark, sf_dir):
    """Each user's log as a file of records, opened again."""
    return packed.opened_rails(packed.rails(adapters.log_entries(spark, sf_dir))).select("log", "sequence", "type", "timestamp", "stored_size")


@query("SELECT page_id // 100 AS archive, 'p/' || page_id || '.html' AS path, strlen(html) AS size, sha256(html) AS content, true AS intact FROM pages WHERE html IS NOT NULL")
def archive_round_trip(spark, sf_dir):
    """Pages as zip archives of at most 100 entries, opened again; contents are held against their CRC-32."""
    p = table(spark, sf_dir, "pages").where("html is not null")
    rows = p.select(F.floor(F.col("page_id") / 100).cast("long").alias("archive"), F.concat(F.lit("p/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").cast("binary").alias("content"))
    entries = packed.opened_archives(packed.archives(rows))
    return entries.select("archive", "path", "size", F.sha2("content", 256).alias("content"), (F.crc32("content") == F.col("crc32")).alias("intact"))


@query(_ASSETS + "SELECT idx, path FROM assets WHERE idx = 7")
def asset_at(spark, sf_dir):
    return catalog.asset_at(adapters.assets(spark, sf_dir), 7).select("idx", "path")


@query(_PAGES + "SELECT archive, path, size FROM p WHERE idx = 7")
def archive_entry_at(spark, sf_dir):
    return archive.entry_at(adapters.page_entries(spark, sf_dir), 7).select("archive", "path", "size")


@query("""SELECT o_orderkey AS id, cast((year(o_orderdate) - 1980) * 512 + month(o_orderdate) * 32 + day(o_orderdate) AS INT) AS dos_date,
  cast(hour(t) * 2048 + minute(t) * 32 + second(t) // 2 AS INT) AS dos_time, cast(epoch(t) - second(t) % 2 AS BIGINT) AS back FROM (SELECT *, o_orderdate + INTERVAL 1 SECOND * (o_orderkey % 86400) AS t FROM orders)""")
def archive_dos_times(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 86400).alias("t"))
    o = o.select("id", *archive.to_dos(F.col("t")))
    return o.select("id", "dos_date", "dos_time", F.unix_seconds(archive.from_dos(F.col("dos_date"), F.col("dos_time")).cast("timestamp")).alias("back"))


@query(_LOG + "SELECT log, count(*) AS entries, arg_min(timestamp, sequence) AS created_at, arg_max(timestamp, sequence) AS modified_at, arg_max(stored_size, sequence) AS stored_size FROM e GROUP BY log")
def log_summary(spark, sf_dir):
    return log.summary(adapters.log_entries(spark, sf_dir))


@query(_LOG + "SELECT log, sequence, type FROM e WHERE sequence = 3")
def log_entry_at(spark, sf_dir):
    return log.entry_at(adapters.log_entries(spark, sf_dir), 3).select("log", "sequence", "type")


@query(_LOG + "SELECT log, sequence, event_id FROM e WHERE type = 8 AND event_type = 'click'")
def log_collection(spark, sf_dir):
    entries = adapters.log_entries(spark, sf_dir).withColumn("collection_id", F.col("event_type"))
    return log.find_collection(entries, "click").select("log", "sequence", "event_id")


@query("""WITH e AS (SELECT user_id AS log, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sequence FROM events)
SELECT log, count(*) AS entries, cast(count(*) FILTER (sequence = 2) AS BIGINT) AS broken, CASE WHEN count(*) > 2 THEN 2 END::BIGINT AS first_broken FROM e GROUP BY log""")
def log_chain_verify(spark, sf_dir):
    """Chains built over all logs, then the entry before each log's third changed: the third must be found broken, and no other."""
    rows = adapters.log_entries(spark, sf_dir).select("log", "sequence", "type", "timestamp", "stored_size")
    built = log.chained(rows)
    tampered = built.withColumn("body", F.when(F.col("sequence") == 1, F.concat("body", F.lit("x"))).otherwise(F.col("body")))
    return log.verify_chain(tampered)


@query("""WITH e AS (SELECT user_id AS log, event_id, ts, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts, event_id) AS s, event_id % 2 AS part FROM events)
SELECT log, event_id, row_number() OVER (PARTITION BY log ORDER BY part, s) - 1 AS sequence FROM e""")
def log_merge(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("log"), "event_id", "ts")
    halves = [log.sequenced(e.where(F.col("event_id") % 2 == k), "ts", "event_id") for k in (0, 1)]
    return log.merge(*halves).select("log", "event_id", "sequence")


@query("SELECT user_id AS log, count(*) AS entries, 0 AS broken, NULL::BIGINT AS first_broken FROM events GROUP BY user_id")
def log_merge_chain(spark, sf_dir):
    """Two chained logs merged: the chain is built anew, so it holds."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("log"), "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    halves = [log.chained(log.sequenced(e.where(F.col("event_id") % 2 == k), "at", "event_id")) for k in (0, 1)]
    return log.verify_chain(log.merged_chain(*halves))


@query(_LOG + "SELECT log, sequence, last_value(CASE WHEN type = 0 THEN stored_size END IGNORE NULLS) OVER (PARTITION BY log ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stored_size FROM e")
def log_carry_forward(spark, sf_dir):
    entries = adapters.log_entries(spark, sf_dir).withColumn("stored_size", F.when(F.col("type") == 0, F.col("stored_size")))
    return log.carried(entries, "stored_size").select("log", "sequence", "stored_size")


@query(_PAGES + "SELECT idx, path, size FROM p WHERE starts_with(path, '/es/') AND substr(path, 5) <> '' AND strpos(substr(path, 5), '/') IN (0, length(substr(path, 5)))")
def archive_children(spark, sf_dir):
    return archive.children(adapters.page_entries(spark, sf_dir), "/es/").select("idx", "path", "size")


@query(_PAGES + "SELECT archive, count(*) AS entries, sum(size)::BIGINT AS bytes FROM p WHERE NOT contains(path, '..') GROUP BY archive")
def archive_safe_totals(spark, sf_dir):
    return archive.safe(adapters.page_entries(spark, sf_dir)).groupBy("archive").agg(F.count("*").alias("entries"), F.sum("size").alias("bytes"))


def _sides(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("content"))
    o = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("path"), F.when(F.col("toxic") == 1, F.lit("")).otherwise(F.concat(F.lit("q"), F.col("quality").cast("string"))).alias("content"))
    return d, o


_SIDES = """WITH b AS (SELECT doc_id AS path, sha256(text) AS content FROM documents), o AS (SELECT doc_id AS path, CASE WHEN toxic = 1 THEN '' ELSE 'q' || quality END AS content FROM labels)
"""


@query(_SIDES + "SELECT coalesce(b.path, o.path) AS path, coalesce(nullif(o.content, ''), b.content) AS content, CASE WHEN nullif(o.content, '') IS NULL THEN 'base' ELSE 'overlay' END AS layer FROM b FULL JOIN o ON b.path = o.path")
def overlay_resolve(spark, sf_dir):
    return overlay.resolve(*_sides(spark, sf_dir))


@query(_SIDES + "SELECT path FROM b WHERE path IN (SELECT path FROM o)")
def overlay_existing(spark, sf_dir):
    return overlay.existing(*_sides(spark, sf_dir)).select("path")


@query(_SIDES + "SELECT path, content FROM o WHERE path % 3 <> 0")
def overlay_delete(spark, sf_dir):
    base, over = _sides(spark, sf_dir)
    return overlay.delete(over, base.where(F.col("path") % 3 == 0).select("path"))


@query("SELECT p_partkey AS id, '/home/u/overlays/' || CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_type || '.vol' END AS folder FROM part")
def overlay_folder(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    path = F.concat(F.lit("/data/volumes/"), "p_type", F.lit(".vol"))
    return p.select(F.col("p_partkey").alias("id"), overlay.folder_of(path, F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")), "/home/u/overlays/").alias("folder"))


@query(_SIDES + "SELECT path FROM b WHERE path NOT IN (SELECT path FROM o)")
def overlay_untouched(spark, sf_dir):
    return overlay.untouched(*_sides(spark, sf_dir)).select("path")


@query("SELECT user_id AS path, arg_max(event_type, event_id) AS content, max(event_id) AS version FROM events GROUP BY user_id")
def overlay_write(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("event_type").alias("content"), F.col("event_id").alias("version"))
    return overlay.write(e.where("version % 3 = 0"), e.where("version % 3 <> 0"))


@query("SELECT lang, count(*) AS files, sum(strlen(text))::BIGINT AS bytes FROM documents WHERE NOT starts_with(source, '.') GROUP BY lang")
def overlay_size(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat_ws("/", "lang", "source").alias("path"), F.col("text").alias("content"), "lang")
    return overlay.size(overlay.listing(d, ""), "lang")


_PARTS = """WITH d AS (SELECT doc_id AS id, text AS payload, length(text) AS n FROM documents),
p AS (SELECT id, unnest(range(greatest(1, cast(ceil(n / 2000) AS BIGINT)))) AS part, payload, n FROM d)
"""


@query(_PARTS + "SELECT id, cast(part AS INT) AS part, cast(greatest(1, ceil(n / 2000)) AS INT) AS parts, part * 2000 AS \"offset\", length(substr(payload, part * 2000 + 1, 2000)) AS length, sha256(substr(payload, part * 2000 + 1, 2000)) AS part_hash, sha256(payload) AS full_hash FROM p")
def chunk_split(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("payload"))
    return chunk.split(d, 2000).drop("chunk")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 AND length(text) > 2000 THEN 'missing' ELSE 'whole' END AS status, CASE WHEN doc_id % 7 = 0 AND length(text) > 2000 THEN NULL ELSE sha256(text) END AS hash FROM documents")
def chunk_join(spark, sf_dir):
    """Every document split; of every seventh the second part is lost; what is put together is whole or told missing."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("payload"))
    left = chunk.split(d, 2000).where(~((F.col("id") % 7 == 0) & (F.col("part") == 1)))
    return chunk.join(left).select("id", "status", F.sha2("payload", 256).alias("hash"))


@query("""WITH s AS (SELECT lang, unnest(string_split(text, '')) AS symbol FROM documents), c AS (SELECT lang, symbol, count(*) AS n FROM s WHERE symbol <> '' GROUP BY ALL)
SELECT lang, symbol, n, coalesce(sum(n) OVER (PARTITION BY lang ORDER BY symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM c""")
def char_histogram(spark, sf_dir):
    return codecs.histogram(table(spark, sf_dir, "documents"), "text", "lang")


@query(_LEDGER + "SELECT event, epoch, CASE WHEN epoch < 2 THEN 'delayed' WHEN epoch > 20 THEN 'expired' WHEN event % 3 = 0 THEN 'exhausted' ELSE 'open' END AS decision FROM l")
def epoch_access(spark, sf_dir):
    decision = ledger.access(F.col("epoch"), F.lit(2), F.lit(20), F.col("event") % 3)
    return adapters.ledger(spark, sf_dir).select("event", "epoch", decision.alias("decision"))


@query(_LEDGER + "SELECT event, key, cast(row_number() OVER w AS INT) AS use, row_number() OVER w <= 3 AS granted, cast(greatest(0, 3 - row_number() OVER w) AS INT) AS remaining FROM l WINDOW w AS (PARTITION BY key ORDER BY ts, event)")
def fuse_consumption(spark, sf_dir):
    return ledger.consume(adapters.ledger(spark, sf_dir), "key", 3, "ts", "event").select("event", "key", "use", "granted", "remaining")


@query(_LEDGER + "SELECT event, epoch > coalesce(lag(epoch) OVER (PARTITION BY key ORDER BY ts, event), -1) AS beat FROM l")
def heartbeat(spark, sf_dir):
    return ledger.heartbeats(adapters.ledger(spark, sf_dir), "key", "ts", "event").select("event", "beat")


@query(_LEDGER + "SELECT event, epoch BETWEEN 1 AND 5 AS valid FROM l")
def token_window(spark, sf_dir):
    return adapters.ledger(spark, sf_dir).select("event", ledger.in_window(F.col("epoch"), F.lit(1), 4).alias("valid"))


@query(_LEDGER + "SELECT key, arg_min(event, (ts, event)) AS event, min(ts) AS ts FROM l GROUP BY key")
def first_claim(spark, sf_dir):
    return ledger.claims(adapters.ledger(spark, sf_dir).select("key", "event", "ts"), "key", "ts", "event")


@query("SELECT p_partkey AS id, p_size % 4 AS role_level FROM part WHERE p_size % 4 >= 2")
def role_visible(spark, sf_dir):
    entries = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 4).alias("role_level"))
    return ledger.visible(entries, 2)


@query("""WITH f AS (SELECT o_orderkey AS id, cast(o_orderkey % 256 AS INT) AS bits, o_custkey % 5 AS c FROM orders)
SELECT id, concat_ws(' ', CASE WHEN c = 0 THEN 'app' WHEN c = 1 THEN 'archive' WHEN c = 2 THEN 'parted' WHEN id % 11 = 0 THEN 'unlocked' ELSE 'file' END,
  CASE WHEN bits & 8 <> 0 THEN 'fused' END, CASE WHEN c = 3 THEN 'fbox' END, CASE WHEN id % 3 > 0 THEN 'ledger' END, CASE WHEN c = 3 THEN 'totp' END,
  CASE WHEN bits & 64 <> 0 THEN 'keychain' END, CASE WHEN bits & 16 <> 0 THEN 'purge' END, CASE WHEN bits & 2 <> 0 THEN 'timed' END, CASE WHEN bits & 4 <> 0 THEN 'delayed' END) AS label FROM f""")
def lock_labels(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c"))
    kind = F.col("c") % 5
    sections = F.when(kind == 0, F.array(F.lit("ARCV"), F.lit("PKEY"))).when(kind == 1, F.array(F.lit("ARCV"))).when(kind == 2, F.array(F.lit("PART"))).when(kind == 3, F.array(F.lit("FBOX"), F.lit("TOTP"))).otherwise(F.array().cast("array<string>"))
    return o.select("id", ledger.label((F.col("id") % 256).cast("int"), sections, F.col("id") % 3, F.col("id") % 11 == 0).alias("label"))


def _le(value: str, size: int) -> str:
    """SQL for the lowest bytes of a number as hex digits, the lowest first."""
    return " || ".join(f"substr(lpad(hex({value}), 16, '0'), {15 - 2 * k}, 2)" for k in range(size))


_CHAIN = _LEDGER.replace("WITH o", "WITH RECURSIVE o") + f""", s AS (SELECT key, event, ts, epoch, event % 5 AS action, row_number() OVER (PARTITION BY key ORDER BY ts, event) - 1 AS sequence FROM l),
c AS (SELECT key, sequence, sha256(from_hex(repeat('00', 32) || {_le('ts', 8)} || {_le('action', 4)} || {_le('epoch', 4)})) AS hash FROM s WHERE sequence = 0
  UNION ALL SELECT s.key, s.sequence, sha256(from_hex(c.hash || {_le('s.ts', 8)} || {_le('s.action', 4)} || {_le('s.epoch', 4)})) FROM c JOIN s ON s.key = c.key AND s.sequence = c.sequence + 1)
"""


def _ledger_chain(spark, sf_dir):
    return locked.ledger_chain(adapters.ledger(spark, sf_dir).withColumn("action", F.col("event") % 5), "key")


@query(_CHAIN + "SELECT key, cast(sequence AS INT) AS sequence, hash FROM c")
def ledger_chain(spark, sf_dir):
    return _ledger_chain(spark, sf_dir).select("key", "sequence", F.lower(F.hex("hash")).alias("hash"))


@query(_LEDGER + "SELECT key, count(*) AS entries, CASE WHEN count(*) > 2 THEN 2 WHEN count(*) = 2 THEN 1 ELSE 0 END::BIGINT AS broken FROM l GROUP BY key")
def ledger_verify(spark, sf_dir):
    """Of each key the second entry's action is changed: its own hash no longer fits, and with another hash the third's neither."""
    tampered = _ledger_chain(spark, sf_dir).withColumn("hash", F.when(F.col("sequence") == 1, F.unhex(F.sha2("hash", 256))).otherwise(F.col("hash")))
    return locked.verify_ledger(tampered, "key")


@query(_CHAIN + "SELECT key, arg_max(hash, sequence) AS hash FROM c GROUP BY key")
def ledger_last_hash(spark, sf_dir):
    return locked.last_hash(_ledger_chain(spark, sf_dir), "key").select("key", F.lower(F.hex("hash")).alias("hash"))


@query(_LEDGER + """, u AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, event) AS use FROM l)
SELECT key, event, CASE WHEN use <= 3 THEN 3 ELSE 2 END AS action FROM u UNION ALL SELECT key, event, 1 FROM l""")
def ledger_failures(spark, sf_dir):
    events = adapters.ledger(spark, sf_dir)
    decisions = ledger.consume(events, "key", 3, "ts", "event")
    return locked.with_failures(events.withColumn("action", F.lit(1)), decisions).select("key", "event", "action")


@query("SELECT c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN 9 ELSE c_nationkey % 3 END AS remaining FROM customer")
def fuse_refresh(spark, sf_dir):
    """Half of the requests bring the right key, the others another's."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_nationkey") % 3).alias("remaining"), F.lit(9).alias("max_fuses"), F.sha2("c_name", 256).alias("refresh_hash"))
    requests = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.lit("other")).alias("refresh_key"))
    return locked.refreshed(c, requests).select("key", "remaining")


@query("""SELECT s_suppkey AS id, sha256(s_name) AS root, sha256(sha256(sha256(sha256(s_name)))) AS reader, sha256(encode(s_name) || from_hex('00') || encode('a/' || s_suppkey)) AS file,
  sha256(sha256(sha256(s_name))) AS child_first, 2 AS kept FROM supplier""")
def derived_keys(spark, sf_dir):
    """Keys of roles and files, and a chain of four fuses of which a child gets the newest two."""
    name = F.col("s_name")
    keys = locked.role_keys(name.cast("binary"))
    chain = locked.fuse_chain(name.cast("binary"), 4)
    child, kept = locked.fuse_split(chain, 2)
    file = locked.file_key(name, F.concat(F.lit("a/"), F.col("s_suppkey").cast("string")))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.element_at(keys, 1).alias("root"), F.element_at(keys, 4).alias("reader"), file.alias("file"), F.element_at(child, 1).alias("child_first"), (F.size(kept) - 1).alias("kept"))


def _locked_files(spark, sf_dir):
    """Orders as locked files: a payload of up to 49 bytes, up to two ledger rows and a trailer section; some are cut short or no locked files."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("ts"))
    le, zeros = locked.little_endian_bytes, lambda n: F.lit(bytes(n))
    rows = F.concat(le(F.col("ts"), 8), zeros(32), le(F.col("id") % 5, 4), le(F.col("c"), 4))
    header = F.concat(F.lit(b"CUTE\x04"), le(F.col("id") % 64, 1), zeros(44), le(F.col("ts"), 8), le(F.lit(3600), 4), zeros(8), le(F.col("c"), 2), le(F.col("c") % 3, 2), zeros(140), le(F.col("id") % 50, 4), le(F.col("id") % 3, 2))
    body = F.concat(F.unhex(F.repeat(F.lit("41"), (F.col("id") % 50).cast("int"))), *[F.when(F.col("id") % 3 > k, rows).otherwise(zeros(0)) for k in (0, 1)])
    section = F.concat(F.lit(b"TOTP"), le(F.when(F.col("id") % 7 == 0, F.lit(99)).otherwise(F.lit(3)), 4), F.lit(b"abc"))
    whole = F.concat(header, body, section)
    cut = F.when(F.col("id") % 11 == 0, F.substring(whole, 1, 219)).when(F.col("id") % 13 == 0, F.substring(whole, 1, 220)).otherwise(whole)
    return o.select(F.col("id").cast("string").alias("path"), cut.alias("content"))


@query("""SELECT o_orderkey::VARCHAR AS path, CASE WHEN o_orderkey % 11 = 0 THEN 'magic' WHEN o_orderkey % 13 = 0 THEN CASE WHEN o_orderkey % 50 + o_orderkey % 3 > 0 THEN 'cut short' ELSE '' END
  WHEN o_orderkey % 7 = 0 THEN 'trailer' ELSE '' END AS found FROM orders""")
def locked_verify(spark, sf_dir):
    return locked.verify(_locked_files(spark, sf_dir)).select("path", F.array_join("found", " ").alias("found"))


@query("""SELECT o_orderkey::VARCHAR AS path, 4 AS version, o_orderkey % 64 AS flags, cast(floor(epoch(o_orderdate)) AS BIGINT) AS created, 3600 AS epoch_length, o_custkey % 65536 AS max_fuses, o_custkey % 3 AS remaining, o_orderkey % 50 AS payload_size,
  o_orderkey % 3 AS ledger_count, o_orderkey & 8 <> 0 AS is_fused FROM orders WHERE o_orderkey % 11 <> 0""")
def locked_header(spark, sf_dir):
    return locked.header(_locked_files(spark, sf_dir)).select("path", "version", "flags", "created", "epoch_length", "max_fuses", "remaining", "payload_size", "ledger_count", "is_fused")


@query("""SELECT o_orderkey::VARCHAR AS path, cast(k AS INT) AS sequence, cast(floor(epoch(o_orderdate)) AS BIGINT) AS ts, CASE o_orderkey % 5 WHEN 0 THEN 'created' WHEN 1 THEN 'heartbeat' WHEN 2 THEN 'attempt' WHEN 3 THEN 'consumed' ELSE 'expired' END AS action, o_custkey AS epoch
  FROM orders, range(2) r(k) WHERE k < o_orderkey % 3 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0""")
def locked_ledger(spark, sf_dir):
    rows = locked.ledger_rows(_locked_files(spark, sf_dir).where((F.col("path").cast("long") % 13) != 0))
    return rows.select("path", "sequence", "ts", "action", "epoch")


@query("SELECT l_orderkey, l_linenumber, xor(l_partkey, coalesce(lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey), 0)) AS delta FROM lineitem")
def xor_encode(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("place"))
    return spectral.xor_encode(li, ["l_orderkey"], "place", "l_partkey").select("l_orderkey", "l_linenumber", "delta")


@query("SELECT l_orderkey, l_linenumber, l_partkey AS value FROM lineitem")
def xor_decode(spark, sf_dir):
    """Encoded and decoded again: the values come back."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("place"))
    encoded = spectral.xor_encode(li, ["l_orderkey"], "place", "l_partkey").drop("l_partkey")
    return spectral.xor_decode(encoded, ["l_orderkey"], "place").select("l_orderkey", "l_linenumber", "value")


_PIXELS = """WITH v AS (SELECT vec_id, unnest(range(64)) AS i, cast(unnest(embedding) AS DOUBLE) AS value FROM embeddings), p AS (SELECT vec_id * 4 + i // 16 AS pixel, cast(i % 16 AS INT) AS band, value FROM v)
"""
#: The published fit of the colour matching functions, written out for SQL.
_MATCHED = """, w AS (SELECT *, 380 + band * 400 / 15 AS wl FROM p), m AS (SELECT *,
  1.056 * exp(-0.5 * pow((wl - 599.8) / (CASE WHEN wl < 599.8 THEN 37.9 ELSE 31.0 END), 2)) + 0.362 * exp(-0.5 * pow((wl - 442.0) / (CASE WHEN wl < 442.0 THEN 16.0 ELSE 26.7 END), 2))
    - 0.065 * exp(-0.5 * pow((wl - 501.1) / (CASE WHEN wl < 501.1 THEN 20.4 ELSE 26.2 END), 2)) AS mx,
  0.821 * exp(-0.5 * pow((wl - 568.8) / (CASE WHEN wl < 568.8 THEN 46.9 ELSE 40.5 END), 2)) + 0.286 * exp(-0.5 * pow((wl - 530.9) / (CASE WHEN wl < 530.9 THEN 16.3 ELSE 31.1 END), 2)) AS my,
  1.217 * exp(-0.5 * pow((wl - 437.0) / (CASE WHEN wl < 437.0 THEN 11.8 ELSE 36.0 END), 2)) + 0.681 * exp(-0.5 * pow((wl - 459.0) / (CASE WHEN wl < 459.0 THEN 26.0 ELSE 13.8 END), 2)) AS mz FROM w)
"""
_RGB = """round(greatest(0, least(1, 3.2404542 * bx - 1.5371385 * gy - 0.4985314 * rz)), 6) AS r, round(greatest(0, least(1, -0.9692660 * bx + 1.8760108 * gy + 0.0415560 * rz)), 6) AS g,
  round(greatest(0, least(1, 0.0556434 * bx - 0.2040259 * gy + 1.0572252 * rz)), 6) AS b"""


@query(_PIXELS + "SELECT pixel, band, value FROM p")
def deinterleave(spark, sf_dir):
    return spectral.planes(adapters.pixels(spark, sf_dir), "pixel", "bands").withColumn("value", F.col("value").cast("double"))


@query(_PIXELS + "SELECT pixel, string_agg(printf('%.4f', value), ' ' ORDER BY band) AS bands FROM p GROUP BY pixel")
def interleave(spark, sf_dir):
    """Planes put together as pixels."""
    back = spectral.pixels(spectral.planes(adapters.pixels(spark, sf_dir), "pixel", "bands"), "pixel")
    return back.select("pixel", F.array_join(F.transform("bands", lambda v: F.format_string("%.4f", v.cast("double"))), " ").alias("bands"))


@query("SELECT vec_id::VARCHAR AS image, cast(i // 16 AS INT) AS x, 0 AS y, cast(i % 16 AS INT) AS band, value FROM (SELECT vec_id, unnest(range(64)) AS i, cast(unnest(embedding) AS DOUBLE) AS value FROM embeddings)")
def image_round_trip(spark, sf_dir):
    """Each embedding as a spectral image file of four pixels, read again bit by bit."""
    p = adapters.pixels(spark, sf_dir).select(F.floor(F.col("pixel") / 4).cast("string").alias("image"), F.lit(0).alias("y"), (F.col("pixel") % 4).cast("int").alias("x"), "bands")
    back = images.decode(images.encode(p))
    return back.select("image", "x", "y", F.posexplode("bands").alias("band", "v")).select("image", "x", "y", "band", F.col("v").cast("double").alias("value"))


@query("SELECT vec_id::VARCHAR AS image, 2 AS mode, 4 AS width, 1 AS height, 16 AS bands FROM embeddings")
def image_info(spark, sf_dir):
    p = adapters.pixels(spark, sf_dir).select(F.floor(F.col("pixel") / 4).cast("string").alias("image"), F.lit(0).alias("y"), (F.col("pixel") % 4).cast("int").alias("x"), "bands")
    return images.info(images.encode(p)).drop("hash")


@query(_PIXELS + _MATCHED + ", s AS (SELECT pixel, sum(value * mx) / sum(my) AS bx, sum(value * my) / sum(my) AS gy, sum(value * mz) / sum(my) AS rz FROM m GROUP BY pixel) SELECT pixel, round(bx, 6) AS x, round(gy, 6) AS y, round(rz, 6) AS z, " + _RGB + " FROM s")
def spectral_xyz(spark, sf_dir):
    xyz = adapters.pixels(spark, sf_dir).select("pixel", *spectral.integrate(F.col("bands"), 16))
    found = xyz.select("pixel", F.round("X", 6).alias("_x"), F.round("Y", 6).alias("_y"), F.round("Z", 6).alias("_z"), *[F.round(c, 6).alias(n) for c, n in zip(spectral.to_rgb(F.col("X"), F.col("Y"), F.col("Z")), "rgb", strict=True)])
    return found.withColumnsRenamed({"_x": "x", "_y": "y", "_z": "z"})


_C = FILM_CURVES["default"]


@query(f"""WITH e AS (SELECT event_id, value / 100000 * {_C['iso']} AS x FROM events),
d AS (SELECT event_id, x, {_C['gamma']} * log10(greatest(x, 0) + 1e-10) AS s FROM e)
SELECT event_id, round(least({_C['max_density']}, CASE WHEN x <= {_C['toe_limit']} THEN {_C['base_fog']} + x / {_C['toe_limit']} * ({_C['gamma']} * log10({_C['toe_limit']} + 1e-10) - {_C['base_fog']})
  WHEN x >= {_C['shoulder_limit']} THEN s + ({_C['max_density']} - s) * least((x - {_C['shoulder_limit']}) / {2 * _C['shoulder_limit']}, 1) ELSE s END), 6) AS density FROM d""")
def film_curve(spark, sf_dir):
    density = spectral.film_density(F.col("value") / 100000, F.lit(1), _C)
    return table(spark, sf_dir, "events").select("event_id", F.round(density, 6).alias("density"))


@query(_PIXELS + _MATCHED + """, e AS (SELECT *, abs(value) * 800.0 AS x FROM m), d AS (SELECT *, 0.55 * log10(x + 1e-10) AS s FROM e),
f AS (SELECT *, pow(10, least(3.5, CASE WHEN x <= 0.001 THEN -0.25 + x / 0.001 * (0.55 * log10(0.001 + 1e-10) + 0.25) WHEN x >= 50.0 THEN s + (3.5 - s) * least((x - 50.0) / 100.0, 1) ELSE s END)) AS light FROM d),
s AS (SELECT pixel, sum(light * mx) * 400 / 15 / 300 AS bx, sum(light * my) * 400 / 15 / 300 AS gy, sum(light * mz) * 400 / 15 / 300 AS rz FROM f GROUP BY pixel) SELECT pixel, """ + _RGB + " FROM s")
def film_develop(spark, sf_dir):
    samples = spectral.planes(adapters.pixels(spark, sf_dir), "pixel", "bands").select("pixel", "band", F.abs(F.col("value").cast("double")).alias("energy"), F.lit(1.0).alias("weight"))
    return spectral.develop(samples, "pixel", 16, FILM_CURVES["negative"]).select("pixel", *[F.round(c, 6).alias(c) for c in "rgb"])


@query()
def hashes(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", codecs.sha3_256("html").alias("sha3_256"), codecs.xxhash32("html", F.lit(0)).alias("xxhash32"), F.crc32("html").alias("crc32"), codecs.shake_256("html", F.lit(16)).alias("shake_256"))


@query("SELECT page_id, strlen(html) AS size, sha256(html) AS hash FROM pages")
def pack_round_trip(spark, sf_dir):
    """Packed, unpacked, and hashed: the pages come back."""
    packed = table(spark, sf_dir, "pages").select("page_id", codecs.unpack(codecs.pack("html")).alias("x"))
    return packed.select("page_id", F.length("x").cast("long").alias("size"), F.sha2("x", 256).alias("hash"))


@query("SELECT page_id, strlen(html) AS size, sha256(html) AS hash FROM pages")
def press_round_trip(spark, sf_dir):
    """The compressed stream format of packed assets, there and back."""
    back = table(spark, sf_dir, "pages").select("page_id", codecs.unpress(codecs.press("html")).alias("x"))
    return back.select("page_id", F.length("x").cast("long").alias("size"), F.sha2("x", 256).alias("hash"))


_BYTES = """WITH b AS (SELECT lang, hex(encode(text)) AS h FROM documents), s AS (SELECT lang, unnest(string_split(trim(regexp_replace(h, '(..)', '\\1 ', 'g')), ' ')) AS x FROM b WHERE h <> ''),
c AS (SELECT lang, cast('0x' || x AS INT) AS symbol, count(*) AS n FROM s GROUP BY ALL)
"""


@query(_BYTES + "SELECT lang, symbol, n FROM c")
def byte_histogram(spark, sf_dir):
    return codecs.byte_histogram(table(spark, sf_dir, "documents"), "text", "lang")


@query(_BYTES + """, f AS (SELECT lang, symbol, n, greatest(1, n * 4096 // sum(n) OVER (PARTITION BY lang)) AS freq FROM c), g AS (SELECT *, 4096 - sum(freq) OVER (PARTITION BY lang) AS rest, row_number() OVER (PARTITION BY lang ORDER BY freq DESC, symbol) AS place FROM f)
SELECT lang, symbol, cast(freq + CASE WHEN place = 1 THEN rest ELSE 0 END AS INT) AS freq FROM g""")
def normalised_frequencies(spark, sf_dir):
    """Scaled to sum to 4096. In these tables the largest stays the largest, so SQL can give it the whole difference."""
    return codecs.normalised_frequencies(codecs.byte_histogram(table(spark, sf_dir, "documents"), "text", "lang"), "lang")


@query("SELECT user_id AS key, epoch(date_trunc('hour', ts))::BIGINT AS epoch_start, count(*) AS count FROM events GROUP BY ALL")
def stream_epoch_counts(spark, sf_dir):
    """The events read as a stream; counts per key and hour once it is at its end."""
    from stratalog.streaming.fuses import epoch_counts_of_stream

    rows = epoch_counts_of_stream(spark, sf_dir, "events.parquet", F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return rows.select("key", F.unix_seconds("epoch_start").alias("epoch_start"), "count")


@query("SELECT event_id, id FROM (SELECT event_id, event_id AS id FROM events)")
def sealed_round_trip(spark, sf_dir):
    """AES-GCM with the row's path as associated data, opened again; a wrong path opens nothing."""
    key, path = F.lit(b"0123456789abcdef0123456789abcdef"), F.concat(F.lit("event/"), F.col("event_id").cast("string"))
    nonce = F.unhex(F.lpad(F.hex("event_id"), 24, "0"))
    sealed = table(spark, sf_dir, "events").select("event_id", path.alias("path"), F.aes_encrypt(F.col("event_id").cast("string").cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT"), nonce, path.cast("binary")).alias("box"))
    opened = F.try_aes_decrypt("box", key, F.lit("GCM"), F.lit("DEFAULT"), F.col("path").cast("binary"))
    wrong = F.try_aes_decrypt("box", key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b"event/none"))
    return sealed.where(wrong.isNull()).select("event_id", opened.cast("string").cast("long").alias("id"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asset_prefix_totals(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
