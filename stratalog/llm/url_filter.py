"""URL filter: blocked Bloom filter of listed canonical URLs, then an exact hash join.

A canonical URL is host + path: the host is what follows the first ``://`` up to ``/``, ``?``,
``#`` or the end, A-Z lower-cased; the path goes on up to ``?``, ``#`` or the end. A listed entry
(host, path, verdict) fits its host and all subdomains if the url's path starts with the entry's.

Every url is turned into the few keys under which an entry could list it (its last c host labels
plus its first l path characters, for the label counts c and path lengths l that the list has).
The keys that the Bloom filter lets pass, and only those, are exploded and joined with the list; urls
without such a key are judged where they stand, and neither join nor shuffle sees them.

Defined cases: null urls and urls without ``://`` have empty host and path and fit nothing; an
empty list leaves every url to the default; repeated rows are judged each on their own; repeated
entries count once, and of entries with one key the one from the rules goes before the listing,
block before allow; other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import saved

WORDS = 8  # 64-bit words in a block; a key sets one bit in each
BITS_PER_KEY = 16
PIECE = 1024  # blocks put in order together
MAX_FILTER_BYTES = 8 << 20  # beyond it the filter grows no more: more false positives, same result

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), "^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def entries(spark: SparkSession, rows: Iterable[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rows), "host string, path string, verdict string")


def _listed(rules: DataFrame, listing: DataFrame) -> DataFrame:
    """key -> verdict, source (2 rule, 1 listing); one row a key."""
    both = rules.select("host", "path", "verdict", F.lit(2).alias("source")).unionByName(listing.select("host", "path", "verdict", F.lit(1).alias("source")))
    both = both.where("host is not null and path is not null and verdict in ('allow', 'block')")
    host = F.translate("host", UPPER, LOWER)
    return (
        both.select(host.alias("host"), "path", "verdict", "source")
        .groupBy("host", "path")
        .agg(F.max(F.struct("source", (F.col("verdict") == "block").alias("b"), "verdict")).alias("x"))
        .select(F.concat("host", "path").alias("key"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars"), "x.source", "x.verdict")
    )


def _place(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bit(key: Column, word: int) -> Column:
    second = F.xxhash64(key, F.lit("second"))
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(second, 6 * word).bitwiseAND(63).cast("int"))


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """One row: filter, the blocks' words in the blocks' order. keys has a column key.

    Blocks are put in order in pieces of PIECE and the pieces one after another, so the work grows with the blocks.
    """
    placed = keys.select(_place(F.col("key"), blocks).alias("block"), *[_bit(F.col("key"), w).alias(f"w{w}") for w in range(WORDS)])
    of_block = placed.groupBy("block").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(WORDS)])
    empty = keys.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block"), *[F.lit(0).cast("long").alias(f"w{w}") for w in range(WORDS)])
    filled = of_block.unionByName(empty).groupBy("block").agg(F.array(*[F.bit_or(f"w{w}") for w in range(WORDS)]).alias("words"))
    # a piece has a row for each of its blocks, PIECE at most
    pieces = filled.groupBy((F.col("block") / PIECE).cast("int").alias("piece")).agg(F.transform(F.sort_array(F.collect_list(F.struct("block", "words"))), lambda x: x["words"]).alias("words"))
    whole = pieces.agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("piece", "words"))), lambda x: x["words"])).alias("filter"))
    return whole


def _passes(bloom: Column, key: Column, blocks: int) -> Column:
    words = F.get(bloom, _place(key, blocks))
    hit = F.get(words, 0).bitwiseAND(_bit(key, 0)) != 0
    for w in range(1, WORDS):
        hit = hit & (F.get(words, w).bitwiseAND(_bit(key, w)) != 0)
    return F.coalesce(hit, F.lit(False))


def filter_urls(pages: DataFrame, rules: DataFrame, listing: DataFrame, *, default: str = "allow", max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """page_id, host, path, rule, listed, verdict for each row of pages (page_id, url).

    rule is the longest fitting rule (host + path); listed the longest fitting entry of the listing.
    The rule decides; else the listing; else the default.
    """
    spark = pages.sparkSession
    listed = saved(_listed(rules, listing), "listed-urls")
    # a row each for the shapes of keys; their number does not grow with the number of urls
    shapes = [(r.labels, r.chars) for r in listed.select("labels", "chars").distinct().orderBy("labels", "chars").toLocalIterator()]
    number = listed.count()
    blocks = max(1, min(max_filter_bytes, number * BITS_PER_KEY // 8) // (8 * WORDS))
    host, path = host_and_path(F.col("url"))
    judged = pages.select("page_id", "url").withColumn("row", F.monotonically_increasing_id()).select("row", "page_id", host.alias("host"), path.alias("path"))
    own_labels = F.size(F.split("host", r"\."))
    keys = [
        F.when((F.col("host") != "") & (own_labels >= labels) & (F.length("path") >= chars), F.concat(F.substring_index("host", ".", -labels), F.substring("path", 1, chars)))
        for labels, chars in shapes
    ]
    # a scalar subquery may stand in no lambda, so each key is tested by itself
    judged = judged.withColumn("bloom", bloom_filter(listed.select("key"), blocks).scalar())
    tested = [F.when(_passes(F.col("bloom"), k, blocks), k) for k in keys]
    possible = judged.select("row", "page_id", "host", "path", (F.array_compact(F.array_distinct(F.array(*tested))) if tested else F.array().cast("array<string>")).alias("keys"))
    # written, so that each key is tested once though two ways go on from here
    possible = saved(possible, "tested-urls")
    size = F.length("key")
    best = lambda source: F.max(F.when(F.col("source") == source, F.struct(size.alias("size"), "key", "verdict")))
    hits = possible.where(F.size("keys") > 0).select("row", "page_id", "host", "path", F.explode("keys").alias("key"))
    # a saved list and plain hits: a join that Spark can split where many urls have one key
    met = hits.join(listed.select("key", "source", "verdict"), "key", "left")
    found = met.groupBy("row", "page_id", "host", "path").agg(best(2).alias("r"), best(1).alias("l"))
    clear = possible.where(F.size("keys") == 0).select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("listed"), F.lit(default).alias("verdict"))
    return clear.unionByName(
        found.select("page_id", "host", "path", F.col("r.key").alias("rule"), F.col("l.key").alias("listed"), F.coalesce("r.verdict", "l.verdict", F.lit(default)).alias("verdict"))
    )
