"""The supplied tables seen as tables of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalog.operators import log
from stratalog.operators.ledger import epoch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as assets: path lang/source/id, group lang, wrap type document; a third of the size counts as stored."""
    d = table(spark, sf_dir, "documents")
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    path = F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string"))
    return d.select(
        F.col("doc_id").alias("idx"), path.alias("path"), F.floor((size + 2) / 3).cast("long").alias("stored_size"), size.alias("original_size"),
        F.lit(8).alias("wrap_type"), F.col("lang").alias("grp"), "source",
    )


def log_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log entries, a log for each user."""
    e = table(spark, sf_dir, "events")
    rows = e.select(
        F.col("user_id").alias("log"), "ts", "event_id", F.pmod(F.col("event_id"), F.lit(9)).cast("int").alias("type"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"),
        F.floor(F.col("value") * 100).cast("long").alias("stored_size"), "event_type",
    )
    return log.sequenced(rows, "ts", "event_id")


def page_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as archive entries: an archive for each host, the url's path without query and fragment."""
    rest = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select(
        F.substring_index(rest, "/", 1).alias("archive"), F.col("page_id").alias("idx"), F.regexp_replace(rest, "^[^/]*", "").alias("path"), F.octet_length("html").cast("long").alias("size")
    )


def ledger(spark: SparkSession, sf_dir: str, length: int = 30 * 86400) -> DataFrame:
    """Orders as ledger events of customers; epochs of a length since the customer's first order."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("event"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("ts"))
    first = F.min("ts").over(Window.partitionBy("key"))
    return o.withColumn("epoch", epoch(F.col("ts"), first, length))


def pixels(spark: SparkSession, sf_dir: str, bands: int = 16) -> DataFrame:
    """Embeddings as pixels, one for each so many components: vec_id times the pixels in a vector, and the pixel's place in it."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.floor(F.size("embedding") / bands).cast("int").alias("parts"))
    parts = e.select("vec_id", "embedding", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return parts.select((F.col("vec_id") * F.col("parts") + F.col("part")).alias("pixel"), F.slice("embedding", F.col("part") * bands + 1, F.lit(bands)).alias("bands"))
