"""Splitting payloads into parts and putting parts together, with hashes of both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split(payloads: DataFrame, size: int) -> DataFrame:
    """id, part, parts, offset, length, chunk, part_hash, full_hash from id, payload. An empty payload is one empty part."""
    n = F.length("payload")
    parts = F.greatest(F.ceil(n / size), F.lit(1)).cast("int")
    wide = payloads.select("id", "payload", n.alias("n"), parts.alias("parts"), F.sha2("payload", 256).alias("full_hash")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    chunk = F.substr("payload", F.col("part") * size + 1, F.lit(size))
    return wide.select("id", "part", "parts", (F.col("part").cast("long") * size).alias("offset"), F.length(chunk).alias("length"), chunk.alias("chunk"), F.sha2(chunk, 256).alias("part_hash"), "full_hash")


def join(parts: DataFrame) -> DataFrame:
    """id, payload (null unless whole), status: whole, missing, broken part or broken whole."""
    ordered = F.array_sort(F.collect_list(F.struct("part", "chunk")))
    groups = parts.groupBy("id").agg(
        ordered.alias("x"), F.max("parts").alias("parts"), F.count_distinct("part").alias("seen"), F.count("*").alias("rows"), F.max("part").alias("last"),
        F.count_if(F.sha2("chunk", 256) != F.col("part_hash")).alias("broken"), F.max("full_hash").alias("full_hash"), F.count_distinct("full_hash").alias("wholes"),
    )
    text = F.array_join(F.transform("x", lambda c: c["chunk"]), "")
    status = (
        F.when((F.col("seen") != F.col("parts")) | (F.col("rows") != F.col("parts")) | (F.col("last") != F.col("parts") - 1) | (F.col("wholes") != 1), "missing")
        .when(F.col("broken") > 0, "broken part").when(F.sha2(text, 256) != F.col("full_hash"), "broken whole").otherwise("whole")
    )
    return groups.select("id", text.alias("payload"), status.alias("status")).withColumn("payload", F.when(F.col("status") == "whole", F.col("payload")))
