"""Append-only logs: latest state, collections, chains, merging."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATE = ("content_type", "layer_flags", "wrap_count", "original_size", "stored_size", "content_hash")


def sequenced(entries: DataFrame, *order: str) -> DataFrame:
    """entries with sequence: their place in their log from 0."""
    return entries.withColumn("sequence", (F.row_number().over(Window.partitionBy("log").orderBy(*order)) - 1).cast("long"))


def entry_at(entries: DataFrame, sequence: int) -> DataFrame:
    return entries.where(F.col("sequence") == sequence)


def summary(entries: DataFrame) -> DataFrame:
    """A row for each log: entries, when it was created and last changed, and the last entry's state. One partial aggregate, no window."""
    state = [F.max_by(c, "sequence").alias(c) for c in STATE if c in entries.columns]
    return entries.groupBy("log").agg(F.count("*").alias("entries"), F.min_by("timestamp", "sequence").alias("created_at"), F.max_by("timestamp", "sequence").alias("modified_at"), *state)


def find_collection(entries: DataFrame, collection) -> DataFrame:
    """Membership entries of a collection."""
    return entries.where((F.col("type") == 8) & (F.col("collection_id") == collection))


def body(entries: DataFrame) -> Column:
    """What an entry's hash covers: its fields as text, and the hash prefix of the one before."""
    names = [c for c in entries.columns if c not in ("log", "prev_hash")]
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names])


def chained(entries: DataFrame) -> DataFrame:
    """entries with body and prev_hash: the first 16 hex digits of the hash of the entry before with its own prev_hash.

    A chain can only be built in order: logs are spread over tasks, and one log is a fold in one task.
    """
    import hashlib

    rows = entries.withColumn("body", body(entries)).drop("prev_hash")
    names = rows.columns

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, log = "", None
        for b in batches:
            out = []
            for own, text in zip(b["log"], b["body"], strict=True):
                if own != log:
                    last, log = "", own
                out.append(last)
                last = hashlib.sha256(f"{text}|{last}".encode()).hexdigest()[:16]
            yield b.assign(prev_hash=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", prev_hash string"
    return rows.repartition("log").sortWithinPartitions("log", "sequence").select(*names).mapInPandas(fold, schema)


def verify_chain(entries: DataFrame) -> DataFrame:
    """log, entries, broken, first_broken: entries whose prev_hash isn't the hash of the one before. Parallel over logs."""
    own = F.substring(F.sha2(F.concat_ws("|", "body", "prev_hash"), 256), 1, 16)
    before = F.lag("own").over(Window.partitionBy("log").orderBy("sequence"))
    checked = entries.withColumn("own", own).withColumn("fits", F.col("prev_hash") == F.coalesce(before, F.lit("")))
    return checked.groupBy("log").agg(F.count("*").alias("entries"), F.count_if(~F.col("fits")).alias("broken"), F.min(F.when(~F.col("fits"), F.col("sequence"))).alias("first_broken"))


def merge(first: DataFrame, second: DataFrame) -> DataFrame:
    """All entries of both logs, the first's before the second's, numbered anew; nothing is dropped."""
    both = first.withColumn("__part", F.lit(0)).unionByName(second.withColumn("__part", F.lit(1)), allowMissingColumns=True)
    return sequenced(both, "__part", "sequence").drop("__part")


def merged_chain(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both logs as one whose chain is built anew over the new numbers."""
    return chained(merge(first.drop("body", "prev_hash"), second.drop("body", "prev_hash")))


def carried(entries: DataFrame, *columns: str) -> DataFrame:
    """entries with nulls of columns filled from the last entry of the log that has a value."""
    upto = Window.partitionBy("log").orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumns({c: F.last(c, ignorenulls=True).over(upto) for c in columns})
