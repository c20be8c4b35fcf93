"""Asset catalog: lookups, totals and offsets over tables of assets (idx is the manifest's order)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def find_first(assets: DataFrame, path: str) -> DataFrame:
    """The asset of a path; of several the first in manifest order."""
    return assets.where(F.col("path") == path).orderBy("idx").limit(1)


def asset_at(assets: DataFrame, idx: int) -> DataFrame:
    """The asset of a place in the manifest."""
    return assets.where(F.col("idx") == idx)


def _capped(found: DataFrame, most: int | None) -> DataFrame:
    return found.orderBy("idx").limit(most) if most is not None else found


def find_group(assets: DataFrame, group, most: int | None = None) -> DataFrame:
    return _capped(assets.where(F.col("grp") == group), most)


def find_prefix(assets: DataFrame, prefix: str, most: int | None = None) -> DataFrame:
    """Assets whose path starts with prefix; an empty prefix fits all. Reaches the scan as StringStartsWith."""
    return _capped(assets.where(F.col("path").startswith(prefix)) if prefix else assets, most)


def find_type(assets: DataFrame, wrap_type: int, most: int | None = None) -> DataFrame:
    return _capped(assets.where(F.col("wrap_type") == wrap_type), most)


def totals(assets: DataFrame, *by: str) -> DataFrame:
    """Count, stored and original bytes and their ratio."""
    stored, original = F.sum("stored_size"), F.sum("original_size")
    return assets.groupBy(*by).agg(F.count("*").alias("assets"), stored.alias("stored"), original.alias("original"), F.round(stored / F.nullif(original, F.lit(0)), 6).alias("ratio"))


def with_offsets(assets: DataFrame, volume: str) -> DataFrame:
    """Payload offsets: stored bytes of the assets before, within each volume."""
    before = Window.partitionBy(volume).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return assets.withColumn("offset", F.coalesce(F.sum("stored_size").over(before), F.lit(0)).cast("long"))


def load(assets: DataFrame, payloads: DataFrame, volume: str) -> DataFrame:
    """assets with content: the slice of their volume's payload (volume, payload)."""
    joined = assets.join(payloads.select(volume, "payload"), volume)
    return joined.withColumn("content", F.substring("payload", F.col("offset").cast("int") + 1, F.col("stored_size").cast("int"))).drop("payload")
