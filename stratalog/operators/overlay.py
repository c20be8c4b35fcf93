"""Writable overlays over immutable assets. Both sides have path and content (null: none)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """path, content, layer of every path of either side: the overlay's content if there is any and it is not empty, else the base's."""
    over = overlay.select("path", F.nullif("content", F.lit("")).alias("over"))
    both = base.select("path", F.col("content").alias("under")).join(over, "path", "full_outer")
    return both.select("path", F.coalesce("over", "under").alias("content"), F.when(F.col("over").isNotNull(), "overlay").otherwise("base").alias("layer"))


def existing(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """The rows of base whose path the overlay has."""
    return base.join(overlay, "path", "left_semi")


def untouched(base: DataFrame, overlay: DataFrame) -> DataFrame:
    return base.join(overlay, "path", "left_anti")


def delete(overlay: DataFrame, tombstones: DataFrame) -> DataFrame:
    """The overlay without the paths of tombstones, which fall back to the base."""
    return overlay.join(tombstones, "path", "left_anti")


def write(overlay: DataFrame, changes: DataFrame) -> DataFrame:
    """Upsert: the latest version of each path (path, content, version). An aggregate, so that a hot path is combined early."""
    return overlay.unionByName(changes).groupBy("path").agg(F.max_by("content", "version").alias("content"), F.max("version").alias("version"))


def listing(overlay: DataFrame, folder: str) -> DataFrame:
    """Paths below a folder whose names don't begin with a dot."""
    name = F.substring_index("path", "/", -1)
    return overlay.where(F.col("path").startswith(folder) & ~name.startswith("."))


#: The folders of an overlay.
FOLDERS = ("saves", "config", "mods", "cache", "logs")


def folder_of(volume_path: Column, bundle: Column, base: str) -> Column:
    """Where a volume's overlay lies below a base folder: under its bundle's name, or else its file's."""
    name = F.coalesce(F.nullif(bundle, F.lit("")), F.substring_index(volume_path, "/", -1))
    return F.when(name != "", F.concat(F.lit(base.rstrip("/") + "/"), name))


def size(overlay: DataFrame, *by: str) -> DataFrame:
    return overlay.groupBy(*by).agg(F.count("*").alias("files"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).cast("long").alias("bytes"))
