"""Python data sources of the engine."""

from pyspark.sql import SparkSession

from stratalog.sources.archives import ArchiveSource
from stratalog.sources.containers import ContainerSource, VolumeSource
from stratalog.sources.extract import FilesSink
from stratalog.sources.logs import RailSource

ALL = (ArchiveSource, ContainerSource, VolumeSource, RailSource, FilesSink)


def register(spark: SparkSession) -> None:
    """Makes the sources known to a session, and lets filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in ALL:
        spark.dataSource.register(source)
