"""Log files as a stream: the entries of each file that comes to a folder."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from stratalog.model import LOG_ENTRIES
from stratalog.sources.logs import read_rail

_FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def log_tail(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of log entries; a file is read once, when it appears."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                rows = [(path, *e) for e in read_rail(bytes(content))]
                if rows:
                    yield pd.DataFrame(rows, columns=LOG_ENTRIES.names)

    return spark.readStream.schema(_FILES).format("binaryFile").load(folder).select("path", "content").mapInPandas(run, LOG_ENTRIES)
